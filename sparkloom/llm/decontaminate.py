"""Benchmark decontamination with DataFrame functions only.

A hash set of the benchmark's word n-grams meets the n-grams of every document position; hits are
verified on the words themselves, and spans or whole documents go.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .common import aside, ascii_lower, materialize

#: What lies between words, before and after A-Z became a-z.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: The hash set is broadcast up to this many bytes of windows; a larger one is joined by shuffle.
BROADCAST_BYTES = 64 << 20
#: Keys of contaminated texts (32 characters each) that are broadcast at most.
BROADCAST_KEYS = 1_000_000


def words(text: Column) -> Column:
    """The words of a text in order; a null text has none."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), GAP), ""), F.array().cast("array<string>"))


def n_words(text: Column) -> Column:
    return F.coalesce(F.size(F.array_remove(F.split(text, GAP_ANY_CASE), "")), F.lit(0)).cast("long")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once a row, however often a lambda in use refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _hash(words_: Column, length: int | Column) -> Column:
    """The hash of a window from the hashes of its words."""
    return F.xxhash64(F.lit(length) if isinstance(length, int) else length, words_)


def _opening(hashes: Column, length: Column) -> Column:
    """The key of a window's first words, two or, of a window of one word, that: what a position must show before its whole window is hashed."""
    return F.xxhash64(F.get(hashes, F.lit(0)), F.when(length > 1, F.get(hashes, F.lit(1))))


def windows(items: DataFrame, n: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows of each item: item, len, window, hash, and opening (the key of its first words).

    An item of fewer than n words, but not none, is one window. Items without an id or words have none.
    """
    rows = items.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where(F.col("item").isNotNull() & (F.size("w") > 0))
    cut = lambda w, k: F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.slice(w, i, k))
    rows = rows.select("item", F.explode(_let(F.col("w"), lambda w: cut(w, F.least(F.size(w), F.lit(n))))).alias("window")).distinct()
    rows = rows.select("item", F.size("window").alias("len"), "window", F.transform("window", lambda x: F.xxhash64(x)).alias("h"))
    return rows.select("item", "len", "window", _hash(F.col("h"), F.col("len")).alias("hash"), _opening(F.col("h"), F.col("len")).alias("opening"))


def hits_of(rows: DataFrame, held: DataFrame) -> DataFrame | None:
    """doc_id, text_key, span, hash and window of every place of rows (doc_id, text) where a window of held stands; None without windows."""
    grams = held.select("len", "hash", "opening", "window").distinct()
    size = grams.agg(F.count("*").alias("rows"), F.sum(F.octet_length(F.array_join("window", " "))).alias("bytes"), F.collect_set("len").alias("lens")).first()
    # what is broadcast are distinct windows alone: the items of a window, however many, join the hits later
    fits = (size["bytes"] or 0) + 64 * size["rows"] <= BROADCAST_BYTES
    if not size["rows"]:
        return None
    key = [F.col("doc_id"), F.xxhash64("text").alias("text_key")]
    # a position's first two words pass by the openings of all windows; only where some window opens so is the whole of it hashed.
    # Windows beyond a broadcast are joined by shuffle, and then nothing but a window itself may move
    pairs = F.zip_with("h", F.slice("h", F.lit(2), F.greatest(F.size("h") - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    at = rows.select(*key, words(F.col("text")).alias("w")).withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    if fits:
        single = [F.transform("h", lambda h: F.xxhash64(h, F.lit(None).cast("long")))] if 1 in size["lens"] else []
        at = at.select("doc_id", "text_key", "w", "h", F.explode(F.array(pairs, *single)).alias("keys")).select("doc_id", "text_key", "w", "h", F.posexplode("keys").alias("pos", "opening"))
        at = at.join(F.broadcast(grams.select("opening", "len").distinct()), "opening")
    else:
        at = at.select("doc_id", "text_key", "w", "h", F.posexplode("h").alias("pos", "one")).withColumn("len", F.explode(F.array(*map(F.lit, size["lens"]))))
    at = at.where(F.col("pos") + F.col("len") <= F.size("w"))
    at = at.withColumn("hash", _hash(F.slice("h", F.col("pos") + 1, F.col("len")), F.col("len")))
    window = F.slice("w", F.col("pos") + 1, F.col("len"))
    if fits:
        found = at.join(F.broadcast(grams.drop("len", "opening")), "hash").where(window == F.col("window"))
    else:  # what shuffles is each window's own words, not its text's
        found = at.select("doc_id", "text_key", "pos", "len", "hash", window.alias("window")).join(grams.drop("len", "opening"), ["hash", "window"])
    span = F.struct((F.col("pos") + 1).alias("first"), (F.col("pos") + 1 + F.col("len")).alias("until"))
    return materialize(found.select("doc_id", "text_key", span.alias("span"), "hash", "window"))


def contamination(docs: DataFrame, items: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated and spans.

    spans lists the maximal runs of hit words as (first, until), counted from 1. A null or empty text has no words.
    A row of a repeated id stands for itself unless its text repeats too. Null ids are kept. Without items
    nothing is contaminated; without documents the result is empty. Further columns of docs are ignored.
    """
    held = materialize(windows(items, n))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total = rows.select("doc_id", F.xxhash64("text").alias("text_key"), n_words(F.col("text")).alias("n_words"))
    no_spans, no_ids = F.array().cast("array<struct<first:int,until:int>>"), F.array().cast("array<string>")
    hits = hits_of(rows, held)
    if hits is None:
        out = total.select("doc_id", "n_words", no_spans.alias("spans"), no_ids.alias("ids"))
    else:
        where = hits.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("span")).alias("found"))
        # a passage that a third of all documents hold is one key: where the items' windows fit, no hit moves for them
        all_ = held.agg(F.count("*").alias("rows"), F.sum(F.octet_length(F.array_join("window", " "))).alias("bytes")).first()
        of_items = held.select("item", "hash", "window")
        of_items = of_items if all_["bytes"] + 64 * all_["rows"] > BROADCAST_BYTES else F.broadcast(of_items)
        what = hits.select("doc_id", "text_key", "hash", "window").distinct().join(of_items, ["hash", "window"]).select("doc_id", "text_key", "item").distinct()
        what = what.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list("item")).alias("ids"))
        what = what.select(F.col("doc_id").alias("what_id"), F.col("text_key").alias("what_key"), "ids")
        per = where.join(what, F.col("doc_id").eqNullSafe(F.col("what_id")) & (F.col("text_key") == F.col("what_key")))
        per = per.select(F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key"), F.aggregate("found", no_spans, _merge).alias("spans"), "ids")
        out = total.join(per, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_key") == F.col("hit_key")), "left")
        out = out.select("doc_id", "n_words", F.coalesce("spans", no_spans).alias("spans"), F.coalesce("ids", no_ids).alias("ids"))
    n_hit = F.aggregate("spans", F.lit(0), lambda a, s: a + s["until"] - s["first"]).cast("long")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "spans")


def _merge(runs: Column, span: Column) -> Column:
    """Runs of hit words with a span, which starts no earlier than the last run, added."""
    last = F.try_element_at(runs, F.lit(-1))
    joined = F.struct(last["first"].alias("first"), F.greatest(last["until"], span["until"]).alias("until"))
    return F.when((F.size(runs) > 0) & (span["first"] <= last["until"]), F.concat(F.slice(runs, F.lit(1), F.greatest(F.size(runs) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(runs, F.array(span)))


def remove_documents(docs: DataFrame, items: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose id belongs to no contaminated text."""
    bad = contamination(docs, items, n, id_col, text_col).where("contaminated").select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col("__bad")), "left_anti")


def remove_rows(docs: DataFrame, items: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose own text is not contaminated, whatever their ids; items without an id count too."""
    own, text, id_ = aside(docs), F.col(f"__doc_{text_col}").cast("string"), F.col(f"__doc_{id_col}")
    # a row without a text is never contaminated; its id keeps such rows apart
    key = F.coalesce(F.md5(F.when(text != "", text)), F.concat(F.lit("id "), id_.cast("string")), F.lit("none"))
    named = items.withColumn("item_id", F.coalesce(F.col("item_id").cast("string"), F.lit("")))
    hits = hits_of(own.select(key.alias("doc_id"), text.alias("text")), materialize(windows(named, n)))
    if hits is None:
        return docs
    bad = materialize(hits.select(F.col("doc_id").alias("__bad")).distinct())
    # keys of contaminated texts: a bounded number is broadcast, so that texts stay where they are; more are joined by shuffle
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_KEYS else bad
    return own.join(bad, key == F.col("__bad"), "left_anti").toDF(*docs.columns)


def remove_spans(docs: DataFrame, items: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every hit word, and what separates it from the next word, cut out of the text. Ids must be unique."""
    bad = contamination(docs, items, n, id_col, text_col).where("contaminated").select(F.col("doc_id").alias("__bad"), F.col("spans").alias("__spans"))
    word = GAP_ANY_CASE.replace("[", "[^", 1)
    text, gap = F.col(text_col), GAP_ANY_CASE[:-1] + "*"
    pieces = F.regexp_extract_all(text, F.lit(f"{word}{gap}"), F.lit(0))
    kept = F.filter(pieces, lambda _, i: ~F.exists("__spans", lambda s: (s["first"] <= i + 1) & (i + 1 < s["until"])))
    cut = F.concat(F.regexp_extract(text, f"^{gap}", 0), F.array_join(kept, ""))
    joined = docs.join(bad, F.col(id_col).eqNullSafe(F.col("__bad")), "left")
    return joined.withColumn(text_col, F.when(F.col("__bad").isNull(), text).otherwise(cut)).select(*docs.columns)


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
       FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT item, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0))),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens)),
hit AS (SELECT doc_id, dw.n, i, item FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""
