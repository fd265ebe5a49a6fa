"""English keyword search over chunks: stems, positions and cover density.

A chunk's title counts with weight 1 and its content with 0.4; a word is found where the stem is. A question of several terms
asks for any of them, and its rank is the sum over all occurrences. A question without terms asks for all of its own words, and its rank is the density of its covers: the shortest
spans that hold every word, each weighted by its occurrences and lowered by what else lies in it.

Only words whose stem is asked for become postings: a vocabulary is stemmed and cut to those first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.stem import STOP_WORDS, stems
from ..functions.text import among, tokens

#: Weights of title and content, positions kept of one stem, and the last position there is.
TITLE, CONTENT = 1.0, 0.4
KEPT = 255
LAST = 16383


def asked_stems(questions: DataFrame) -> DataFrame:
    """item_id, stem, every: the stems of a question's terms (any of them counts), or, where it has none, of its words (every one must occur)."""
    words = F.array_except(F.array_distinct(tokens(F.col("text"), 1)), among(STOP_WORDS))
    any_ = F.size("terms") > 0
    own = questions.select("item_id", F.explode(F.when(any_, F.array_except("terms", among(STOP_WORDS))).otherwise(words)).alias("word"), (~any_).alias("every"))
    return own.join(stems(own), "word").select("item_id", "stem", "every").distinct()


def lexicon(chunks: DataFrame, asked: DataFrame) -> DataFrame:
    """word and stem of the words of chunks (words, title_words) whose stem is asked for; no stop word is among them."""
    words = chunks.select(F.explode(F.array_union("words", "title_words")).alias("word"))
    return stems(words.where(~F.col("word").isin(STOP_WORDS))).join(asked.select("stem").distinct(), "stem", "left_semi")


def counts(chunks: DataFrame, keys: list[str], words: DataFrame) -> DataFrame:
    """keys, stem, m and n: occurrences of each asked stem in title and content."""
    every = F.concat(F.transform("title_words", lambda w: F.struct(w.alias("word"), F.lit(1).alias("m"), F.lit(0).alias("n"))), F.transform("words", lambda w: F.struct(w.alias("word"), F.lit(0).alias("m"), F.lit(1).alias("n"))))
    rows = chunks.select(*keys, F.inline(every)).join(words, "word")
    return rows.groupBy(*keys, "stem").agg(F.least(F.sum("m"), F.lit(KEPT)).alias("m"), F.least(F.sum("n"), F.lit(KEPT)).alias("n"))


def any_rank(found: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """item_id, keys, m, n and density of questions any of whose stems count."""
    rows = found.join(asked.where("NOT every").select("item_id", "stem"), "stem")
    return rows.groupBy("item_id", *keys).agg(F.sum("m").alias("m"), F.sum("n").alias("n")).withColumn("density", F.col("m") * TITLE + F.col("n") * CONTENT)


def cover_density(entries: Column, wanted: Column) -> Column:
    """The density of entries (an array of stem, at, weight, by at) for the stems wanted, which all must occur.

    A fold over the entries keeps the last place of each stem. Where the least of these moves on, the span from it to the entry is a cover.
    """

    def step(state: Column, e: Column) -> Column:
        last = F.zip_with(wanted, state["last"], lambda s, at: F.when(s == e["stem"], e["at"]).otherwise(at))
        begin = F.array_min(last)
        inside = F.filter(entries, lambda x: (x["at"] >= begin) & (x["at"] <= e["at"]))
        other = e["at"] - begin - (F.size(inside) - 1)
        noise = F.when(other < 0, F.floor((F.size(inside) - 1) / 2)).otherwise(other)
        gain = F.size(inside) / F.aggregate(inside, F.lit(0.0), lambda s, x: s + 1.0 / x["weight"]) / (1 + noise)
        cover = begin > state["begin"]
        return F.struct(last.alias("last"), F.greatest(begin, state["begin"]).alias("begin"), (state["sum"] + F.when(cover, gain).otherwise(0.0)).alias("sum"))

    start = F.struct(F.transform(wanted, lambda _: F.lit(0)).alias("last"), F.lit(0).alias("begin"), F.lit(0.0).alias("sum"))
    return F.aggregate(entries, start, step, lambda s: s["sum"])


def every_rank(chunks: DataFrame, asked: DataFrame, keys: list[str], words: DataFrame) -> DataFrame:
    """item_id, keys, m, n and density of questions all of whose words must occur; a content's words stand behind its title's."""
    want = asked.where("every").groupBy("item_id").agg(F.sort_array(F.collect_set("stem")).alias("wanted"))
    place = lambda field, weight, title: F.transform(field, lambda w, k: F.struct(w.alias("word"), F.least(k + 1, F.lit(LAST)).alias("k"), F.lit(weight).alias("weight"), F.lit(title).alias("title")))
    rows = chunks.select(*keys, F.size("title_words").alias("shift"), F.explode(F.concat(place("title_words", TITLE, 1), place("words", CONTENT, 0))).alias("x"))
    rows = rows.select(*keys, F.col("x.word").alias("word"), F.when(F.col("x.title") == 1, F.col("x.k")).otherwise(F.least(F.col("x.k") + F.col("shift"), F.lit(LAST))).alias("at"), F.col("x.weight").alias("weight"), F.col("x.title").alias("title"))
    # a chunk's own words bound each list
    hits = rows.join(words, "word").join(asked.where("every").select("item_id", "stem"), "stem").groupBy("item_id", *keys).agg(F.sort_array(F.collect_list(F.struct("at", "stem", "weight"))).alias("entries"), F.sum("title").alias("m"), F.sum(1 - F.col("title")).alias("n"), F.countDistinct("stem").alias("held"))
    full = hits.join(want, "item_id").where(F.col("held") == F.size("wanted"))
    return full.select("item_id", *keys, "m", "n", cover_density(F.col("entries"), F.col("wanted")).alias("density"))


def keyword_hits(chunks: DataFrame, questions: DataFrame, keys: list[str]) -> DataFrame:
    """item_id, keys, m, n (occurrences in title and content) and density of every chunk that answers a question's words.

    chunks have keys, words and title_words (lower-case, in order); questions item_id, text and terms.
    """
    asked = asked_stems(questions)
    words = lexicon(chunks, asked)
    return any_rank(counts(chunks, keys, words), asked, keys).unionByName(every_rank(chunks, asked, keys, words))
