"""Exact deduplication by a tree-merge of sorted digest runs, with DataFrame functions only.

Rows are dealt over RUNS runs by their number. A run is sorted by digest and holds one entry per text: the digest, what verifies
it (SHA-256 and length), how many rows have it and the one that stays. Round by round, WAYS runs meet, exchange their entries by digest
and merge: entries with equal digests are joined only if they verify as equal, and of these the best identifier stays. After
log(RUNS) rounds one run is left, which lies sorted over all tasks. What it says then goes back to the entries of the first runs and
from these to the rows, so a text that a third of all rows share is dealt over RUNS parts in every step, and arrives at each merge pre-aggregated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import materialize, numbered

#: Runs at the start and runs that one merge joins: 64, 8, 1.
RUNS = 64
WAYS = 8


def digests(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """row (number), doc_id, run, digest, sha, chars of every row; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    own = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("digest"), F.sha2(text, 256).alias("sha"), F.char_length(text).alias("chars"))
    return numbered(own, "row").withColumn("run", F.pmod(F.col("row"), F.lit(RUNS)).cast("int"))


def merged(runs: DataFrame, largest: bool) -> DataFrame:
    """The one run that is left: digest, sha, chars, n (rows), best (doc_id and row of the one that stays). runs: run, digest, sha, chars, n, best."""
    best = F.max("best") if largest else F.min("best")
    left = RUNS
    while left > 1:
        left = -(-left // WAYS)
        runs = runs.withColumn("run", F.floor(F.col("run") / WAYS).cast("int"))
        # rows of the same digest are one entry only if their SHA-256 and length agree as well
        runs = runs.groupBy("run", "digest", "sha", "chars").agg(F.sum("n").alias("n"), best.alias("best"))
        runs = materialize(runs.sortWithinPartitions("run", "digest"))
    return runs


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = True, normalise: Column | None = None) -> DataFrame:
    """One row for every row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Of rows whose texts are equal (after ``normalise``, a column made of text_col, where given), the one with the largest doc_id stays, or
    with ``largest=False`` the smallest. A null text is an empty one. A null doc_id loses against any other. Of repeated rows of
    the same doc_id and text, exactly one stays. Very long texts are read once, for their digests; other columns are not read. An empty table gives an empty result.
    """
    rows = digests(docs, id_col, F.col(text_col) if normalise is None else normalise)
    # a null id comes last whichever end wins
    rank = F.struct((F.col("doc_id").isNotNull() if largest else F.col("doc_id").isNull()).alias("named"), "doc_id", "row")
    key = ["digest", "sha", "chars"]
    first = rows.groupBy("run", *key).agg(F.count("*").alias("n"), (F.max(rank) if largest else F.min(rank)).alias("best"))
    first = materialize(first.sortWithinPartitions("run", "digest"))
    final = merged(first, largest).select(*key, F.col("n").alias("group_size"), F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"))
    # down again: to each run's entry, then to the rows of that run
    entries = first.select("run", *key).join(final, key)
    out = rows.join(entries, ["run", *key])
    return out.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = True) -> DataFrame:
    """The rows of docs that stay, with all their columns, in no order. docs' doc_id names a row: of rows with the same doc_id and text any one stays."""
    stays = groups(docs, id_col, text_col, largest).where("kept").select(F.col("doc_id").alias("__keep"), F.col("text_sha256").alias("__sha"))
    own = docs.withColumn("__own", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    return own.join(stays, F.col(id_col).eqNullSafe(F.col("__keep")) & (F.col("__own") == F.col("__sha"))).dropDuplicates(["__own"]).select(*docs.columns)


#: DuckDB SQL of groups() over documents.
SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
