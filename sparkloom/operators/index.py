"""The index as snapshots: upserts, replacement, sweeps and cascades are new snapshots, never row updates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """table with the last change of each key put in its place. A key is replaced whole; ties go to the larger row.

    The last change of a key is an aggregate, so a key that changes a million times is reduced before it shuffles.
    """
    rest = [c for c in table.columns if c not in keys]
    last = changes.groupBy(*keys).agg(F.max(F.struct(*order, *(c for c in rest if c not in order))).alias("x"))
    last = last.select(*(F.col(c) if c in keys else F.col(f"x.{c}").alias(c) for c in table.columns))
    return table.join(last, _same(table, last, keys), "left_anti").unionByName(last)


def replace(table: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """table without the rows of the batch's keys, and the batch."""
    return table.join(batch.select(*keys).distinct(), keys, "left_anti").unionByName(batch)


def sweep(table: DataFrame, *kept: DataFrame, key: str) -> DataFrame:
    """The rows of table whose key is in one of the tables kept."""
    return table.join(reduce(DataFrame.unionByName, (k.select(key) for k in kept)).distinct(), key, "left_semi")


def cascade(child: DataFrame, gone: DataFrame, key: str, null: bool = False) -> DataFrame:
    """child without the rows of parents that are gone, or, with null, with their reference emptied."""
    dead = gone.select(F.col(key).alias("__gone")).distinct()
    if not null:
        return child.join(dead, F.col(key) == F.col("__gone"), "left_anti")
    joined = child.join(dead, F.col(key) == F.col("__gone"), "left")
    return joined.withColumn(key, F.when(F.col("__gone").isNull(), F.col(key))).select(*child.columns)


def new_texts(rows: DataFrame, known: DataFrame, text: str, order: str) -> DataFrame:
    """The first row, in order, of each text that known (a table with a column hash) does not have."""
    own = rows.withColumn("hash", F.sha2(F.col(text), 256))
    first = own.groupBy("hash").agg(F.min(order).alias("__first"))
    return own.join(first, "hash").where(F.col(order) == F.col("__first")).join(known.select("hash"), "hash", "left_anti").drop("__first")


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (a[k].eqNullSafe(b[k]) for k in keys))
