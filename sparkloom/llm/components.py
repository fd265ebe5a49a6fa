"""Connected components of a graph in a table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """node and component (the least node that links reach) of every node of edges (a, b: longs, neither null).

    Every round is written to the shared folder, and only counts come to the driver. A star's centre is the least
    of a node and its neighbours, so no list of neighbours is ever gathered: minima are pre-aggregated before they
    shuffle, and a skewed join is split by the adaptive planner.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        # large star: every larger neighbour of a node goes to the least of its neighbourhood
        both = now.select("a", "b").union(now.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its smaller neighbours go to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", "m")).where("a <> b").distinct()
        before, now = now, materialize(small)
        discard(before)
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
