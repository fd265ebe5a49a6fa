"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals.

Centroids and codebooks come from a bounded sample; every row is indexed. A query probes its nearest lists, ranks their
rows by asymmetric distance tables and reranks by exact distances the best of each list, and then every row that, within its own
quantisation error, could still beat the k-th of them: within the probed lists the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import materialize

#: Rows that centroids and codebooks are fitted on at most.
SAMPLE = 20_000
LISTS = 256  # or the square root of the number of rows, if that is more
#: Share of the lists that a query probes. Vectors without structure need this much for a recall of 0.9.
PROBED = 0.75
SUBSPACES = 16
#: Rows of one list reranked exactly for a query, at least.
RERANK = 64
#: Rows of a list, and queries, that meet in one task at most on average.
CHUNK, QUERIES = 8192, 2048


def clean(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that take part, one for each id (the least vector, should an id repeat)."""
    v = F.col("embedding")
    # NaN is larger than any other double, so one comparison excludes it and the infinities
    sound = F.col("vec_id").isNotNull() & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    out = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding")).where(sound)
    return out.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 1) -> np.ndarray:
    """k centroids by Lloyd's rounds; a centroid that loses its rows moves to a random row."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = closest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=k)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)])
    return centres


def closest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1) - 2 * x @ centres.T, 1)


class Index:
    """Coarse centroids and residual codebooks."""

    def __init__(self, x: np.ndarray, lists: int):
        self.centres = kmeans(x, max(1, min(lists, len(x) // 20)))
        rest = x - self.centres[closest(x, self.centres)]
        self.cuts = np.linspace(0, x.shape[1], min(SUBSPACES, x.shape[1]) + 1).astype(int)
        self.books = [kmeans(rest[:, a:b], min(256, len(x)), 6) for a, b in zip(self.cuts[:-1], self.cuts[1:])]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List and code of each row."""
        own = closest(x, self.centres)
        rest = x - self.centres[own]
        codes = [closest(rest[:, a:b], book).astype(np.uint8) for a, b, book in zip(self.cuts[:-1], self.cuts[1:], self.books)]
        return own, np.stack(codes, 1)

    def probes(self, q: np.ndarray, share: float) -> np.ndarray:
        k = len(self.centres)
        n = min(k, max(8, int(np.ceil(share * k))))
        return np.argsort((self.centres**2).sum(1) - 2 * q @ self.centres.T, 1, kind="stable")[:, :n]

    def approximate(self, q: np.ndarray, list_: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of one query to the coded rows of a list."""
        rest = q - self.centres[list_]
        return sum(((book - rest[a:b]) ** 2).sum(1)[codes[:, j]] for j, (a, b, book) in enumerate(zip(self.cuts[:-1], self.cuts[1:], self.books)))

    def errors(self, x: np.ndarray, list_: int, codes: np.ndarray) -> np.ndarray:
        """Distances of the rows of a list to what their codes stand for."""
        coded = np.concatenate([book[codes[:, j]] for j, book in enumerate(self.books)], 1)
        return np.sqrt(((x - self.centres[list_] - coded) ** 2).sum(1))


def search(rows: DataFrame, is_query: Column, k: int = 10, lists: int = LISTS, probed: float = PROBED, rerank: int = RERANK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each query's k nearest of all other rows: query_id, rank, vec_id, score (Euclidean, double precision).

    ``is_query`` is a condition on the column vec_id. Null ids, vectors that are null, zero or hold null or non-finite components, and vectors of
    another than the commonest length take no part; ids that repeat count once. Equal scores order by vec_id. A query whose lists
    hold fewer than k candidates searches all lists, so only a lack of candidates gives it fewer rows. No rows, no result. Other columns are ignored.
    """
    spark = rows.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    vectors = materialize(clean(rows, id_col, vector_col))
    lengths = vectors.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    vectors = vectors.where(F.size("embedding") == lengths["n"])
    few = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()
    n = vectors.count()
    index = spark.sparkContext.broadcast(Index(np.stack(few.embedding), max(lists, int(n**0.5))))  # lists centroids and 256 codes a subspace

    def file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.stack(b.embedding)
            own, codes = index.value.encode(x)
            yield pd.DataFrame({"list": own, "vec_id": b.vec_id, "codes": [c.tobytes() for c in codes], "vector": [v.tobytes() for v in x]})

    filed = materialize(vectors.mapInPandas(file, "list int, vec_id long, codes binary, vector binary"))
    # a list of copies may hold a third of all rows: lists are dealt in chunks, and queries in blocks
    chunks = {r["list"]: -(-r["count"] // CHUNK) for r in filed.groupBy("list").count().collect()}
    blocks = max(1, -(-vectors.where(is_query).count() // QUERIES))
    of_list = F.element_at(F.create_map(*(F.lit(x) for item in chunks.items() for x in item)), F.col("list"))
    left = filed.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), of_list)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def meet(key, held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(held) and len(asked):
            held = held.sort_values("vec_id")
            ids = held.vec_id.to_numpy()
            codes = np.frombuffer(b"".join(held.codes), np.uint8).reshape(len(ids), -1)
            x = np.frombuffer(b"".join(held.vector)).reshape(len(ids), -1)
            off, squares = index.value.errors(x, int(key[0]), codes), (x**2).sum(1)
            for q_id, q in zip(asked.query_id, asked["query"]):
                q = np.frombuffer(q)
                far = index.value.approximate(q, int(key[0]), codes)
                other, first = ids != q_id, max(rerank, 2 * k)
                near = np.argpartition(far, first)[:first] if len(far) > first else np.arange(len(far))
                near = near[other[near]]
                if len(far) > first and len(near) >= k:
                    # by the triangle inequality a row is at least this far; the slack covers rounding
                    kth = np.partition(np.sqrt(((x[near] - q) ** 2).sum(1)), k - 1)[k - 1]
                    scale = np.sqrt(q @ q) + np.sqrt(squares.max())
                    could = other & (np.abs(np.sqrt(far) - off) <= kth + 1e-6 * scale)
                    # the product form of the distance leaves out most others without copying rows
                    near = np.flatnonzero(could & (squares - 2 * (x @ q) + q @ q <= kth**2 + 1e-9 * scale**2))
                elif len(far) > first:
                    near = np.flatnonzero(other)
                near = np.sort(near)
                d = np.sqrt(((x[near] - q) ** 2).sum(1))
                best = np.argsort(d, kind="stable")[:k]
                out["query_id"] += [q_id] * len(best)
                out["vec_id"] += ids[near[best]].tolist()
                out["score"] += d[best].tolist()
        return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    def nearest(asked: DataFrame, share: float) -> DataFrame:
        """Each query's k nearest in its share of the lists."""

        def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                x = np.stack(b.embedding)
                wanted = index.value.probes(x, share)
                at = np.repeat(np.arange(len(b)), wanted.shape[1])
                bytes_ = np.array([v.tobytes() for v in x], object)
                yield pd.DataFrame({"list": wanted.ravel(), "query_id": b.vec_id.to_numpy()[at], "query": bytes_[at]})

        right = asked.mapInPandas(probe, "list int, query_id long, query binary")
        right = right.where(F.col("list").isin(list(chunks))).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), of_list.cast("long") - 1)))
        right = right.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
        keys = ["list", "chunk", "block"]
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, "query_id long, vec_id long, score double")
        ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
        return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    asked = vectors.where(is_query)
    first = materialize(nearest(asked, probed))
    full = first.groupBy("query_id").count().where(F.col("count") >= min(k, n - 1)).select(F.col("query_id").alias("vec_id"))
    short = materialize(asked.join(full, "vec_id", "left_anti"))
    if short.isEmpty():
        return first
    rest = nearest(short, 1.0)
    return first.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(rest)
