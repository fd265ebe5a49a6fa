import duckdb
import numpy as np
from pyspark.sql import functions as F

from sparkloom.llm import nearest


def brute(ids, x, queries, k=10):
    out = {}
    for q in queries:
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, d)) if i != q][:k]
        out[int(ids[q])] = [(int(ids[i]), d[i]) for i in order]
    return out


def test_recall(spark):
    path = "/root/testdata/sf0.1/embeddings.parquet"
    r = duckdb.sql(f"SELECT vec_id, embedding FROM '{path}' ORDER BY vec_id").fetchnumpy()
    ids, x = r["vec_id"], np.stack(r["embedding"]).astype(float)
    want = brute(ids, x, np.flatnonzero(ids % 20 == 0))
    got = {}
    for row in nearest.search(spark.read.parquet(path), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(row.query_id, []).append((row.vec_id, row.score))
        assert len(got[row.query_id]) == row.rank
        assert row.score == np.sqrt(((x[ids == row.query_id][0] - x[ids == row.vec_id][0]) ** 2).sum())
    assert got.keys() == want.keys()
    assert sum(len({v for v, _ in got[q]} & {v for v, _ in w}) for q, w in want.items()) >= 0.92 * 10 * len(want)


def test_near_copies(spark, monkeypatch):
    """A group of near copies that shares few codes: the nearest of it are found, not the smallest ids."""
    monkeypatch.setattr(nearest, "SAMPLE", 200)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(8000, 16))
    ids = np.arange(len(x))
    # one row of the group is in the fitting sample
    order = [r.id for r in spark.range(len(x)).orderBy(F.xxhash64("id"), "id").collect()]
    group = np.array(order[:1] + order[-3000:])
    x[group] = x[group[0]] + 1e-4 * rng.normal(size=(len(group), 16))
    asked = np.sort(group)[::100]
    frame = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    got = {}
    for r in nearest.search(frame, F.col("vec_id").isin(asked.tolist())).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute(ids, x, asked)
    assert sum(len(got[q] & {v for v, _ in w}) for q, w in want.items()) >= 0.99 * 10 * len(want)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [0.0, 2.0], 1), (4, None, 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (8, [None, 1.0], 1), (None, [1.0, 1.0], 1), (9, [1.0, 2.0, 3.0], 1), (100, [0.0, 0.0], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, list int")
    got = [tuple(r) for r in nearest.search(frame, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (0, 3, 3, np.sqrt(5.0))]
    assert nearest.search(frame.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_full_results(spark):
    """A query whose probed lists are short goes on to the others."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(200, 4)), 50 * rng.normal(size=(60, 4))])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = nearest.search(frame, F.col("vec_id") >= 200, k=150, probed=0.0).groupBy("query_id").count().collect()
    assert len(got) == 60 and {r["count"] for r in got} == {150}
