import random
import re

import duckdb
import pytest

from sparkloom.llm import components as c
from sparkloom.llm import ngram_join as g


def brute(docs):
    """(id, size, component) by comparing all sets that share an n-gram."""
    sets = []
    for _, text in docs:
        lower = (text or "").translate({k: k + 32 for k in range(65, 91)})
        w = re.findall(r"[^\x20\x09-\x0D]+", lower)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    where, parent = {}, {i: i for i, _ in docs}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    seen = set()
    for k, s in enumerate(sets):
        for t in s:
            where.setdefault(t, []).append(k)
    for k, s in enumerate(sets):
        for o in {o for t in s for o in where[t] if o > k}:
            both = len(s & sets[o])
            if (k, o) not in seen and 100 * both >= 75 * (len(s) + len(sets[o]) - both):
                a, b = sorted((find(docs[k][0]), find(docs[o][0])))
                parent[b] = a
    return sorted((i, len(s), find(i)) for (i, _), s in zip(docs, sets))


def run(spark, docs):
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, rep string")
    return sorted(tuple(r) for r in g.ngram_join(frame).collect())


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 9), (20, 21), (7, 7), *((k, k + 1) for k in range(100, 160)), (1, 100)]
    got = {r.node: r.component for r in c.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {3: 3, 4: 3, 5: 3, 9: 3, 20: 20, 21: 20, 1: 1, **{k: 1 for k in range(100, 161)}}
    assert c.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edges(spark):
    long = " ".join(str(k) for k in range(40_000))
    docs = [(3, None), (4, ""), (5, " \n\t"), (6, "Two words"), (1, "two\twords "), (7, "two other"), (8, "É é É é É"), (9, "é é é é é"), (10, long), (2, long + " end"), (2, long + " end"), (11, "a b c d e a b c d e a b c d e"), (12, "a b c d e a b c d e")]
    assert run(spark, docs) == brute(docs)
    assert run(spark, []) == []
    got = run(spark, [(1, "a b c d e f"), (1, "u v w x y z"), (2, "u v w x y z"), (3, "a b c d e f")])
    assert got == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 2, 1)]
    frame = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f")], "doc_id long, text string")
    assert sorted(map(tuple, g.ngram_join(frame).collect()), key=str) == [(4, 2, 4), (None, 2, None)]


@pytest.mark.parametrize("chunk", [1000, 7])
def test_random_families(spark, monkeypatch, chunk):
    """Families of texts that drift by edits around the threshold, passages that all share, and chunks smaller than a family."""
    monkeypatch.setattr(g, "CHUNK", chunk)
    monkeypatch.setattr(g, "BROADCAST_IDS", chunk)
    rng = random.Random(chunk)
    word = lambda: f"w{rng.randrange(3000)}"
    common = [word() for _ in range(30)]
    docs = []
    for family in range(12):
        text = [word() for _ in range(rng.choice([3, 6, 40, 150]))]
        for _ in range(rng.choice([1, 2, 5, 30])):
            own = list(text)
            for _ in range(rng.randrange(0, 1 + len(own) // 25)):
                k = rng.randrange(len(own))
                own[k : k + rng.choice([0, 1])] = [word()]
            if rng.random() < 0.3:
                own += common
            docs.append((rng.randrange(10**6), " ".join(own)))
            if rng.random() < 0.3:
                text = own
    docs = list(dict(docs).items())
    assert run(spark, docs) == brute(docs)


def test_documents(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{path}'").fetchall()
    assert sorted(map(tuple, g.ngram_join(spark.read.parquet(path)).collect())) == brute(docs)
