import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import exact_dedup as d

SCHEMA = "doc_id long, text string, run int, digest string"


def brute(rows, largest=True):
    own = {}
    for i, text, *_ in rows:
        own.setdefault(text or "", []).append(i)
    out = []
    for text, ids in own.items():
        named = [i for i in ids if i is not None]
        keep = (max(named) if largest else min(named)) if named else None
        spent = False
        for i in ids:
            out.append((i, keep, len(ids), i == keep and not spent, hashlib.sha256(text.encode()).hexdigest()))
            spent |= i == keep
    return Counter(out)


def rows(n=400):
    hot = [(k, "the same text", 1, "clash") if k % 3 == 0 else (k, f"own {k % 150}", 2, "clash") for k in range(n)]
    odd = [(None, "own 1", 0, None), (None, "nobody's", 0, None), (None, "nobody's", 0, None), (n + 1, None, 0, None), (n + 2, "", 0, None), (7, "own 7", 2, "clash"), (7, "own 7", 2, "clash")]
    return hot + odd + [(n + 3, "é" * 300_000, 0, None), (n + 4, "é" * 300_000, 0, None), (n + 5, "é" * 299_999 + "e", 0, None), (n + 6, "Own 1", 0, None), (n + 7, " own 1", 0, None)]


@pytest.mark.parametrize("largest", [True, False])
def test_groups(spark, largest):
    data = rows()
    got = d.groups(spark.createDataFrame(data, SCHEMA).repartition(5), largest=largest)
    assert Counter(map(tuple, got.collect())) == brute(data, largest)


def test_digest_collision(spark, monkeypatch):
    """Texts whose run digests collide are held apart by what verifies them."""
    monkeypatch.setattr(d.F, "xxhash64", lambda *_: F.lit(1).cast("long"))
    data = rows(60)
    assert Counter(map(tuple, d.groups(spark.createDataFrame(data, SCHEMA)).collect())) == brute(data)


def test_normalised(spark):
    data = [(1, "A b"), (2, "a B"), (3, "c")]
    got = d.groups(spark.createDataFrame(data, "doc_id long, text string"), normalise=F.lower("text")).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got} == {(1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True)}


def test_deduplicate(spark):
    data = rows(90)
    frame = spark.createDataFrame(data, SCHEMA)
    got = d.deduplicate(frame)
    assert got.columns == frame.columns
    assert Counter((r.doc_id, r.text or "") for r in got.collect()) == Counter({(k[0], text) for (k, text) in {((x[0],), x[1] or "") for x in data} if any(r[0] == k[0] and r[3] and r[4] == hashlib.sha256(text.encode()).hexdigest() for r in brute(data))})
    assert d.groups(frame.limit(0)).collect() == [] and d.deduplicate(frame.limit(0)).collect() == []


def test_native(spark):
    """No Python worker in the plan."""
    plan = d.groups(spark.createDataFrame(rows(30), SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
