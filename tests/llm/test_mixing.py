import pytest

from sparkloom.llm import mixing as m


def edf(weights):
    """Slot by slot, the earliest deadline of what is released."""
    total, done, out = sum(weights.values()), dict.fromkeys(weights, 0), []
    for t in range(total):
        ready = [(-(-(done[s] + 1) * total // a), s) for s, a in sorted(weights.items()) if done[s] * total // a <= t]
        s = min(ready)[1]
        out.append((t, s, done[s]))
        done[s] += 1
    return out


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 9, "b": 1, "c": 1}, {"a": 3, "b": 5, "c": 7, "d": 2}, {f"s{k}": k % 4 + 1 for k in range(20)}, {f"x{k}": k * k % 23 + 1 for k in range(40)}])
def test_schedule(spark, weights):
    rows = m.schedule(spark, weights).orderBy("at").collect()
    assert [(r["at"], r["source"], r["block"]) for r in rows] == edf(weights)
    total, done = sum(weights.values()), dict.fromkeys(weights, 0)
    for r in rows:
        assert r["release"] <= r["at"] < r["deadline"]
        done[r["source"]] += 1
        assert all(abs(done[s] - (r["at"] + 1) * a / total) < 1 for s, a in weights.items())


def test_many_sources(spark):
    """A thousand sources of few weights, in some seconds."""
    import time

    weights = {f"s{k:04}": k % 4 + 1 for k in range(1000)}
    began = time.time()
    rows = m.schedule(spark, weights).orderBy("at").collect()
    assert time.time() - began < 60
    table = spark.createDataFrame(list(weights.items()), "source string, weight int")
    assert sorted(map(tuple, rows)) == sorted(map(tuple, m.long_schedule(table, sum(weights.values())).select(*rows[0].__fields__).collect()))


def test_mix(spark):
    docs = [(k, "x" * (k * 37 % 90), "hot" if k % 3 else f"s{k % 4}", "clash") for k in range(600)] + [(None, None, None, "clash"), (7, "x" * 5000, "s1", "clash"), (7, "x" * 5000, "s1", "clash")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string, release string")
    weights, size = {"hot": 5, "s0": 2}, 200
    rows = m.mix(frame, weights, size).collect()
    assert sorted((r.doc_id, r.text, r.source, r.release) for r in rows if r.doc_id is not None) == sorted(d for d in docs if d[0] is not None) and len(rows) == len(docs)
    import hashlib

    own = {}
    for d in docs:
        own.setdefault(d[2] or "", []).append(d)
    want, all_ = [], {s: weights.get(s, 1) for s in own}
    period, place = sum(all_.values()), {(s, k): t for t, s, k in edf({s: weights.get(s, 1) for s in own})}
    for s, ds in own.items():
        at = 0
        for d in sorted(ds, key=lambda d: (hashlib.md5(str("" if d[0] is None else d[0]).encode()).hexdigest(), d[0] or 0)):
            b = at // size
            want.append((d[0] if d[0] is not None else -1, b, b // all_[s] * period + place[s, b % all_[s]]))
            at += len(d[1] or "")
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.mix_block, r.mix_slot) for r in rows) == sorted(want)
    assert m.mix(frame.limit(0), weights, size).count() == 0
    with pytest.raises(ValueError):
        m.schedule(spark, {"a": m.MAX_PERIOD, "b": 1})


def test_long_period(spark, monkeypatch):
    """Beyond MAX_PERIOD the heaps make the fold's jobs, and the mix is the same."""
    weights = {f"s{k:02}": k % 5 + 1 for k in range(30)}
    table = spark.createDataFrame(list(weights.items()), "source string, weight int")
    rows = m.long_schedule(table, sum(weights.values()))
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, m.schedule(spark, weights).select(rows.columns).collect()))
    docs = spark.createDataFrame([(k, "x" * (k % 50), f"s{k % 30:02}") for k in range(900)], "doc_id long, text string, source string")
    want = sorted(map(tuple, m.mix(docs, weights, 40).collect()))
    monkeypatch.setattr(m, "MAX_PERIOD", 10)
    assert sorted(map(tuple, m.mix(docs, weights, 40).collect())) == want


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "x", "a", 5, 6), (2, "y", "b", 7, 8)], "doc_id long, text string, source string, mix_slot int, mix_block int")
    got = m.mixed(docs, {"a": 1, "b": 2}, 10)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, docs.collect()))
    with pytest.raises(ValueError):
        m.mix(docs, {}, 10)
