import numpy as np
import pytest

from sparkloom.llm import quality as q


def test_gradient():
    rng = np.random.default_rng(0)
    m = q.Model(["A fine text.", "BAD!! BAD!!"] * 3, np.array([1, 0] * 3, np.float32))
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    x, start, g, keep = rng.standard_normal((7, q.INPUTS)), np.array([0, 2, 3]), np.array([0.5, -1.0, 0.7]), {}
    m.logits(x, start, keep)
    grads = m._backward(keep, start, g)
    for name, value in m.p.items():
        at = tuple(rng.integers(0, n) for n in value.shape)
        old, sides = value[at], []
        for d in (1e-5, -1e-5):
            value[at] = old + d
            sides.append(m.logits(x, start) @ g)
        value[at] = old
        assert grads[name][at] == pytest.approx((sides[0] - sides[1]) / 2e-5, rel=1e-3, abs=1e-6), name


def test_held_out(spark):
    path = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    rows = q.scored(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.97 * len(rows)
    bad = spark.createDataFrame([(1, None, "x"), (1, "", "x"), (None, "word " * 30_000, "x"), (2, "😀", "x")], "doc_id long, text string, score string")
    out = q.scored(bad, labels.limit(0)).collect()
    assert len(out) == 4 and {r.score for r in out} == {0.5}
    model = q.fit(docs, labels)
    assert all(0 <= r.quality <= 1 for r in q.quality(bad, model).collect())
    assert q.quality(bad.limit(0), model).count() == 0


def test_lexical_by_counting():
    """Buckets of words, one passage and one word at a time, and byte sequences that do not depend on the passages beside."""
    said = [b"", b"the cat the", b"", "é x".encode(), b"a"]
    got = q.lexical(said)
    prime, top = int(q.PRIME), 1 << 64

    def bucket(h):
        return (h * prime % top) >> 57

    for row, data in zip(got, said):
        words = np.zeros(q.BUCKETS)
        for w in data.split():
            words[bucket((sum((c + 1) * pow(prime, k + 1, top) for k, c in enumerate(w)) * prime + len(w)) % top)] += 1
        assert np.allclose(row[q.BUCKETS :], q.lexical([b"zz", data, b"zz"])[1][q.BUCKETS :])
        assert row[: q.BUCKETS] == pytest.approx(np.sqrt(words / max(1, words.sum())), abs=1e-6)


def test_plain_scores():
    """The score of each document by a loop over its passages."""
    texts = ["A fine text of words.", "BAD!! BAD!! BAD!!", "word " * 200 + "END"] * 4
    m = q.Model(texts, np.array([1, 0, 1] * 4, np.float32))
    for text, score in zip(texts[:3], m.score(texts[:3])):
        x, _ = q.bags([text])
        hs, es = [], []
        for row in (x - m.shift) / m.scale:
            h = np.tanh(row @ m.p["W"] + m.p["c"])
            hs.append(h)
            es.append(float((np.tanh(h @ m.p["V"]) / (1 + np.exp(-(h @ m.p["U"])))) @ m.p["a"]))
        share = np.exp(es) / np.exp(es).sum()
        logit = sum(s * h for s, h in zip(share, hs)) @ m.p["w"] + m.p["b"][0]
        assert score == pytest.approx(1 / (1 + np.exp(-(m.slope * logit + m.offset))), rel=1e-4)
