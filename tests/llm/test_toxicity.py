import numpy as np
import pytest

from sparkloom.llm import toxicity as t


def test_windows_cover_every_word():
    for n in (0, 1, 31, 32, 33, 56, 57, 500):
        rows = t.windows(np.arange(n, dtype=np.int32))
        assert set(rows[rows >= 0].tolist()) == set(range(n))
        assert (rows[:, 0] >= 0).all()


def test_gradient():
    rng = np.random.default_rng(0)
    net = t.Network()
    net.p = {k: v.astype(np.float64) + 0.01 for k, v in net.p.items()}
    inputs = np.concatenate([rng.standard_normal((9, t.INPUTS)), np.zeros((1, t.INPUTS))])
    ids = rng.integers(0, 9, (3, t.WINDOW))
    ids[1, 5:] = -1
    g, keep = np.array([0.3, -1.0, 0.5]), {}
    net.forward(inputs, ids, keep)
    grads = net.backward(inputs, keep, g)
    for name, value in net.p.items():
        at = tuple(rng.integers(0, n) for n in value.shape)
        old, sides = value[at], []
        for d in (1e-3, -1e-3):
            value[at] = old + d
            sides.append(net.forward(inputs, ids) @ g)
        value[at] = old
        assert grads[name][at] == pytest.approx((sides[0] - sides[1]) / 2e-3, rel=0.05, abs=2e-3), name


@pytest.fixture(scope="module")
def frames(spark):
    path = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")


def test_held_out(frames):
    docs, labels = frames
    rows = t.scored(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), labels).join(labels, "doc_id").where("held_out").collect()
    hit = sum(r.predicted == 1 and r.toxic == 1 for r in rows)
    assert hit >= 0.8 * sum(r.toxic for r in rows)  # a tenth of the toxic labels here lie on texts without any toxic word
    assert hit >= 0.9 * sum(r.predicted for r in rows)


def test_edges(spark, frames):
    docs, labels = frames
    model = t.Model(["you idiot", "fine day", "idiot again", "fine words"] * 5, np.array([1, 0, 1, 0] * 5, np.float32))
    rows = spark.createDataFrame([(1, None, 7), (1, "", 7), (None, "idiot " * 30_000, 7), (2, "!!! 😀", 7), (3, "fine fine", 7)], "doc_id long, text string, score int")
    got = [r.toxicity for r in t.toxicity(rows, model).collect()]
    assert got[0] == got[1] == 0 and got[2] > got[4] and all(0 <= s <= 1 for s in got)
    assert t.toxicity(rows.limit(0), model).count() == 0
    assert t.Model([], np.zeros(0)).network is None
    assert {r.score for r in t.scored(rows.drop("score"), labels.limit(0)).collect()} == {0.0}


def test_plain_scores():
    """The score of a text by one step of the network a word, window by window."""
    texts = ["you idiot " * 3, "fine day " * 40, "an idiot here", "fine words"] * 5
    m = t.Model(texts, np.array([1, 0, 1, 0] * 5, np.float32))
    p = m.network.p
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for text in texts[:4]:
        own = t.words(text)
        inputs, best = t.features(own, m.ratios), -np.inf
        for at in t.cut(len(own)):
            seen = inputs[at : at + t.WINDOW]
            both = []
            for d, order in (("f", range(len(seen))), ("b", range(len(seen) - 1, -1, -1))):
                h, states = np.zeros(t.HIDDEN), {}
                for k in order:
                    x, u = seen[k] @ p[f"W{d}"] + p[f"c{d}"], h @ p[f"U{d}"]
                    z, r = sigmoid(x[: t.HIDDEN] + u[: t.HIDDEN]), sigmoid(x[t.HIDDEN : 2 * t.HIDDEN] + u[t.HIDDEN : 2 * t.HIDDEN])
                    n = np.tanh(x[2 * t.HIDDEN :] + r * u[2 * t.HIDDEN :])
                    h = states[k] = n + z * (h - n)
                both.append(states)
            hs = [np.concatenate([both[0][k], both[1][k]]) for k in range(len(seen))]
            e = np.exp([np.tanh(h @ p["Wa"]) @ p["va"] for h in hs])
            best = max(best, sum(w * h for w, h in zip(e / e.sum(), hs)) @ p["w"] + p["b"][0])
        assert t.Scorer(m).score([text])[0] == pytest.approx(sigmoid(m.slope * best + m.offset), rel=1e-3)


def test_no_column_is_overwritten(spark):
    model = t.Model(["you idiot", "fine day"] * 5, np.array([1, 0] * 5, np.float32))
    docs = spark.createDataFrame([(1, "fine day", 0.25, "a"), (2, "you idiot", 0.5, "b")], "doc_id long, text string, toxicity double, __toxicity string")
    with pytest.raises(ValueError):
        t.toxicity(docs, model)
    kept = t.remove(docs, model)
    assert kept.columns == docs.columns and (1, "fine day", 0.25, "a") in set(map(tuple, kept.collect()))
