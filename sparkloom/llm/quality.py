"""Document quality by attention-based multiple-instance learning, in numpy.

A document is a bag of passages. Every passage is encoded from the words and letter sequences that it has (hashed, with an embedding of
each bucket learned) and from its byte classes and repetitions; a gated attention learned from the documents' labels weighs
the encodings, and the weighted sum of them is scored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .labelled import Adam, balance, fold, learn, platt, sample, sigmoid

PASSAGE_WORDS = 64
HIDDEN, ATTENTION = 16, 8
#: Labelled documents of each class that are learned from at most.
PER_CLASS = 3000
EPOCHS = 24
#: Buckets of words, and as many of byte sequences of three.
BUCKETS = 128
#: Passages whose inputs are made or scored at once, about.
LOT_CHARS, LOT_ROWS = 1_000_000, 4096

#: Byte classes whose shares describe a passage.
CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:", b"!?", b"|/\\_~^<>=+", b"#$%&*@", b"\"'()[]{}-")
SHAPES = len(CLASSES) + 9
INPUTS = SHAPES + 2 * BUCKETS
PRIME = np.uint64(0x9E3779B97F4A7C15)


def lexical(data: list[bytes]) -> np.ndarray:
    """Square roots of the shares of each bucket of words and of byte sequences, for passages of words parted by one blank."""
    n = len(data)
    code = np.frombuffer(b" ".join(data) + b"   ", np.uint8)
    owner = np.append(np.repeat(np.arange(n), [len(x) + 1 for x in data]), [n - 1, n - 1])
    word = code != 32
    start = np.flatnonzero(word & np.append(True, ~word[:-1]))
    wide = code.astype(np.uint64)
    out = np.zeros((n, 2 * BUCKETS), np.float32)
    if len(start):
        end = np.flatnonzero(word & np.append(~word[1:], True)) + 1
        place = np.arange(len(code)) - np.repeat(np.append(0, start), np.diff(np.concatenate([[0], start, [len(code)]])))
        power = np.cumprod(np.full(64, PRIME, np.uint64))
        terms = np.where(word, (wide + np.uint64(1)) * power[place & 63], np.uint64(0))
        spelled = np.add.reduceat(terms, start) * PRIME + (end - start).astype(np.uint64)
        three = (wide[:-2] | wide[1:-1] << np.uint64(8) | wide[2:] << np.uint64(16)) * PRIME
        inside = word[1:-1] & (owner[:-2] == owner[2:])  # any three bytes of a passage around one of a word
        for k, (own, hashed) in enumerate(((owner[start], spelled), (owner[:-2][inside], three[inside]))):
            bucket = (hashed * PRIME >> np.uint64(57)).astype(np.int64)
            counts = np.bincount(own * BUCKETS + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS)
            out[:, k * BUCKETS : (k + 1) * BUCKETS] = np.sqrt(counts / np.maximum(1, counts.sum(1))[:, None])
    return out


def passages(text: str) -> tuple[list[tuple], list[bytes]]:
    """Shape inputs and words of each run of PASSAGE_WORDS words of the whole text; one passage for a text without words."""
    words = text.split()
    rows, said = [], []
    for at in range(0, max(1, len(words)), PASSAGE_WORDS):
        own = words[at : at + PASSAGE_WORDS]
        data = "".join(own).encode("utf-8", "surrogatepass")
        n, size = len(own), max(1, len(data))
        shares = [1 - len(data.translate(None, c)) / size for c in CLASSES]
        most = Counter(own).most_common(1)[0][1] if own else 0
        many = max(1, n)
        rows.append((
            *shares, 1 - sum(shares), n / PASSAGE_WORDS, len(set(own)) / many, sum(map(eq, own, own[1:])) / many, most / many,
            size / many / 8, sum(w[:1].isupper() for w in own) / many, sum(not w.isalpha() for w in own) / many, max(map(len, own), default=0) / 32,
        ))
        said.append(" ".join(own).lower().encode("utf-8", "surrogatepass"))
    return rows, said


def bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Inputs of the passages of all texts, and where each text's begin."""
    shapes, said, sizes, out = [], [], [], []

    def made() -> None:
        out.append(np.concatenate([np.minimum(np.array(shapes, np.float32), 8), lexical(said)], 1))
        shapes.clear(), said.clear()

    held = 0
    for text in texts:
        rows, words = passages(text)
        shapes += rows
        said += words
        sizes.append(len(rows))
        held += len(text)
        if held >= LOT_CHARS:
            made()
            held = 0
    if said:
        made()
    size = np.array(sizes, np.int64)
    return np.concatenate(out), np.cumsum(size) - size


class Model:
    """Encoder, gated attention and score; without both classes it gives the base rate."""

    def __init__(self, texts: list[str], y: np.ndarray, prior: float | None = None, seed: int = 5):
        self.rate = float(y.mean()) if len(y) else 0.5
        self.p: dict[str, np.ndarray] = {}
        if len(y) == 0 or not 0 < self.rate < 1:
            return
        x, start = bags(texts)
        self.shift, self.scale = x.mean(0), x.std(0) + 0.02
        rng = np.random.default_rng(seed)
        new = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"W": new(INPUTS, HIDDEN), "c": np.zeros(HIDDEN, np.float32), "V": new(HIDDEN, ATTENTION), "U": new(HIDDEN, ATTENTION), "a": new(ATTENTION), "w": new(HIDDEN), "b": np.zeros(1, np.float32)}
        adam, weight, size = Adam(self.p, 0.01), balance(y), np.diff(np.append(start, len(x)))
        for _ in range(EPOCHS):
            order = rng.permutation(len(y))
            for at in range(0, len(order), 128):
                pick = order[at : at + 128]
                n = size[pick]
                first = np.cumsum(n) - n
                rows = np.repeat(start[pick] - first, n) + np.arange(n.sum())
                keep: dict = {}
                logits = self.logits(x[rows], first, keep)
                g = (weight[pick] * (sigmoid(logits) - y[pick]) / len(pick)).astype(np.float32)
                adam.step(self._backward(keep, first, g), 1e-4)
        self.slope, self.offset = platt(self._all(x, start), y, self.rate if prior is None else prior)

    def _all(self, x: np.ndarray, start: np.ndarray) -> np.ndarray:
        """logits() of many bags, some of them at a time."""
        ends, out, at = np.append(start[1:], len(x)), [], 0
        while at < len(start):
            until = max(at + 1, int(np.searchsorted(ends, start[at] + LOT_ROWS, "right")))
            out.append(self.logits(x[start[at] : ends[until - 1]], start[at:until] - start[at]))
            at = until
        return np.concatenate(out)

    def logits(self, x: np.ndarray, start: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logit of each bag."""
        p = self.p
        x = (x - self.shift) / self.scale
        h = np.tanh(x @ p["W"] + p["c"])
        v, u = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
        e = (v * u) @ p["a"]
        n = np.diff(np.append(start, len(x)))
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, start), n))
        share = e / np.repeat(np.add.reduceat(e, start), n)
        pooled = np.add.reduceat(share[:, None] * h, start)
        if keep is not None:
            keep |= {"x": x, "h": h, "v": v, "u": u, "share": share, "pooled": pooled, "n": n}
        return pooled @ p["w"] + p["b"][0]

    def _backward(self, k: dict, start: np.ndarray, g: np.ndarray) -> dict[str, np.ndarray]:
        p, h, v, u, share = self.p, k["h"], k["v"], k["u"], k["share"]
        gp = np.repeat(g[:, None] * p["w"], k["n"], 0)
        gs = (h * gp).sum(1)
        ge = share * (gs - np.repeat(np.add.reduceat(share * gs, start), k["n"]))
        gv, gu = ge[:, None] * p["a"] * u * (1 - v * v), ge[:, None] * p["a"] * v * u * (1 - u)
        gz = (share[:, None] * gp + gv @ p["V"].T + gu @ p["U"].T) * (1 - h * h)
        return {"w": k["pooled"].T @ g, "b": np.array([g.sum()]), "a": ge @ (v * u), "V": h.T @ gv, "U": h.T @ gu, "W": k["x"].T @ gz, "c": gz.sum(0)}

    def score(self, texts: list[str]) -> np.ndarray:
        """Scores of whole texts, a bounded number of characters at a time."""
        if not self.p:
            return np.full(len(texts), self.rate)
        out, at = np.zeros(len(texts)), 0
        while at < len(texts):
            until, size = at, 0
            while until < len(texts) and size < LOT_CHARS:
                size += len(texts[until])
                until += 1
            out[at:until] = sigmoid(self.slope * self._all(*bags(texts[at:until])).astype(float) + self.offset)
            at = until
        return out


def fit(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, per_class: int = PER_CLASS) -> Model:
    """Learn from labels.quality outside the held-out fold, per_class documents of each class at most."""
    return learn(sample(docs, labels, "quality", folds, held_out, per_class), Model)


def quality(docs: DataFrame, model: Model, name: str = "quality") -> DataFrame:
    """docs with a further column of that name: 0 to 1 from the whole text alone. Null counts as empty, which is one passage of no words.

    A name that docs has already is an error, so no column is ever overwritten.
    """
    if name.lower() in map(str.lower, docs.columns):
        raise ValueError(f"docs has a column {name} already")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred weights

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(shared.value.score([t if isinstance(t, str) else "" for t in batch]))

    run.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn(name, F.pandas_udf(run, "double")(F.col("text")))


def scored(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, threshold: float = 0.7) -> DataFrame:
    """Per document: doc_id, held_out, score and predicted (score >= threshold). Repeated ids are rows of their own."""
    out = quality(docs.select("doc_id", "text"), fit(docs, labels, folds, held_out))
    return out.select("doc_id", (fold(F.col("doc_id"), folds) == held_out).alias("held_out"), F.col("quality").alias("score"), (F.col("quality") >= threshold).cast("int").alias("predicted"))
