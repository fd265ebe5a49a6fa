"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as the evidence of its spelling as a whole (word input), of its character n-grams (character
input) and a hash embedding. Windows of words overlap and cover the whole text; a text is as
toxic as its most toxic window, and training picks each text's deciding window anew.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .labelled import Adam, balance, fold, learn, platt, sample, sigmoid

WINDOW, STRIDE = 32, 24
HIDDEN, ATTENTION = 8, 8
BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
GRAMS = (3, 4, 5)
#: Labelled documents of each class that are learned from at most.
PER_CLASS = 1500
EPOCHS = 10
#: Words that a worker remembers at most.
MEMO_WORDS = 200_000

WORD = re.compile(r"\w+")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Spelling:
    """Buckets of many words and of their character n-grams, the words standing end to end as <word>."""

    def __init__(self, vocabulary: list[str]):
        code = np.frombuffer("".join(f"<{w}>" for w in vocabulary).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.size = np.array([len(w) + 2 for w in vocabulary], np.int64)
        self.start = np.cumsum(self.size) - self.size
        place = (np.arange(len(code)) - np.repeat(self.start, self.size)).astype(np.int32)
        left = np.repeat(self.size.astype(np.int32), self.size) - place
        power = np.cumprod(np.full(256, PRIME, np.uint64))
        self.word = _mix(np.add.reduceat(code * power[place & 255], self.start)) if len(vocabulary) else np.zeros(0, np.int64)
        self.grams = []  # of each length: a bucket at every place, and whether an n-gram begins there
        for n in GRAMS:
            h = np.full(len(code), n, np.uint64)
            for k in range(n):
                h[: len(code) - k] += code[k:] * power[k]
            self.grams.append((_mix(h), left >= n))

    def ratios(self, gram: np.ndarray) -> tuple[np.ndarray, ...]:
        """Largest of all and of the longest n-grams, mean and least of a word's log ratios."""
        top, least, total, count = None, None, 0, 0
        for bucket, whole in self.grams:
            r = gram[bucket]
            high = np.maximum.reduceat(np.where(whole, r, -20), self.start)
            low = np.minimum.reduceat(np.where(whole, r, 20), self.start)
            total = total + np.add.reduceat(np.where(whole, r, 0), self.start)
            count = count + np.add.reduceat(whole.astype(np.float32), self.start)
            top, least = (high, low) if top is None else (np.maximum(top, high), np.minimum(least, low))
        return top, np.maximum(high, -3), total / count, least

    def of(self, rows: np.ndarray) -> np.ndarray:
        """The distinct n-gram buckets of these words."""
        size = self.size[rows]
        at = np.repeat(self.start[rows] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.unique(np.concatenate([bucket[at][whole[at]] for bucket, whole in self.grams]))


PRIME = 0x9E3779B97F4A7C15


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(PRIME)
    return (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


class Evidence:
    """How much more often toxic documents hold a word or n-gram, as smoothed log ratios."""

    def __init__(self, spelling: Spelling, docs: list[np.ndarray], y: np.ndarray):
        self.n = np.array([max(1, (y == 0).sum()), max(1, (y == 1).sum())], float)
        self.word, self.gram = np.zeros((2, BUCKETS)), np.zeros((2, BUCKETS))
        for ids, k in zip(docs, y.astype(int)):
            if len(own := np.unique(ids)):
                self.word[k, np.unique(spelling.word[own])] += 1
                self.gram[k, spelling.of(own)] += 1

    def ratios(self, without: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Log ratios of words and n-grams; ``without`` leaves out one document of that class, as for the document itself."""
        out = []
        for counts in (self.word, self.gram):
            c = counts.copy()
            if without is not None:
                c[without] = np.maximum(c[without] - 1, 0)
            scaled = c * (self.n.min() / self.n)[:, None]
            out.append((np.log(scaled[1] + 0.5) - np.log(scaled[0] + 0.5)).astype(np.float32))
        return out[0], out[1]


INPUTS = 8


def features(vocabulary: list[str], ratios: tuple[np.ndarray, np.ndarray], spelling: Spelling | None = None) -> np.ndarray:
    """A row of inputs for each word."""
    if not vocabulary:
        return np.zeros((0, INPUTS), np.float32)
    s = spelling or Spelling(vocabulary)
    return np.stack([ratios[0][s.word], *s.ratios(ratios[1]), (s.word & 7) / 4 - 1, (s.word >> 3 & 7) / 4 - 1, np.minimum(s.size, 16) / 8 - 1], 1).astype(np.float32)


def cut(n: int) -> np.ndarray:
    """Starts of the windows that cover n words."""
    return np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE) if n else np.zeros(0, int)


def windows(ids: np.ndarray) -> np.ndarray:
    """Overlapping windows over a text's word rows, -1 where a window has no more words."""
    starts = cut(len(ids))
    padded = np.concatenate([ids, np.full(WINDOW, -1, ids.dtype)])
    return padded[starts[:, None] + np.arange(WINDOW)] if len(starts) else np.zeros((0, WINDOW), ids.dtype)


class Network:
    """The recurrent network; weights are plain arrays, so that a task gets it by its closure."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        new = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"Wa": new(2 * HIDDEN, ATTENTION), "va": new(ATTENTION), "w": new(2 * HIDDEN), "b": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": new(INPUTS, 3 * HIDDEN), f"U{d}": new(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}

    def _run(self, d: str, projected: np.ndarray, ids: np.ndarray, keep: list | None) -> np.ndarray:
        """Hidden states (time, window, unit) of one direction; -1 leaves the state as it is."""
        h = np.zeros((len(ids), HIDDEN), np.float32)
        out = np.zeros((WINDOW, len(ids), HIDDEN), np.float32)
        U = self.p[f"U{d}"]
        for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
            col = ids[:, t]
            live = (col >= 0)[:, None]
            x, u = projected[col], h @ U
            zr = 1 / (1 + np.exp(-(x[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])))
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(x[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
            new = np.where(live, n + z * (h - n), h)
            if keep is not None:
                keep.append((t, col, live, h, z, r, n, u[:, 2 * HIDDEN :]))
            h = out[t] = new
        return out

    def forward(self, inputs: np.ndarray, ids: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logit of each window."""
        kept = {d: [] if keep is not None else None for d in "fb"}
        hs = np.concatenate([self._run(d, inputs @ self.p[f"W{d}"] + self.p[f"c{d}"], ids, kept[d]) for d in "fb"], 2)
        a = np.tanh(hs @ self.p["Wa"])
        e = np.where(ids.T >= 0, a @ self.p["va"], -1e9)
        e = np.exp(e - e.max(0))
        share = e / e.sum(0)
        pooled = (share[:, :, None] * hs).sum(0)
        if keep is not None:
            keep |= {"kept": kept, "hs": hs, "a": a, "share": share, "pooled": pooled}
        return pooled @ self.p["w"] + self.p["b"][0]

    def backward(self, inputs: np.ndarray, k: dict, g: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients for the logits' gradients g."""
        p, hs, a, share = self.p, k["hs"], k["a"], k["share"]
        out = {"w": k["pooled"].T @ g, "b": np.array([g.sum()])}
        gp = g[:, None] * p["w"]
        gs = (hs * gp).sum(2)
        ge = share * (gs - (share * gs).sum(0))
        out["va"] = (a * ge[:, :, None]).sum((0, 1))
        ga = ge[:, :, None] * p["va"] * (1 - a * a)
        out["Wa"] = np.einsum("twh,twa->ha", hs, ga)
        gh_all = share[:, :, None] * gp + ga @ p["Wa"].T
        for d, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
            U = p[f"U{d}"]
            gW, gU, gc = np.zeros_like(p[f"W{d}"]), np.zeros_like(U), np.zeros_like(p[f"c{d}"])
            gh = np.zeros((hs.shape[1], HIDDEN), np.float32)
            for t, col, live, h, z, r, n, un in reversed(k["kept"][d]):
                gh = gh + gh_all[t][:, part]
                gn = np.where(live, gh * (1 - z), 0) * (1 - n * n)
                gz = np.where(live, gh * (h - n), 0) * z * (1 - z)
                gr = gn * un * r * (1 - r)
                gx = np.concatenate([gz, gr, gn], 1)
                gu = np.concatenate([gz, gr, gn * r], 1)
                gW += inputs[col].T @ gx
                gU += h.T @ gu
                gc += gx.sum(0)
                gh = np.where(live, gh * z + gu @ U.T, gh)
            out |= {f"W{d}": gW, f"U{d}": gU, f"c{d}": gc}
        return out


class Model:
    """A trained network with its evidence and calibration; without both classes it gives the base rate."""

    def __init__(self, texts: list[str], y: np.ndarray, prior: float | None = None):
        self.rate = float(y.mean()) if len(y) else 0.0
        self.network = None
        if not 0 < self.rate < 1:
            return
        place: dict[str, int] = {}
        own = [np.array([place.setdefault(w, len(place)) for w in words(t)], np.int32) for t in texts]
        if not place:
            return
        spelling = Spelling(list(place))
        evidence = Evidence(spelling, own, y)
        self.ratios = evidence.ratios()
        self.network = Network()
        # a document's own words are seen as if it had not been counted
        parts = [features(list(place), evidence.ratios(without=k), spelling) for k in (0, 1)]
        inputs = np.concatenate([*parts, np.zeros((1, INPUTS), np.float32)])
        cuts = [windows(ids + k * len(place)) for ids, k in zip(own, y.astype(np.int32))]
        owner = np.repeat(np.arange(len(cuts)), [len(c) for c in cuts])
        rows = np.concatenate([c for c in cuts if len(c)])
        # of each text its likeliest window trains: at first that of most evidence, then the one the network itself puts first
        score = np.append(inputs[:, :2].max(1)[:-1], -np.inf)[rows].max(1)
        adam, rng, weight = Adam(self.network.p, 0.01), np.random.default_rng(3), balance(y)
        clean = np.flatnonzero(y[owner] == 0)
        for epoch in range(EPOCHS):
            if epoch == 0 or epoch % 2:  # a choice serves two epochs, the first one one
                best = _best(owner, score if epoch == 0 else self._logits(inputs, rows))
            chosen = best.copy()
            if epoch:  # of clean texts another window too, so that no window of them is far from clean
                chosen = np.concatenate([chosen, rng.choice(clean, min(len(clean), len(chosen)), replace=False)])
            rng.shuffle(chosen)
            for at in range(0, len(chosen), 128):
                pick = chosen[at : at + 128]
                keep: dict = {}
                logits = self.network.forward(inputs, rows[pick], keep)
                t = y[owner[pick]]
                g = (weight[owner[pick]] * (sigmoid(logits) - t) / len(pick)).astype(np.float32)
                adam.step(self.network.backward(inputs, keep, g), 1e-4)
        logits = self._logits(inputs, rows)
        best = _best(owner, logits)
        self.slope, self.offset = platt(logits[best], y[owner[best]], self.rate if prior is None else prior)

    def _logits(self, inputs: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.concatenate([self.network.forward(inputs, rows[i : i + 4096]) for i in range(0, len(rows), 4096)])


def _best(owner: np.ndarray, score: np.ndarray) -> np.ndarray:
    """The index of each owner's highest score."""
    order = np.lexsort((score, owner))
    return order[np.append(owner[order][1:] != owner[order][:-1], True)]


class Scorer:
    """Scores texts; a worker's words and their inputs are remembered."""

    def __init__(self, model: Model):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.rows = np.zeros((0, INPUTS), np.float32)

    def score(self, texts: list[str]) -> np.ndarray:
        """Scores of whole texts; one without words has 0."""
        model, out = self.model, np.zeros(len(texts))
        if model.network is None:
            return np.full(len(texts), model.rate)
        at = 0
        while at < len(texts):  # long texts come in smaller lots
            until, size = at, 0
            while until < len(texts) and size < 1_500_000:
                size += len(texts[until])
                until += 1
            out[at:until] = self._score(texts[at:until])
            at = until
        return out

    def _score(self, texts: list[str]) -> np.ndarray:
        if len(self.place) > MEMO_WORDS:
            self._clear()
        place, known, ids = self.place, len(self.place), []
        for t in texts:
            ids.append(np.array([place.setdefault(w, len(place)) for w in words(t)], np.int32))
        if len(place) > known:
            fresh = list(islice(place, known, None))
            self.rows = np.concatenate([self.rows, features(fresh, self.model.ratios)])
        cuts = [windows(x) for x in ids]
        out = np.zeros(len(texts))
        if rows := [c for c in cuts if len(c)]:
            owner = np.repeat(np.arange(len(cuts)), [len(c) for c in cuts])
            rows = np.concatenate(rows)
            used, back = np.unique(rows, return_inverse=True)
            inputs = np.concatenate([self.rows[used[used >= 0]], np.zeros((1, INPUTS), np.float32)])
            local = back.reshape(rows.shape).astype(np.int32) - int(used[0] < 0)
            logits = self.model._logits(inputs, local)
            best = _best(owner, logits)
            out[owner[best]] = sigmoid(self.model.slope * logits[best].astype(float) + self.model.offset)
        return out


def fit(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, per_class: int = PER_CLASS) -> Model:
    """Learn from labels.toxic outside the held-out fold, per_class documents of each class at most."""
    return learn(sample(docs, labels, "toxic", folds, held_out, per_class), Model)


def toxicity(docs: DataFrame, model: Model, name: str = "toxicity") -> DataFrame:
    """docs with a further column of that name: 0 to 1, from the whole text alone. Null and word-less texts have 0; all columns stay.

    A name that docs has already is an error, so no column is ever overwritten.
    """
    if name.lower() in map(str.lower, docs.columns):
        raise ValueError(f"docs has a column {name} already")
    spark_model = docs.sparkSession.sparkContext.broadcast(model)  # two tables of 65536 log ratios and the weights
    score = F.pandas_udf(_scores(spark_model), "double")
    return docs.withColumn(name, score(F.col("text")))


def remove(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, with all their columns whatever their names, that score below threshold."""
    name = "__toxicity"
    while name in map(str.lower, docs.columns):
        name += "_"
    return toxicity(docs, model, name).where(F.col(name) < threshold).drop(name)


def _scores(model):
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model.value)
        for batch in texts:
            yield pd.Series(scorer.score([t if isinstance(t, str) else "" for t in batch]))

    run.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return run


def scored(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, threshold: float = 0.7) -> DataFrame:
    """Per document: doc_id, held_out, score and predicted (score >= threshold). Repeated ids are rows of their own."""
    out = toxicity(docs.select("doc_id", "text"), fit(docs, labels, folds, held_out))
    return out.select("doc_id", (fold(F.col("doc_id"), folds) == held_out).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= threshold).cast("int").alias("predicted"))
