"""What the two classifiers share: folds, the bounded training sample and numpy's Adam."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import materialize


def fold(id_: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % folds


#: Bytes of text of each class that are learned from at most (and one text more).
CLASS_BYTES = 24 << 20


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, per_class: int, class_bytes: int = CLASS_BYTES) -> DataFrame:
    """doc_id, text, y and prior of the rows to learn from; prior is the share of label 1 among all that may be.

    Of each class these are the per_class rows of least id hash outside the held-out fold, until their texts reach class_bytes. A document
    whose labels contradict each other is left out, and so are labels of neither 0 nor 1. Only two counts reach the driver.
    """
    rows = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != held_out))
    rows = rows.groupBy(F.col("doc_id").alias("__id")).agg(F.min(label).alias("y"), F.max(label).alias("top")).where("y = top").select("__id", "y")
    counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    few = [rows.where(F.col("y") == y).orderBy(F.xxhash64("__id"), "__id").limit(per_class) for y in (0, 1)]
    ids = few[0].union(few[1])
    own = docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(ids), F.col("doc_id") == F.col("__id"))
    # one text for each id, should ids repeat
    own = materialize(own.groupBy("doc_id", "y").agg(F.min("text").alias("text")))
    sizes = own.select("doc_id", "y", F.octet_length("text").alias("size"))
    before = Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    kept = sizes.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0))).where(F.col("before") < class_bytes)
    own = own.join(F.broadcast(kept.select("doc_id")), "doc_id", "left_semi")
    return own.select("doc_id", "text", F.col("y").cast("int").alias("y"), F.lit(counts.get(1, 0) / max(1, sum(counts.values()))).alias("prior"))


def learn(rows: DataFrame, kind: Callable[[list[str], np.ndarray, float], Any]) -> Any:
    """kind(texts, y, prior) of sample()'s rows, made in one task: the driver gets the trained weights alone.

    The rows come in the order of their ids, which no partitioning changes. Without rows, kind has none to learn from.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = pd.concat([*batches, pd.DataFrame({"doc_id": [], "text": [], "y": [], "prior": []})]).sort_values("doc_id")
        prior = float(got.prior.iloc[0]) if len(got) else 0.0
        yield pd.DataFrame({"model": [pickle.dumps(kind([str(t) for t in got.text], got.y.to_numpy(np.float32), prior))]})

    made = rows.repartition(1).mapInPandas(run, "model binary").first()
    return pickle.loads(made[0]) if made else kind([], np.zeros(0, np.float32), 0.0)


class Adam:
    """Adam over a dict of arrays."""

    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray], decay: float = 0.0) -> None:
        self.t += 1
        for k, g in grads.items():
            g = g + decay * self.params[k]
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.params[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def balance(y: np.ndarray) -> np.ndarray:
    """Weights that make both classes count alike, mean 1."""
    return np.where(y > 0, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)).astype(np.float32)


def platt(logits: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and offset that turn logits into probabilities where label 1 has the share prior, by Newton's method."""
    prior = min(max(prior, 0.01), 0.99)
    w, target = balance(y) * 2 * np.where(y > 0, prior, 1 - prior), np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    x = np.stack([logits, np.ones_like(logits)], 1).astype(np.float64)
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = sigmoid(x @ beta)
        grad = x.T @ (w * (p - target)) + 1e-3 * (beta - [1, 0])
        hess = (x * (w * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(max(beta[0], 1e-3)), float(beta[1])
