"""Bounded samples of labelled rows, and the small fits that the two classifiers share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: str, of: int) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(of))


def sample(docs: DataFrame, labels: DataFrame, label: str, *, per_class: int, held: tuple[int, int], id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """At most `per_class` labelled rows of either class as (id, label, text), and both classes' sizes.

    Rows whose crc32 remainder is the held-out one never count. The rows of least hash are taken, the
    same for any partitioning. Only ids of the bounded sample are broadcast."""
    modulus, out = held
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).where(remainder(id_col, modulus) != out)
    known = known.groupBy(F.col(id_col).alias("__id")).agg(F.max(label).cast("int").alias("__y"))
    sizes = {r["__y"]: r["count"] for r in known.groupBy("__y").count().collect()}
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("__y") == y).orderBy(F.xxhash64("__id"), "__id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), F.col(id_col) == F.col("__id"))
    return rows.select(F.col("__id").alias("id"), F.col("__y").alias("y"), "text"), sizes


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


class Logistic:
    """Weighted logistic regression on standardised features, by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        a = self._design(x)
        self.w = np.zeros(a.shape[1])
        penalty = np.full(a.shape[1], ridge)
        penalty[0] = 1e-6
        for _ in range(30):
            p = sigmoid(a @ self.w)
            grad = a.T @ (weight * (p - y)) + penalty * self.w
            hess = (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(penalty)
            step = np.linalg.solve(hess, grad)
            self.w -= step
            if np.abs(step).max() < 1e-6:
                break

    def _design(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.ones((len(x), 1)), np.clip((x - self.mean) / self.scale, -8, 8)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self._design(x) @ self.w)


def class_weights(y: np.ndarray, sizes: dict[int, int]) -> np.ndarray:
    """Weights that give a sample its classes' true shares."""
    total = sum(sizes.values())
    share = {c: sizes[c] / total / max(1e-9, float((y == c).mean())) for c in (0, 1)}
    return np.where(y == 1, share[1], share[0])
