"""What the two classifiers share: labelled rows, the hashed split, calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(mod: int, doc_id: str = "doc_id") -> Column:
    """crc32 of doc_id as text, modulo ``mod``; null for a null doc_id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod


def marks(labels: DataFrame, label: str, mod: int, held_out: int) -> DataFrame:
    """doc_id, y of the rows that may be learned from; of a doc_id's repeated labels the largest holds."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (remainder(mod) != held_out))
    return usable.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))


def pick(rows: DataFrame, most: int, salt: str) -> DataFrame:
    """``most`` rows at most, those with the smallest hash of doc_id."""
    return rows.withColumn("_o", F.md5(F.concat_ws(":", F.lit(salt), F.col("doc_id").cast("string")))).orderBy("_o", "doc_id").limit(most).drop("_o")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def platt(logit: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """a, b of sigmoid(a * logit + b), by Newton steps on the weighted, smoothed log loss; a stays positive."""
    if not len(y) or y.min() == y.max():
        return 1.0, 0.0
    pos, neg = weight[y == 1].sum(), weight[y == 0].sum()
    aim = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    mean, sd = float(np.average(logit, weights=weight)), float(logit.std() + 1e-9)
    x = np.stack([(logit - mean) / sd, np.ones_like(logit)], 1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = sigmoid(x @ w)
        grad = x.T @ (weight * (p - aim)) + ridge * np.array([w[0] - 1, 0])
        hess = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w - step * min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-7:
            break
    a = max(w[0], 1e-3) / sd
    return float(a), float(w[1] - a * mean)
