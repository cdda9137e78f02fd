"""Labels for the operators that learn, and a small logistic fit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS, HELD_OUT = 5, 0


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % FOLDS


def held_out(doc_id: Column) -> Column:
    """Whether labels of this id may not be learned from; a null id is held out of nothing and has no label."""
    return F.coalesce(fold(doc_id) == HELD_OUT, F.lit(False))


def training(labels: DataFrame, label: str, most: int, id_col: str = "doc_id") -> DataFrame:
    """(id, y, fold): labelled ids that may be learned from, at most about ``most``; a sample by hash if there are more.

    Null ids and labels are ignored; of several labels of an id the greatest counts.
    """
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    n = known.count()
    if n > most:
        known = known.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(0.97 * most / n * (1 << 20)))
    return known.select("id", "y", fold(F.col("id")).alias("fold"))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights with intercept last, means, scales) by Newton's method with a ridge; of one class or no rows: the smoothed prior alone."""
    k = x.shape[1]
    mean = x.mean(axis=0) if len(x) else np.zeros(k)
    scale = x.std(axis=0) if len(x) else np.ones(k)
    scale[scale == 0] = 1
    w = np.zeros(k + 1)
    prior = (y.sum() + 1) / (len(y) + 2)
    w[-1] = np.log(prior / (1 - prior))
    if len(np.unique(y)) < 2:
        return w, mean, scale
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    penalty = np.full(k + 1, ridge * len(x) / 100)
    penalty[-1] = 1e-9
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        grad = z.T @ (p - y) + penalty * w
        hess = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(hess + 1e-9 * np.eye(k + 1), grad)
        w -= step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w, mean, scale
