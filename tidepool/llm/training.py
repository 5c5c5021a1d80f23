"""Labelled rows for the classifiers: a bounded, reproducible sample, and small solvers that run on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, texts


def labelled(docs: DataFrame, labels: DataFrame, target: str, modulus: int, held: int, bound: int) -> DataFrame:
    """(doc_id, text, label) of at most `bound` labelled rows outside the held-out fold, taken in the order of a hash of the id.

    A doc_id labelled more than once counts with its largest label, one with several texts with the smallest of them; null
    ids and labels don't count. So there are at most `bound` rows, however often a document repeats."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(target).isNotNull()).filter(fold(modulus) != held)
    known = known.groupBy("doc_id").agg(F.max(target).cast("int").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    some = texts(docs).join(F.broadcast(known), "doc_id")  # at most `bound` rows
    return some.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def lasso_logistic(x: np.ndarray, y: np.ndarray, strength: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept of logistic regression with an absolute penalty, by accelerated proximal gradient steps."""
    n, p = x.shape
    step = 4 * n / (np.linalg.norm(np.column_stack([x, np.ones(n)]), 2) ** 2 + 1e-9)
    w, b, z, c, t = np.zeros(p), 0.0, np.zeros(p), 0.0, 1.0
    for _ in range(rounds):
        off = sigmoid(x @ z + c) - y
        to = z - step * (x.T @ off) / n
        new = np.sign(to) * np.maximum(np.abs(to) - step * strength, 0)
        new_b = c - step * off.mean()
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, c = new + (t - 1) / s * (new - w), new_b + (t - 1) / s * (new_b - b)
        w, b, t = new, new_b, s
    return w, float(b)
