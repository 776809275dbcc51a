"""Fitting of linear models on the driver from bounded samples of labelled rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm._common import held_out, small, written


def share(key: str, part: float) -> Column:
    """True for about this share of the keys, by hash."""
    return F.pmod(F.xxhash64(F.lit(53), F.col(key)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, part))


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int, folds: int, fold: int) -> DataFrame:
    """(doc_id, text, y) of about most labelled documents outside the held-out fold, chosen by hash of doc_id: a row for each, however many rows share its doc_id, with the text of the least hash. A doc_id with several labels counts with the least."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out("doc_id", folds, fold)).groupBy("doc_id").agg(F.min("y").alias("y"))
    n = known.count()
    chosen = written(known.filter(share("doc_id", most / max(1, n))))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(small(chosen, min(n, most + most // 4)), "doc_id")
    return rows.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "y")


def minimise(value: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int = 100, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS with halving of the step; value gives (value, gradient)."""
    f, g = value(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, kept = g.copy(), []
        for s, y in reversed(past):
            a = s @ d / (s @ y)
            d -= a * y
            kept.append(a)
        if past:
            s, y = past[-1]
            d *= (s @ y) / (y @ y)
        for (s, y), a in zip(past, reversed(kept), strict=True):
            d += s * (a - y @ d / (s @ y))
        size = 1.0 if past else 1.0 / max(1.0, np.linalg.norm(d))
        for _ in range(30):
            nx = x - size * d
            nf, ng = value(nx)
            if nf <= f - 1e-4 * size * (g @ d):
                break
            size /= 2
        else:
            return x
        s, y = nx - x, ng - g
        if s @ y > 1e-12:
            past = [*past[-memory + 1 :], (s, y)]
        if f - nf <= 1e-7 * (abs(f) + 1e-7):
            return nx
        x, f, g = nx, nf, ng
    return x


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))
