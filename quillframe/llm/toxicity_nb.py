"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are which n-grams (of lower-cased UTF-8, white space as one kind) it has. Over the labelled sample, each
n-gram's ratio is the log of its smoothed share of toxic documents over its share of the others; every n-gram of the sample
is a feature, by its 64-bit hash. A logistic regression learns weights of the features times their ratios. Counting runs on
the executors; counts and the sample's features, both bounded by the sample, reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm._bytes import CHUNK, buffers, row_chunks
from quillframe.llm._common import discard, held_out, written
from quillframe.llm._fit import labelled, minimise, sigmoid

#: The fit uses about FIT_ROWS labelled documents, and STEPS steps at most.
FIT_ROWS, PARTS, GRAMS, SMOOTH, RIDGE, STEPS, CUT = 3_000, 8, (4, 5), 1.0, 1e-4, 60, 0.5
FOLDS, FOLD = 5, 0

_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32
_FOLD += 1


def grams(b: np.ndarray) -> np.ndarray:
    """Hashes of all n-grams of one text's bytes."""
    x = _FOLD[b]
    out = []
    for n in GRAMS:
        m = len(x) - n + 1
        if m > 0:
            h = np.full(m, n, np.uint64)
            for j in range(n):
                h = h * np.uint64(0x100000001B3) + x[j : j + m]
            out.append(h)
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def text_grams(column: pa.Array) -> Iterator[np.ndarray]:
    """The distinct n-grams of each text, in order of hashes; null counts as empty. A long text is read in overlapping pieces."""
    data, offsets = buffers(column)
    for lo, hi in row_chunks(offsets):
        for i in range(lo, hi):
            parts = [np.unique(grams(data[at : min(int(offsets[i + 1]), at + CHUNK + max(GRAMS) - 1)])) for at in range(int(offsets[i]), int(offsets[i + 1]), CHUNK)]
            yield np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0] if parts else np.empty(0, np.uint64)


@dataclass
class Model:
    known: np.ndarray  # hashes of the features, in order
    weights: np.ndarray
    bias: float

    def numbers(self, found: np.ndarray) -> np.ndarray:
        """The numbers of the features among these hashes."""
        if not len(self.known):
            return np.empty(0, np.int32)
        at = np.minimum(np.searchsorted(self.known, found), len(self.known) - 1).astype(np.int32)
        return at[self.known[at] == found]

    def score(self, found: np.ndarray) -> float:
        return float(sigmoid(np.float64(self.weights[self.numbers(found)].sum() + self.bias)))


def ratios(toxic: np.ndarray, other: np.ndarray, n_toxic: int, n_other: int) -> np.ndarray:
    """Log-count ratio of each n-gram."""
    return np.log((toxic + SMOOTH) / (n_toxic + 2 * SMOOTH)) - np.log((other + SMOOTH) / (n_other + 2 * SMOOTH))


def fit(xs: list[np.ndarray], y: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, float]:
    """(weights times scale, bias) of a logistic regression with a ridge, from each row's feature numbers."""
    flat, lengths = np.concatenate(xs), np.array([len(x) for x in xs])
    some = np.flatnonzero(lengths)
    starts = np.append(0, np.cumsum(lengths[some])[:-1])

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        m = np.full(len(xs), w[-1])
        if len(some):
            m[some] += np.add.reduceat((w[:-1] * scale)[flat], starts)
        off = sigmoid(m) - y
        grad = np.append(np.bincount(flat, np.repeat(off, lengths), minlength=len(scale)) * scale, off.sum()) / len(y)
        reg = np.append(w[:-1], 0)
        return float(np.mean(np.logaddexp(0, m) - y * m)) + RIDGE * (reg @ reg), grad + 2 * RIDGE * reg

    w = minimise(loss, np.append(np.zeros(len(scale)), np.log(y.sum() / max(1.0, len(y) - y.sum()))), steps=STEPS)
    return w[:-1] * scale, float(w[-1])


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Without documents of both labels the model has no features, and its score is the smoothed share of toxic ones."""
    sample = labelled(docs, labels, "toxic", fit_rows, FOLDS, FOLD).select("doc_id", "y", F.col("text").cast("string").alias("text"))
    sample = written(sample.repartition(PARTS))  # a bounded sample, read twice

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [[], []], [0, 0]
        for batch in batches:
            for y, g in zip(batch.column(1).to_pylist(), text_grams(batch.column(2)), strict=True):
                held[y].append(g)
                rows[y] += 1
        for y in (0, 1):
            gram, n = np.unique(np.concatenate([*held[y], np.empty(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), y, np.int32)), pa.array(gram.view(np.int64)), pa.array(n)], names=["y", "gram", "n"])
            yield pa.RecordBatch.from_arrays([pa.array([y + 2], pa.int32()), pa.array([0], pa.int64()), pa.array([rows[y]], pa.int64())], names=["y", "gram", "n"])

    seen = sample.mapInArrow(count, "y int, gram long, n long").groupBy("gram").agg(*(F.sum(F.when(F.col("y") == i, F.col("n")).otherwise(0)).alias(f"n{i}") for i in range(4)))
    counts = seen.toArrow().combine_chunks()
    n = [counts.column(f"n{i}").to_numpy() for i in range(4)]
    rows = int(n[2].sum()), int(n[3].sum())
    if not all(rows):
        return Model(np.empty(0, np.uint64), np.zeros(0), float(np.log((rows[1] + SMOOTH) / (rows[0] + SMOOTH))))
    known, real = counts.column("gram").to_numpy().view(np.uint64), n[0] + n[1] > 0
    order = np.flatnonzero(real)[np.argsort(known[real])]
    scale = ratios(n[1][order], n[0][order], rows[1], rows[0])
    model = Model(known[order], scale, 0.0)
    del counts, n, seen
    sent = docs.sparkSession.sparkContext.broadcast(model.known)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(sent.value, np.zeros(0), 0.0)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([own.numbers(g).tobytes() for g in text_grams(batch.column(2))], pa.binary())], names=["doc_id", "y", "x"])

    got = sample.mapInArrow(collect, "doc_id long, y int, x binary").toArrow().sort_by([("doc_id", "ascending"), ("x", "ascending")])
    sent.unpersist()
    discard(sample)
    model.weights, model.bias = fit([np.frombuffer(b, np.int32) for b in got.column("x").to_pylist()], got.column("y").to_numpy().astype(float), scale)
    model.weights = model.weights.astype(np.float32)
    return model


def rate(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs (doc_id, text); labels (doc_id, toxic).

    Scores depend on the text alone, read whole at any length. Null and empty texts have no features and get the bias;
    labels that are null or neither 0 nor 1 are ignored; repeated rows are scored alike and all returned; a null doc_id is
    not held out and never learned from; without labels of both kinds every text gets the smoothed share of toxic ones;
    docs without rows give none. Other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, fit_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.value.score(g) for g in text_grams(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id", FOLDS, FOLD).alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))
