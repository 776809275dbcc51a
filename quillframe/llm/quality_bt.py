"""Document quality by a Bradley-Terry ranking.

Features describe the whole text: shares of kinds of characters, words' lengths and how often words and word sequences
repeat. Preference pairs set a document labelled 1 over one labelled 0; a linear score is learned by logistic loss on the
difference of their features. The threshold is the quantile of the labelled documents' scores that separates the labels
best (halfway between the scores beside it), and the score is mapped so that the threshold becomes CUT.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm._bytes import buffers, mix, pieces, row_chunks, spaces_split, CHUNK
from quillframe.llm._common import held_out, kept_by
from quillframe.llm._fit import labelled, minimise, sigmoid

#: The fit uses about FIT_ROWS labelled documents and PAIRS pairs of them.
FIT_ROWS, PAIRS, RIDGE, CUT = 12_000, 40_000, 1e-3, 0.3
FOLDS, FOLD = 5, 0
_SINGLE = b"!%$#&*|.,:;-=\"'()/@_<>?~^+[]{}\\"


def _kinds() -> np.ndarray:
    """Byte values by kind of character: columns of 0 and 1."""
    out = np.zeros((256, 7 + len(_SINGLE)))
    for j, (lo, hi) in enumerate(((65, 91), (97, 123), (48, 58), (32, 33), (10, 11), (128, 256), (0, 10))):
        out[lo:hi, j] = 1
    for j, c in enumerate(_SINGLE, 7):
        out[c, j] = 1
    return out


_KINDS = _kinds()


def _features(counts: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Of one text's byte counts and word hashes."""
    n, w = max(1, counts.sum()), len(h)
    shares = counts @ _KINDS / n
    same = np.mean(h[1:] == h[:-1]) if w > 1 else 0.0
    skip = np.mean(h[2:] == h[:-2]) if w > 2 else 0.0
    kinds = len(np.unique(h)) / w if w else 1.0
    three = mix(h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(5) + h[2:] * np.uint64(7)) if w > 2 else h
    again = 1 - len(np.unique(three)) / len(three) if len(three) else 0.0
    length = (n - counts[[32, 10, 9, 13]].sum()) / max(1, w)
    case = shares[0] / max(1e-9, shares[0] + shares[1])
    dense = np.array([same, skip, again, 1 - kinds, case])
    return np.concatenate([np.log1p(50 * shares), dense, np.log1p(20 * dense), [np.log1p(w) / 10, length / 10, min(length, 40) ** 2 / 400, np.log1p(w) * (1 - kinds) / 10]])


N_FEATURES = len(_features(np.zeros(256), np.empty(0, np.uint64)))


def features(column: pa.Array) -> Iterator[np.ndarray]:
    """A feature row for each text; null counts as empty. Long texts are read in pieces."""
    words = spaces_split()
    data, offsets = buffers(column)
    for lo, hi in row_chunks(offsets):
        b, off = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        if hi == lo + 1 and len(b) > CHUNK:
            h = np.concatenate([words.hashes(p, np.array([0, len(p)]))[0] for p in pieces(b, words.is_word)])
            first = np.array([0, len(h)])
        else:
            h, _, first = words.hashes(b, off)
        for i in range(hi - lo):
            yield _features(np.bincount(b[off[i] : off[i + 1]], minlength=256), h[first[i] : first[i + 1]])


@dataclass
class Ranking:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return (np.clip((x - self.mean) / self.scale, -8, 8) * self.weights).sum(axis=1)  # unlike a product of matrices, alike for equal rows wherever they stand

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.strength(x) - self.threshold + np.log(CUT / (1 - CUT)))

    def scores(self, texts: pa.Array) -> np.ndarray:
        return self.score(np.array(list(features(texts))).reshape(-1, N_FEATURES))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = 61) -> Ranking:
    """Without documents of both labels all texts get one strength, above the threshold."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Ranking(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), -1.0)
    model = Ranking(x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3), np.zeros(N_FEATURES), 0.0)
    z = np.clip((x - model.mean) / model.scale, -8, 8)
    rng = np.random.default_rng(seed)
    each = max(pairs, len(good), len(bad))
    a, b = (np.concatenate([rng.permutation(g) for _ in range(-(-each // len(g)))])[:each] for g in (good, bad))

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        total, grad = 0.0, np.zeros_like(w)
        for lo in range(0, each, 4096):
            d = z[a[lo : lo + 4096]] - z[b[lo : lo + 4096]]
            m = d @ w
            total += np.logaddexp(0, -m).sum()
            grad -= sigmoid(-m) @ d
        return total / each + RIDGE * (w @ w), grad / each + 2 * RIDGE * w

    model.weights = minimise(loss, model.weights)
    s = model.strength(x)
    order = np.argsort(s, kind="stable")
    # balanced errors of each quantile: good documents below, bad ones at or above
    lost, left = np.cumsum(y[order] == 1) / len(good), 1 - np.cumsum(y[order] == 0) / len(bad)
    q = int(np.argmin(lost + left))
    model.threshold = float((s[order[q]] + s[order[min(q + 1, len(s) - 1)]]) / 2)
    return model


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Ranking:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f.tobytes() for f in features(batch.column(2))], pa.binary())], names=["doc_id", "y", "x"])

    sample = labelled(docs, labels, "quality", fit_rows, FOLDS, FOLD).select("doc_id", "y", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, y int, x binary").toArrow().sort_by("doc_id")
    x = np.frombuffer(b"".join(sample.column("x").to_pylist()), np.float64).reshape(-1, N_FEATURES)
    return fit(x, sample.column("y").to_numpy())


def rate(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, ranking: Ranking | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs (doc_id, text); labels (doc_id, quality).

    Scores depend on the text alone, read whole at any length. Null and empty texts are scored as texts without characters;
    labels that are null or neither 0 nor 1 are ignored; repeated rows are scored alike and all returned; a null doc_id is
    not held out and never learned from. Without labels of both kinds every score is above CUT; docs without rows give
    none. Other columns are ignored. ranking: a model to use instead of one learned here.
    """
    model = docs.sparkSession.sparkContext.broadcast(ranking or learn(docs, labels, fit_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value.scores(batch.column(1)))], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id", FOLDS, FOLD).alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows whose text is rejected.

    Each row is judged by its own text, whatever its doc_id, which may be null or shared; null and empty texts are scored as
    texts without characters; repeats of a row share its fate. Labels are learned by doc_id. A table without rows gives
    none. Columns stay as they are.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))
    return kept_by(docs, lambda texts: model.value.scores(texts) >= CUT)
