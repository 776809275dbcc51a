"""Approximate nearest neighbours by inner product with randomly rotated one-bit codes.

A vector v, less the centre c of a bounded sample, is scaled to unit length, padded with zeros to LONGER times its length and
turned by a random orthogonal matrix; its code is the sign of each of the D coordinates, packed into 64-bit words. With f the
inner product of the turned vector and its code's direction, <code, q'> / f estimates the inner product with a turned unit
query q', with a deviation near sqrt((1 - f * f) / (f * f * (D - 1))). A query is rounded, at random, to PLANES bits a
coordinate, so that <code, q'> is a sum over bit planes of counts of the bits that code and plane share; what the rounding
adds to the deviation is added to it. So v . q lies within ERRORS such deviations of the estimate. The index keeps code,
|v - c| and f of every row beside the vector.

Queries are taken in blocks of bounded size; each task scans its rows of the index, estimates all from the codes, and ranks
again, on the original vectors, those whose upper bound reaches the k-th best exact score so far. At first that is the k-th
best of the query's products with a bounded sample of rows, which no answer falls short of.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillframe.llm._common import discard, written

ERRORS, LONGER, PLANES, QUERY_BLOCK, FIT_ROWS = 4.0, 4, 4, 4096, 4096
#: Rows and queries that are worked on at a time.
ROWS, QUERIES = 4096, 128
SCHEMA = "at long, vec_id long, raw binary, code binary, radius double, factor double"


def code_bits(dim: int) -> int:
    return -(-LONGER * dim // 64) * 64


def rotation(dim: int, seed: int = 41) -> np.ndarray:
    """The rows of an orthogonal matrix that turn a vector of dim components, padded to code_bits(dim)."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((code_bits(dim), code_bits(dim))))
    return (q * np.sign(np.diag(r)))[:dim]


def codes(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed bits, radius, factor) of each row."""
    apart = vectors - centre
    radius = np.linalg.norm(apart, axis=1)
    turned = (apart / np.where(radius > 0, radius, 1)[:, None]) @ turn
    return np.packbits(turned > 0, axis=1), radius, np.abs(turned).sum(axis=1) / np.sqrt(turn.shape[1])


@dataclass
class Rounded:
    """Turned queries as low + step * (whole number of PLANES bits); planes[p] holds bit p of every coordinate, packed as codes are."""

    low: np.ndarray
    step: np.ndarray
    planes: np.ndarray
    total: np.ndarray  # sums of the rounded coordinates

    @staticmethod
    def of(turned: np.ndarray, seed: int = 43) -> Rounded:
        low = turned.min(axis=1) if turned.size else np.zeros(len(turned))
        step = np.maximum((turned.max(axis=1) - low if turned.size else low) / (2**PLANES - 1), 1e-300)
        whole = np.floor((turned - low[:, None]) / step[:, None] + np.random.default_rng(seed).random(turned.shape)).clip(0, 2**PLANES - 1).astype(np.int64)
        planes = np.stack([np.packbits((whole >> p) & 1 == 1, axis=1).view(np.uint64) for p in range(PLANES)])
        return Rounded(low, step, planes, low * turned.shape[1] + step * whole.sum(axis=1))

    def products(self, words: np.ndarray, ones: np.ndarray, some: slice) -> np.ndarray:
        """<code, q'> of some queries with rows whose codes have these words, and so many bits."""
        shape = len(self.low[some]), len(words)
        shared, both, count, plane = np.zeros(shape, np.float32), np.empty(shape, np.uint64), np.empty(shape, np.uint8), np.empty(shape, np.uint16)
        for p in range(PLANES):
            plane[:] = 0
            for w in range(words.shape[1]):
                np.bitwise_and(self.planes[p, some, w, None], words[None, :, w], out=both)
                plane += np.bitwise_count(both, out=count)
            shared += np.left_shift(plane, p, out=plane) if 2**p * 64 * words.shape[1] < 65536 else plane.astype(np.float32) * 2**p
        root = np.sqrt(64 * words.shape[1])
        shared *= (2 * self.step[some] / root)[:, None].astype(np.float32)
        shared += (2 * self.low[some] / root).astype(np.float32)[:, None] * ones.astype(np.float32)
        shared -= (self.total[some, None] / root).astype(np.float32)
        return shared


def in_order(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows in double precision, added up from the first component to the last."""
    out = np.zeros(len(rows))
    for d in range(rows.shape[1]):
        out += rows[:, d] * q[:, d]
    return out


class Best:
    """The k best (score, vec_id, row) of each query so far, ties to the smaller vec_id and then row; unused places hold a score of -inf."""

    def __init__(self, queries: int, k: int):
        self.scores, self.ids, self.rows = np.full((queries, k), -np.inf), np.zeros((queries, k), np.int64), np.zeros((queries, k), np.int64)

    def least(self, some: slice) -> np.ndarray:
        return self.scores[some, -1]

    def add(self, q: np.ndarray, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Of queries q, repeated as often as they have new rows."""
        touched = np.unique(q)
        k = self.scores.shape[1]
        of = np.concatenate([np.repeat(touched, k), q])
        s, v, r = (np.concatenate([a[touched].ravel(), b]) for a, b in ((self.scores, scores), (self.ids, ids), (self.rows, rows)))
        order = np.lexsort((r, v, -s, of))
        first = np.searchsorted(of[order], touched)
        keep = order[(first[:, None] + np.arange(k)).ravel()]
        for a, b in ((self.scores, s), (self.ids, v), (self.rows, r)):
            a[touched] = b[keep].reshape(-1, k)


@dataclass
class Queries:
    at: np.ndarray
    vectors: np.ndarray
    centred: np.ndarray  # products with the centre
    norms: np.ndarray
    rounded: Rounded
    floor: np.ndarray  # what the k-th best score is at least

    @staticmethod
    def of(at: np.ndarray, vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray, floor: np.ndarray) -> Queries:
        return Queries(at, vectors, vectors @ centre, np.linalg.norm(vectors, axis=1), Rounded.of(vectors @ turn), floor)


def floors(at: np.ndarray, vectors: np.ndarray, sample_at: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """The k-th best product of each query with the rows of a sample but its own, less a margin for rounding; -inf if there are fewer."""
    if len(sample_at) <= k:
        return np.full(len(at), -np.inf)
    products = np.where(at[:, None] == sample_at, -np.inf, vectors @ sample.T)
    least = np.partition(products, len(sample_at) - k, axis=1)[:, len(sample_at) - k]
    return np.where(np.isfinite(least), least - 1e-9 * (1 + np.abs(np.where(np.isfinite(least), least, 0))), -np.inf)


def scan_block(best: Best, queries: Queries, at: np.ndarray, ids: np.ndarray, rows: np.ndarray, bits: np.ndarray, radius: np.ndarray, factor: np.ndarray, errors: float) -> int:
    """Adds what a block of rows has to best; returns how many pairs were ranked again."""
    words, k, again = np.ascontiguousarray(bits).view(np.uint64), best.scores.shape[1], 0
    ones, d = np.bitwise_count(words).sum(axis=1), 64 * words.shape[1]
    factor = np.maximum(factor, 1e-6)
    scale = (radius / factor).astype(np.float32)
    apart = (1 - np.minimum(factor, 1) ** 2) / max(1, d - 1)  # times |q| and so on: variance of the code's error
    for lo in range(0, len(queries.at), QUERIES):
        some = slice(lo, lo + QUERIES)
        estimate = queries.rounded.products(words, ones, some)
        estimate *= scale
        estimate += queries.centred[some, None].astype(np.float32)
        norm, step = queries.norms[some, None].astype(np.float32), queries.rounded.step[some, None].astype(np.float32)
        margin = norm**2 * apart.astype(np.float32)
        margin += step**2 / 4
        np.sqrt(margin, out=margin)
        margin *= scale * np.float32(errors)
        margin += np.float32(1e-4) * norm * (1 + radius.max(initial=0)).astype(np.float32) + np.float32(1e-30)
        least = np.maximum(best.least(some), queries.floor[some])
        fresh = np.flatnonzero(np.isneginf(least))
        if len(fresh) and len(at) > k:
            lower = np.where(queries.at[some][fresh, None] == at, -np.inf, estimate[fresh] - margin[fresh])
            least[fresh] = np.partition(lower, len(at) - k, axis=1)[:, len(at) - k]
        estimate += margin
        q, r = np.divmod(np.flatnonzero(estimate >= least[:, None].astype(np.float32) - np.float32(1e-6) * np.abs(np.where(np.isfinite(least), least, 0))[:, None].astype(np.float32)), len(at))
        other = queries.at[some][q] != at[r]
        q, r = q[other], r[other]
        again += len(q)
        for i in range(0, len(q), 1 << 16):
            a, b = q[i : i + (1 << 16)], r[i : i + (1 << 16)]
            near = np.einsum("ij,ij->i", queries.vectors[some][a], rows[b])
            ok = near >= least[a] - 1e-9 * (1 + np.abs(np.where(np.isfinite(least[a]), least[a], 0)))
            if ok.any():
                a, b = a[ok], b[ok]
                best.add(a + lo, in_order(rows[b], queries.vectors[some][a]), ids[b], at[b])
    return again


def sound_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors (vec_id, embedding) that take part: not null, zero or with null or non-finite components, and not of a null vec_id."""
    raw = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter("vec_id is not null and v is not null")
    return raw.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))


def index(sound: DataFrame, dim: int, n: int, fit_rows: int = FIT_ROWS) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(index table, centre, rotation) over the n sound_vectors() of length dim. The centre is the mean of about fit_rows rows, chosen by hash; every row is indexed."""
    sound = sound.filter(F.size("v") == dim)
    part = sound.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < 1_000_000 * min(1.0, fit_rows / max(1, n)))
    sums = [F.sum(F.get("v", F.lit(d))).alias(f"s{d}") for d in range(dim)]
    mean = part.agg(F.count(F.lit(1)).alias("n"), *sums).first()
    centre = np.array([mean[f"s{d}"] / mean.n for d in range(dim)]) if mean.n else np.zeros(dim)
    turn = rotation(dim)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            rows = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), dim)
            bits, radius, factor = codes(rows, centre, turn)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in rows], pa.binary()), pa.array([b.tobytes() for b in bits], pa.binary()), pa.array(radius), pa.array(factor)], names=["at", "vec_id", "raw", "code", "radius", "factor"])

    return written(sound.select(F.monotonically_increasing_id().alias("at"), "vec_id", "v").mapInArrow(encode, SCHEMA)), centre, turn


def _packed(column: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1) if len(column) else np.empty((0, 1), kind)


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, errors: float = ERRORS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row with a vec_id divisible by every, the k other rows of largest inner product.

    Ranks count from 1, ties go to the smaller vec_id; with fewer than k candidates all are returned. Rows are candidates one
    by one: of rows that repeat a vec_id each has a rank of its own, and as queries each has its own answer, in which the
    others take part. Vectors of one length are compared with each other; one of another length has no product with them.
    Null and zero vectors, those with null or non-finite components, and rows with a null vec_id take no part; a table
    without rows gives none. Other columns are ignored.
    """
    sound = sound_vectors(vectors)
    lengths = sorted((r.d, r["count"]) for r in sound.groupBy(F.size("v").alias("d")).count().collect())
    found = [_nearest(sound, d, n, every, k, errors, query_block) for d, n in lengths or [(1, 0)]]
    out = found[0]
    for other in found[1:]:
        out = out.union(other)
    return out


def _nearest(sound: DataFrame, dim: int, n: int, every: int, k: int, errors: float, query_block: int) -> DataFrame:
    """nearest() among the n vectors of one length."""
    spark = sound.sparkSession
    table, centre, turn = index(sound, dim, n)
    n = max(1, table.count())
    some = table.filter(F.pmod(F.xxhash64("at"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, FIT_ROWS / n))).select("at", "raw").toArrow().combine_chunks()
    sample_at, sample = some.column("at").to_numpy(), _packed(some.column("raw").combine_chunks(), np.float64).reshape(len(some), -1 if len(some) else len(centre))
    asked = table.filter(F.col("vec_id") % every == 0).select("at", "vec_id", "raw")
    blocks = max(1, -(-asked.count() // query_block))
    parts = []
    for block in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("at"), F.lit(blocks)) == block).orderBy("at").toArrow().combine_chunks()
        at, rows = own.column("at").to_numpy(), _packed(own.column("raw").combine_chunks(), np.float64).reshape(len(own), -1 if len(own) else len(centre))
        sent = spark.sparkContext.broadcast((at, own.column("vec_id").to_numpy(), rows, floors(at, rows, sample_at, sample, k)))

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            at_q, ids_q, rows_q, floor = sent.value
            queries, best = Queries.of(at_q, rows_q, centre, turn, floor), Best(len(at_q), k)
            for batch in batches:
                for lo in range(0, len(batch), ROWS):
                    b = batch.slice(lo, ROWS)
                    scan_block(best, queries, b.column(0).to_numpy(), b.column(1).to_numpy(), _packed(b.column(2), np.float64), _packed(b.column(3), np.uint8), b.column(4).to_numpy(), b.column(5).to_numpy(), errors)
            q, place = np.nonzero(np.isfinite(best.scores))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at_q[q], ids_q[q], best.ids[q, place], best.rows[q, place], best.scores[q, place])], names=["of", "query_id", "vec_id", "at", "score"])

        found = table.mapInArrow(scan, "of long, query_id long, vec_id long, at long, score double")
        rank = F.row_number().over(Window.partitionBy("of").orderBy(F.desc("score"), "vec_id", "at"))
        parts.append(written(found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")))
    discard(table)
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
