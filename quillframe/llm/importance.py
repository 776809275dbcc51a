"""Importance resampling towards a target distribution of hashed word n-grams.

Each task reads its texts into a trie of words: a node below the root stands for a word, a node below that for a pair of
consecutive words, and each holds its feature's count and the state of the CRC over its bytes, so a pair's CRC goes on from
its first word's. When a trie has MOST_NODES nodes its counts go to the task's bucket totals and a new trie begins, so
memory is bounded however many words a task meets. Tasks give one row a bucket at most; these are summed over documents and
over target texts, and the BUCKETS totals make each bucket's gain. Then texts are read once more: their words walk a trie
whose nodes hold gains, and a document's weight is the mean over its steps.

Ranks need no task that sees all rows: scored rows, slim and written once, are sorted into ranges by score, doc_id and the
row's number, and a row's rank is its place in its range after all rows of earlier ranges, of which only counts by range
reach the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm._bytes import row_chunks
from quillframe.llm._common import scratch, small, written

BUCKETS, SCALE, SEED = 10_000, 1000, 7
LEAST_WORDS, PERCENT = 20, 25
#: What separates words, once A-Z are lower case.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Nodes of a trie, and bytes of texts whose words are looked up at a time.
MOST_NODES, CHUNK = 400_000, 1 << 20


class Trie:
    """Words and pairs of consecutive words. Nodes are numbers, in order of arrival; arrays hold what belongs to them."""

    def __init__(self, buckets: int = BUCKETS):
        self.buckets = buckets
        self.words: dict[str, int] = {}  # below the root
        self.pairs: dict[int, int] = {}  # below a word: first word << 32 | second word
        self.state: list[int] = []  # of words: the CRC so far
        self.tail: list[bytes] = []  # of words: what they add to a pair
        self.word_buckets: list[int] = []
        self.pair_buckets: list[int] = []

    def __len__(self) -> int:
        return len(self.words) + len(self.pairs)

    def steps(self, words: pa.Array, follows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The word nodes of words, and the pair nodes of those that follow the word before in their text; new nodes are added."""
        coded = words.dictionary_encode()
        local = np.fromiter(map(self._word, coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        node = local[coded.indices.to_numpy()]
        at = np.flatnonzero(follows)
        keys, inverse = np.unique(node[at - 1] << 32 | node[at], return_inverse=True)
        pair = np.fromiter(map(self._pair, keys.tolist()), np.int64, len(keys))
        return node, pair[inverse]

    def _word(self, word: str) -> int:
        n = self.words.get(word)
        if n is None:
            n = self.words[word] = len(self.words)
            b = word.encode()
            self.state.append(zlib.crc32(b))
            self.tail.append(b" " + b)
            self.word_buckets.append(self.state[-1] % self.buckets)
        return n

    def _pair(self, key: int) -> int:
        n = self.pairs.get(key)
        if n is None:
            n = self.pairs[key] = len(self.pairs)
            self.pair_buckets.append(zlib.crc32(self.tail[key & 0xFFFFFFFF], self.state[key >> 32]) % self.buckets)
        return n


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, one after another, and the text that each is of; nulls have none."""
    lists = pc.split_pattern_regex(pc.ascii_lower(texts.fill_null("")), GAPS)
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    words = lists.flatten()
    some = pc.not_equal(words, "")
    return words.filter(some), row[some.to_numpy(zero_copy_only=False)]


def _chunks(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of at most CHUNK bytes together; a longer text comes alone."""
    texts = texts.cast(pa.large_string())
    offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())])
    for lo, hi in row_chunks(offsets, CHUNK):
        yield lo, texts.slice(lo, hi - lo)


def _totals(buckets: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, trie = np.zeros(buckets, np.int64), Trie(buckets)
        word_counts, pair_counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def flush() -> None:
            for counts, of in ((word_counts, trie.word_buckets), (pair_counts, trie.pair_buckets)):
                np.add.at(totals, np.array(of, np.int64), counts)

        for batch in batches:
            for _, texts in _chunks(batch.column(0)):
                words, row = words_of(texts)
                if not len(words):
                    continue
                node, pair = trie.steps(words, np.concatenate([[False], row[1:] == row[:-1]]))
                word_counts = _added(word_counts, node, len(trie.words))
                pair_counts = _added(pair_counts, pair, len(trie.pairs))
                if len(trie) > most:
                    flush()
                    trie, word_counts, pair_counts = Trie(buckets), word_counts[:0], pair_counts[:0]
        flush()
        some = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(totals[some])], names=["bucket", "n"])

    return run


def _added(counts: np.ndarray, nodes: np.ndarray, n: int) -> np.ndarray:
    out = np.bincount(nodes, minlength=n)
    out[: len(counts)] += counts
    return out


def bucket_totals(texts: DataFrame, buckets: int = BUCKETS, most: int = MOST_NODES) -> np.ndarray:
    """How many features of texts(text) each bucket has."""
    rows = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(_totals(buckets, most), "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row a bucket
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket, a thousand times the log of its smoothed share of the target over that of the source, floored."""
    s, t, n = source.astype(float), target.astype(float), float(len(source))
    return np.floor(SCALE * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def _weights(gained, buckets: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain, trie = gained.value, Trie(buckets)
        word_gains, pair_gains = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            n, total = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for lo, texts in _chunks(batch.column(1)):
                words, row = words_of(texts)
                if not len(words):
                    continue
                follows = np.concatenate([[False], row[1:] == row[:-1]])
                node, pair = trie.steps(words, follows)
                word_gains = np.append(word_gains, gain[trie.word_buckets[len(word_gains) :]])
                pair_gains = np.append(pair_gains, gain[trie.pair_buckets[len(pair_gains) :]])
                for of, g in ((row, word_gains[node]), (row[follows], pair_gains[pair])):
                    np.add.at(total, lo + of, g)
                    n[lo : lo + len(texts)] += np.bincount(of, minlength=len(texts))
                if len(trie) > most:
                    trie, word_gains, pair_gains = Trie(buckets), word_gains[:0], pair_gains[:0]
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(weight)], names=["row", "n_features", "weight"])

    return run


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, floored, from a hash of the seed and the doc_id; a null doc_id counts as an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """The slim written table rows with rank, from 1, by order (which leaves no ties), as a written table."""
    placed = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    counts = [(r.part, r.n) for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()]  # a row a range
    starts, before = [], 0
    for p, n in sorted(counts):
        starts.append((p, before))
        before += n
    there = small(rows.sparkSession.createDataFrame(starts, "part long, before long"), len(starts))
    return placed.join(there, part == F.col("part")).withColumn("rank", F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1) + 1).drop("place", "part", "before")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS, most_nodes: int = MOST_NODES) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of each row of docs (doc_id, text): its features, their mean gain towards target (text), the gain with noise, and its place among the drawn rows.

    Of the rows with least_words words, percent in a hundred are drawn, those of the highest scores; others have a null
    rank. Null and empty texts have no features and weight 0, and are not drawn. Equal scores go by doc_id, null last, and
    rows with one doc_id by the order of the table; each row stands for itself, so repeated rows may all be drawn. A null
    doc_id has the noise of an empty one. Without target texts the target is even over the buckets. Without documents there are no rows. Texts of any length are read whole, other columns are
    ignored.
    """
    with scratch() as keep:
        gained = docs.sparkSession.sparkContext.broadcast(gains(bucket_totals(docs, buckets, most_nodes), bucket_totals(target, buckets, most_nodes)))
        rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), F.col("text").cast("string").alias("text"))
        rows = rows.select(F.struct("row", "doc_id").alias("row"), "text").mapInArrow(_weights(gained, buckets, most_nodes), f"row struct<row:long,doc_id:{docs.schema['doc_id'].dataType.simpleString()}>, n_features long, weight long")
        scored = written(rows.select("row.*", "n_features", "weight", (F.col("weight") + noise(F.col("row.doc_id"), seed)).alias("score")).withColumn("able", (F.col("n_features") + 1) / 2 >= least_words))
        drawn = scored.filter("able").count() * percent // 100
        out = keep(written(ranked(scored, [F.desc("able"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")])))
    return out.select("doc_id", "n_features", "weight", "score", F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
