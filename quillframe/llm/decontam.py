"""Benchmark decontamination: BM25 over an inverted index of the test items, searched with block-max WAND.

Every window of a document's words is a query. Impacts are BM25 contributions divided by the score that the item gets
from its own text, so one threshold fits all items: a window retrieves an item if it scores at least THRESHOLD of that.
WAND's upper bounds work at three levels, each exact. Common words are chosen so that no item gets more than COMMON of its
score from them; so a window retrieves nothing if the largest impacts of its other words add up to less than the rest of
the threshold (one running sum over the document). Nor does, for the windows left, a block of items in which the words'
largest block impacts add up to less than the threshold; within the blocks left, items are scored in full. The windows of
many documents go through each level together, so terms are added up in bulk where WAND would move a pivot: the same blocks
are skipped. What is retrieved is verified on the document's words around the window: at least Q_OVERLAP of the question's and A_OVERLAP of the answer's
five-word runs (the whole, if it has fewer words) must stand there. The answer is what follows the last "answer:" of an
item; an item without that is verified as a whole, as question and answer both.

Items are indexed by length class, with windows twice as long as the class's longest item at every such length, so that
every copy of an item lies within some window. The windows of many documents are searched at once, in array operations. An index is built on the driver from one block of about ITEMS_A_PASS items at most, and that
is what executors get; more items take more passes over the documents. Document frequencies and the mean length are those
of all distinct items in any case.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm._bytes import alnum_split, mix, seeds, word_rows
from quillframe.llm._common import discard, kept_by, numbered, small, written

K1, B, THRESHOLD, COMMON, Q_OVERLAP, A_OVERLAP = 1.2, 0.75, 0.5, 0.25, 0.6, 0.6
SHORTEST, BLOCK, RUN = 64, 16, 5
#: Postings of blocks that are added up at a time.
CELLS = 200_000
ITEMS_A_PASS, ITEM_BYTES_A_PASS = 20_000, 32_000_000


@dataclass
class Index:
    """Postings of the items of one length class. Words are numbers into vocabulary, items numbers into ids."""

    ids: list[int]
    window: int
    vocabulary: np.ndarray
    most: np.ndarray  # largest impact of each word, 0 for common ones
    common: float  # the most that any item gets from common words
    starts: np.ndarray  # postings of word t are starts[t]:starts[t + 1] of items and impacts
    items: np.ndarray
    impacts: np.ndarray
    block_starts: np.ndarray  # the same for blocks of BLOCK items and the largest impact in each
    blocks: np.ndarray
    block_most: np.ndarray
    halves: list[tuple[tuple[int, np.ndarray], tuple[int, np.ndarray]]]  # question and answer: words in a run, hashes of the runs


def split_answer(text: str) -> tuple[str, str]:
    """(question, answer): before and after the last "answer:"; without one both are the whole text."""
    marks = list(re.finditer(r"(?i)\banswer\s*:", text))
    return (text[: marks[-1].start()], text[marks[-1].end() :]) if marks else (text, text)


def word_hashes(text: str) -> np.ndarray:
    b = np.frombuffer(text.encode(), np.uint8)
    return alnum_split().hashes(b, np.array([0, len(b)]))[0]


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    if n < 1 or len(h) < n:
        return np.empty(0, np.uint64)
    m, mul = len(h) - n + 1, seeds(RUN, 31)
    out = np.full(m, n, np.uint64)
    for j in range(n):
        out = out + h[j : j + m] * mul[j]
    return mix(out)


def length_class(words: int) -> int:
    """The least SHORTEST * 4 ** i that the words fit."""
    out = SHORTEST
    while out < words:
        out *= 4
    return out


def build(items: list[tuple[int, str]], df: dict[int, int], n_items: int, mean_words: float) -> list[Index]:
    """An index for each length class of items (id, text); df, n_items and mean_words are of the whole collection."""
    classes: dict[int, list[tuple[int, str, np.ndarray]]] = {}
    for i, text in items:
        h = word_hashes(text)
        if len(h):
            classes.setdefault(length_class(len(h)), []).append((i, text, h))
    return [_build(x, 2 * size, df, n_items, mean_words) for size, x in sorted(classes.items())]


def _build(items: list[tuple[int, str, np.ndarray]], window: int, df: dict[int, int], n_items: int, mean_words: float) -> Index:
    counted = [np.unique(h, return_counts=True) for _, _, h in items]
    vocabulary, word = np.unique(np.concatenate([u for u, _ in counted]), return_inverse=True)
    item = np.repeat(np.arange(len(items)), [len(u) for u, _ in counted])
    tf, length = np.concatenate([c for _, c in counted]), np.array([len(h) for _, _, h in items])[item]
    seen = np.array([df[int(w)] for w in vocabulary])
    idf = np.log(1 + (n_items - seen + 0.5) / (seen + 0.5))
    impact = idf[word] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / max(mean_words, 1e-9)))
    impact = impact / np.bincount(item, impact)[item]
    order = np.lexsort((item, word))
    item, impact, word = item[order], impact[order], word[order]
    bounds = np.arange(len(vocabulary) + 1)
    key, group = np.unique(word * (len(items) + 1) + item // BLOCK, return_inverse=True)
    block_most = np.zeros(len(key))
    np.maximum.at(block_most, group, impact)
    most = np.zeros(len(vocabulary))
    np.maximum.at(most, word, impact)
    got, common = np.zeros(len(items)), np.zeros(len(vocabulary), bool)
    starts = np.searchsorted(word, bounds)
    for w in np.argsort(-np.diff(starts), kind="stable"):
        of = slice(starts[w], starts[w + 1])
        if (got[item[of]] + impact[of]).max() <= COMMON:
            got[item[of]] += impact[of]
            common[w] = True
    most[common] = 0
    part = lambda text: (min(RUN, len(h := word_hashes(text))), np.unique(runs(h, min(RUN, len(h)))))
    halves = [tuple(map(part, split_answer(text))) for _, text, _ in items]
    return Index([i for i, _, _ in items], window, vocabulary, most, float(got.max()), starts, item, impact, np.searchsorted(key // (len(items) + 1), bounds), key % (len(items) + 1), block_most, halves)


def _slices(starts: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Positions of the postings of these words, one after another."""
    lengths = starts[terms + 1] - starts[terms]
    return np.arange(lengths.sum()) + np.repeat(starts[terms] - np.append(0, np.cumsum(lengths)[:-1]), lengths)


def search(index: Index, h: np.ndarray, first: np.ndarray, threshold: float = THRESHOLD) -> Iterator[tuple[int, int, int, float]]:
    """(row, item number, first word, score) of each window that retrieves an item, over rows of words h[first[i]:first[i + 1]]; windows of a row in order."""
    least, stride, n_items, n_words = threshold - 1e-9, index.window // 2, len(index.ids), len(index.vocabulary)
    lengths = np.diff(first)
    per_row = np.where(lengths > 0, np.maximum(1, -(-(lengths - stride) // stride)), 0)
    from_row = np.concatenate([[0], np.cumsum(per_row)])
    row_of = np.repeat(np.arange(len(lengths)), per_row)
    lows = first[row_of] + stride * (np.arange(from_row[-1]) - from_row[row_of])
    if not len(lows):
        return
    at = np.minimum(np.searchsorted(index.vocabulary, h), n_words - 1)
    known = index.vocabulary[at] == h
    running = np.concatenate([[0.0], np.cumsum(np.where(known, index.most[at], 0.0))])
    open_ = running[np.minimum(lows + index.window, first[row_of + 1])] - running[lows] >= least - index.common
    place = np.flatnonzero(known)
    row = np.searchsorted(first, place, "right") - 1
    last = (place - first[row]) // stride
    pairs = []
    for k in (last - 1, last):  # a word stands in the two windows that begin at most one window before it
        ok = (k >= 0) & (k < per_row[row])
        window = from_row[row[ok]] + k[ok]
        live = open_[window]
        pairs.append(window[live] * n_words + at[place[ok][live]])
    window, word = np.divmod(np.unique(np.concatenate(pairs)), n_words)
    # pieces of whole windows, of CELLS block postings at most unless one window has more
    work = np.cumsum(index.block_starts[word + 1] - index.block_starts[word])
    lo = 0
    while lo < len(window):
        hi = max(lo + 1, int(np.searchsorted(work, (work[lo - 1] if lo else 0) + CELLS, "right")))
        hi = int(np.searchsorted(window, window[hi], "left")) if hi < len(window) else hi
        if hi <= lo:
            hi = int(np.searchsorted(window, window[lo], "right"))
        yield from _score(index, window[lo:hi], word[lo:hi], least, row_of, lows, n_items)
        lo = hi


def _score(index: Index, window: np.ndarray, word: np.ndarray, least: float, row_of: np.ndarray, lows: np.ndarray, n_items: int) -> Iterator[tuple[int, int, int, float]]:
    """Blocks by their upper bounds, then the items of the blocks left, for (window, word) pairs in order of windows. Only blocks and items that share a word with a window take memory."""
    names, number = np.unique(window, return_inverse=True)
    n_blocks = n_items // BLOCK + 1
    cell = np.repeat(number, index.block_starts[word + 1] - index.block_starts[word]) * n_blocks + index.blocks[at := _slices(index.block_starts, word)]
    cells, inverse = np.unique(cell, return_inverse=True)
    alive = cells[np.bincount(inverse, index.block_most[at], minlength=len(cells)) >= least]
    if not len(alive):
        return
    live = np.isin(number, alive // n_blocks)
    word, number = word[live], number[live]
    of = _slices(index.starts, word)
    many = np.repeat(number, index.starts[word + 1] - index.starts[word])
    ok = np.isin(many * n_blocks + index.items[of] // BLOCK, alive)
    key, inverse = np.unique(many[ok] * n_items + index.items[of][ok], return_inverse=True)
    score = np.bincount(inverse, index.impacts[of][ok], minlength=len(key))
    for i in np.flatnonzero(score >= least):
        w, item = divmod(int(key[i]), n_items)
        yield int(row_of[names[w]]), item, int(lows[names[w]]), float(score[i])


def held(index: Index, h: np.ndarray, first: np.ndarray, threshold: float = THRESHOLD, question: float = Q_OVERLAP, answer: float = A_OVERLAP) -> list[tuple[int, int, float, float, float, int]]:
    """(row, item id, score, question overlap, answer overlap, first word of the window) of each item that a row of words holds, from its best verified window."""
    best: dict[tuple[int, int], tuple[float, float, float, int]] = {}
    for row, item, low, score in search(index, h, first, threshold):
        if (row, item) in best and best[row, item][0] >= score:
            continue
        around = h[max(first[row], low - index.window) : min(first[row + 1], low + 2 * index.window)]
        oq, oa = (float(np.isin(part, runs(around, n)).mean()) if n else 1.0 for n, part in index.halves[item])
        if oq >= question and oa >= answer:
            best[row, item] = (score, oq, oa, low - int(first[row]))
    return [(row, index.ids[item], *v) for (row, item), v in sorted(best.items())]


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = alnum_split()
    for batch in batches:
        parts = batch.column(0).to_pylist()
        for lo, first, h in word_rows(batch.column(1), words):
            for i in range(len(first) - 1):
                u = np.unique(h[first[i] : first[i + 1]])
                yield pa.RecordBatch.from_arrays([pa.array([parts[lo + i]] * len(u), pa.int32()), pa.array(u.view(np.int64)), pa.array([int(first[i + 1] - first[i]), *[0] * (len(u) - 1)][: len(u)], pa.int64())], names=["part", "word", "words"])


def _distinct(items: DataFrame) -> DataFrame:
    """(key, text) of the distinct texts of items with an id, as a written table: an item that repeats is indexed once."""
    texts = items.filter("item_id is not null and text is not null").select(F.col("text").cast("string").alias("text")).distinct()
    return numbered(texts, "key")


def _indexes(texts: DataFrame) -> Iterator:
    """Broadcast indexes of texts (key, text), one block of them at a time."""
    spark = texts.sparkSession
    size = texts.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    passes = max(1, -(-size.n // ITEMS_A_PASS), -(-size.b // ITEM_BYTES_A_PASS))
    dealt = texts.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(passes)).cast("int"))
    words = dealt.select("part", "text").mapInArrow(_item_words, "part int, word long, words long")
    stats = written(words.groupBy("word").agg(F.count(F.lit(1)).alias("df"), F.collect_set("part").alias("parts"), F.sum("words").alias("words")))
    mean = (stats.agg(F.sum("words")).first()[0] or 0) / max(1, size.n)
    for part in range(passes):
        df = {r.word % 2**64: r.df for r in stats.filter(F.array_contains("parts", part)).select("word", "df").toLocalIterator()}
        block = [(r.key, r.text) for r in dealt.filter(F.col("part") == part).select("key", "text").collect()]
        yield spark.sparkContext.broadcast(build(sorted(block), df, size.n, mean))
    discard(stats)


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, question: float = Q_OVERLAP, answer: float = A_OVERLAP) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, word) of each row of docs (doc_id, text) and each test item (item_id, text) that it holds; word is where the best window begins.

    Null and empty texts hold nothing and are held by nothing, as are items without an id; items that repeat, or share an
    id, give a row each. A document that repeats gives rows for each of its rows; a null doc_id is returned as it is. Of
    windows that score alike the first counts. Texts of any length are searched whole. Without items or documents there are
    no rows. Other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, key long, score double, question_overlap double, answer_overlap double, word long"
    distinct, out = _distinct(items), None
    for i, index in enumerate(_indexes(distinct)):
        found = texts.mapInArrow(_finder(index, threshold, question, answer), schema)
        out = out.union(found) if i else found
    own = items.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    ids = written(own.join(distinct, "text").select("key", "item_id"))
    return out.join(small(ids, ids.count()), "key").select("doc_id", "item_id", "score", "question_overlap", "answer_overlap", "word")


def _finder(index, threshold: float, question: float, answer: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = alnum_split()
        for batch in batches:
            rows = []
            ids = batch.column(0)
            for lo, first, h in word_rows(batch.column(1), words):
                for part in index.value:
                    rows += [(ids[lo + i].as_py(), *x) for i, *x in held(part, h, first, threshold, question, answer)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "key", "score", "question_overlap", "answer_overlap", "word"])

    return run


def without_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the rows whose text holds a test item.

    Each row is judged by its own text, whatever its doc_id, which may be null or shared; null and empty texts hold nothing
    and stay, and so does everything if there are no items. A table without rows gives none. Columns stay as they are.
    """
    out = docs
    for i, index in enumerate(_indexes(_distinct(items))):
        out = kept_by(written(out) if i else out, _clean(index))
    return out


def _clean(index) -> Callable[[pa.Array], np.ndarray]:
    def passes(texts: pa.Array) -> np.ndarray:
        ok = np.ones(len(texts), bool)
        for lo, first, h in word_rows(texts, alnum_split()):
            for part in index.value:
                ok[[lo + row for row, *_ in held(part, h, first)]] = False
        return ok

    return passes
