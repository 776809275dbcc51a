"""Languages of mixed text: word scores under script candidates, and Viterbi with a switching penalty.

Words are runs of ASCII letters and non-ASCII bytes. A word's script, from the range of its first character, leaves the
languages that write in it; its score in each is the sum of log shares of its hashed byte trigrams (with a space at either
end, A-Z folded) among that language's. The best sequence of languages pays PENALTY for each switch. All words of many
documents step forward together, one word of each at a time, so the work is in array operations; back pointers take a
byte per word and language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm._bytes import CHUNK, buffers, pieces, row_chunks
from quillframe.llm._common import held_out
from quillframe.llm._fit import share

#: The fit uses about FIT_ROWS documents with a language.
FIT_ROWS, BITS, SMOOTH, PENALTY, FOREIGN, CELLS = 20_000, 15, 0.5, 12.0, 40.0, 2_000_000
FOLDS, FOLD = 3, 1
#: First and last code points of scripts.
SCRIPTS = (
    ("Latin", 0x41, 0x24F), ("Greek", 0x370, 0x3FF), ("Cyrillic", 0x400, 0x52F), ("Armenian", 0x530, 0x58F), ("Hebrew", 0x590, 0x5FF), ("Arabic", 0x600, 0x77F),
    ("Devanagari", 0x900, 0x97F), ("Bengali", 0x980, 0x9FF), ("Gurmukhi", 0xA00, 0xA7F), ("Gujarati", 0xA80, 0xAFF), ("Tamil", 0xB80, 0xBFF), ("Telugu", 0xC00, 0xC7F),
    ("Kannada", 0xC80, 0xCFF), ("Malayalam", 0xD00, 0xD7F), ("Thai", 0xE00, 0xE7F), ("Georgian", 0x10A0, 0x10FF), ("Latin", 0x1E00, 0x1EFF), ("Kana", 0x3040, 0x30FF),
    ("Han", 0x3400, 0x9FFF), ("Hangul", 0xAC00, 0xD7AF),
)
NAMES = sorted({s for s, _, _ in SCRIPTS}) + ["other"]
_LOWS, _HIGHS, _OF = np.array([a for _, a, _ in SCRIPTS]), np.array([b for _, _, b in SCRIPTS]), np.array([NAMES.index(s) for s, _, _ in SCRIPTS])
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_PLAIN = np.where(_LETTER, np.arange(256), 32).astype(np.uint32)
_PLAIN[65:91] += 32


def scripts(b: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The script number of the character at each start; b has three spare bytes at its end."""
    c = [b[starts + j].astype(np.int64) for j in range(4)]
    low = [x & 0x3F for x in c]
    code = np.select([c[0] < 0x80, c[0] < 0xE0, c[0] < 0xF0], [c[0], (c[0] & 0x1F) << 6 | low[1], (c[0] & 0x0F) << 12 | low[1] << 6 | low[2]], (c[0] & 0x07) << 18 | low[1] << 12 | low[2] << 6 | low[3])
    at = np.maximum(0, np.searchsorted(_LOWS, code, "right") - 1)
    return np.where((code >= _LOWS[at]) & (code <= _HIGHS[at]), _OF[at], len(NAMES) - 1)


def word_grams(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows b[off[i]:off[i + 1]]: trigram number at each word byte and after each word, first trigram of each word, script of each word, first word of each row."""
    spaced = np.insert(b, off, 32)
    rows = off + np.arange(len(off))
    x = np.concatenate([_PLAIN[spaced], np.full(4, 32, np.uint32)])
    letter = x != 32
    letter[1:] |= x[:-1] != 32
    letter[0] = False
    place = np.flatnonzero(letter)  # bytes of words and the space after each
    h = (x[place - 1] * np.uint32(0x9E3779B1)) ^ (x[place] * np.uint32(0x85EBCA77)) ^ (x[np.minimum(place + 1, len(x) - 1)] * np.uint32(0xC2B2AE3D))
    grams = ((h * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS)).astype(np.int32)
    starts = np.flatnonzero(x[place - 1] == 32)
    starts = starts[x[place[starts]] != 32]
    return grams, starts, scripts(np.concatenate([spaced, np.zeros(4, np.uint8)]), place[starts]), np.searchsorted(place[starts], rows)


def word_chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]]:
    """(first row, words before each row and in all, parts); parts hold trigrams, word starts and scripts in order. Null counts as empty; a long text comes alone, in several parts."""
    data, offsets = buffers(column)
    for lo, hi in row_chunks(offsets):
        b = data[offsets[lo] : offsets[hi]]
        if hi == lo + 1 and len(b) > CHUNK:
            parts = [word_grams(p, np.array([0, len(p)]))[:3] for p in pieces(b, _LETTER)]
            yield lo, np.array([0, sum(len(p[1]) for p in parts)]), parts
        else:
            *part, first = word_grams(b, offsets[lo : hi + 1] - offsets[lo])
            yield lo, first, [tuple(part)]


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # trigrams x languages, log shares
    foreign: np.ndarray  # scripts x languages, 0 where the language writes in the script

    def scores(self, part: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        grams, starts, script = part
        if not len(starts):
            return np.empty((0, len(self.langs)), np.float32)
        return np.add.reduceat(self.table[grams], starts, axis=0) - self.foreign[script]


def decode(s: np.ndarray, first: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The best language of each word; rows of words s[first[i]:first[i + 1]] stand apart, and step together."""
    out = np.zeros(len(s), np.int32)
    lengths = np.diff(first)
    rows = np.argsort(-lengths, kind="stable")
    rows = rows[lengths[rows] > 0]
    if not len(rows):
        return out
    off, lengths = first[rows], lengths[rows]
    most = int(lengths[0])
    going = np.searchsorted(-lengths, -np.arange(most), "left")  # rows with more than t words
    value, turned, source = s[off].copy(), np.zeros(s.shape, bool), np.zeros(len(s), np.int32)
    for t in range(1, most):
        n = going[t]
        v, at = value[:n], off[:n] + t
        best = v.argmax(axis=1)
        level = v[np.arange(n), best][:, None] - penalty
        turned[at], source[at] = v < level, best
        value[:n] = np.maximum(v, level) + s[at]
    state = value.argmax(axis=1)
    for t in range(most - 1, -1, -1):
        n = going[t]
        at, now = off[:n] + t, state[:n]
        out[at] = now
        state[:n] = np.where(turned[at, now], source[at], now)
    return out


def learn(docs: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """From about fit_rows documents outside the held-out fold that have a text and a language, chosen by hash of doc_id."""
    known = docs.filter("doc_id is not null and text is not null and lang is not null").filter(~held_out("doc_id", FOLDS, FOLD))
    sample = known.filter(share("doc_id", fit_rows / max(1, known.count()))).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = (1 << BITS) + len(NAMES)
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for lo, first, parts in word_chunks(batch.column(1)):
                for grams, starts, script in parts:
                    ends = np.append(starts, len(grams))
                    bounds = [0, len(starts)] if len(first) == 2 else first
                    for i in range(len(bounds) - 1):
                        own = seen.setdefault(langs[lo + i], np.zeros(size, np.int64))
                        own += np.bincount(np.concatenate([grams[ends[bounds[i]] : ends[bounds[i + 1]]], script[bounds[i] : bounds[i + 1]] + (1 << BITS)]), minlength=size)
        for lang, own in seen.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(own[at])], names=["lang", "gram", "n"])

    counts = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(counts.column("lang").to_pylist()))
    full = np.zeros(((1 << BITS) + len(NAMES), len(langs)))
    full[counts.column("gram").to_numpy(), np.searchsorted(langs, counts.column("lang").to_pylist()) if langs else []] = counts.column("n").to_numpy()
    table, words = full[: 1 << BITS] + SMOOTH, full[1 << BITS :]
    writes = words >= 0.01 * np.maximum(1, words.sum(axis=0))
    writes |= ~writes.any(axis=1)[:, None]
    return Model(langs, np.log(table / table.sum(axis=0)).astype(np.float32), np.where(writes, 0, FOREIGN).astype(np.float32))


def _has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def identify(docs: DataFrame, fit_rows: int = FIT_ROWS, penalty: float = PENALTY) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, spans array<struct<lang, first_word, n_words>>) of each row of docs (doc_id, text, lang).

    lang_pred is the language of most words (ties: the first by name), score its share of them. Null texts, texts without
    a letter, and all texts if nothing could be learned are "und" with score 0 and no spans. lang is only learned from,
    never an input of a prediction. Repeated rows are labelled alike and all returned; a null doc_id is not held out and
    never learned from. Texts of any length are read whole; a table without rows gives none. Other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, fit_rows))
    span = pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64())])

    def label(group: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[str, float, list]]:
        langs = model.value.langs
        s = np.concatenate([x for x, _ in group])
        bases = np.cumsum([0, *(len(x) for x, _ in group)])
        first = np.concatenate([*(f[:-1] + base for (_, f), base in zip(group, bases, strict=False)), [len(s)]])
        best = decode(s, first, penalty)
        for i in range(len(first) - 1):
            own = best[first[i] : first[i + 1]]
            if not len(own):
                yield "und", 0.0, []
                continue
            counts = np.bincount(own, minlength=len(langs))
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1, [len(own)]])
            yield langs[int(counts.argmax())], float(counts.max() / len(own)), [{"lang": langs[own[a]], "first_word": int(a), "n_words": int(b - a)} for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got: list[tuple[str, float, list]] = []
            if model.value.langs:
                group, cells = [], 0
                for _, first, parts in word_chunks(batch.column(1)):
                    s = np.concatenate([model.value.scores(p) for p in parts])
                    group.append((s, first))
                    cells += s.size
                    if cells > CELLS:
                        got += label(group)
                        group, cells = [], 0
                got += label(group) if group else []
            else:
                got = [("und", 0.0, [])] * len(batch)
            for i, x in enumerate(got):  # words of non-ASCII bytes alone may hold no letter
                if x[0] != "und" and not _surely_letters(batch.column(1)[i]) and not _has_letter(batch.column(1)[i].as_py()):
                    got[i] = ("und", 0.0, [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64()), pa.array([x[2] for x in got], pa.list_(span))], names=["doc_id", "lang_pred", "score", "spans"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = own.mapInArrow(run, "doc_id long, lang_pred string, score double, spans array<struct<lang:string,first_word:long,n_words:long>>")
    return out.select("doc_id", held_out("doc_id", FOLDS, FOLD).alias("held_out"), "lang_pred", "score", "spans")


def _surely_letters(text: pa.Scalar) -> bool:
    """True if an ASCII letter stands among the first bytes."""
    b = text.as_buffer()
    return b is not None and bool(_ASCII[np.frombuffer(b, np.uint8, min(len(b), 4096))].any())


_ASCII = _LETTER & (np.arange(256) < 128)
