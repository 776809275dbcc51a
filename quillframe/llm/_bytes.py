"""Vectorised work on the UTF-8 bytes of Arrow text columns: no Python object per word, temporaries bounded by CHUNK."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that are worked on at a time.
CHUNK = 1 << 18
_MOD = 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), elementwise on uint64."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def seeds(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Words:
    """Splits text into words at bytes outside a class; A-Z fold to a-z; each word gets a 64-bit hash."""

    def __init__(self, is_word: np.ndarray, seed: int = 11):
        self.is_word = is_word
        values = seeds(256, seed)
        values[65:91] = values[97:123]
        values[~is_word] = 0
        self.values = values
        powers = np.empty(_MOD, np.uint64)
        powers[0] = 1
        powers[1:] = np.uint64(0x9E3779B97F4A7C15)
        self.powers = np.multiply.accumulate(powers)

    def starts(self, b: np.ndarray, row_off: np.ndarray) -> np.ndarray:
        word = self.is_word[b]
        start = word.copy()
        start[1:] &= ~word[:-1]
        edge = row_off[(row_off < len(b))]
        start[edge] = word[edge]
        return np.flatnonzero(start)

    def hashes(self, b: np.ndarray, row_off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the rows b[row_off[i]:row_off[i+1]]: hash of each word, its start, and each row's first word."""
        s = self.starts(b, row_off)
        if not len(s):
            return np.empty(0, np.uint64), s, np.zeros(len(row_off), np.int64)
        lengths = np.diff(np.append(s, len(b)))
        at = np.arange(s[0], len(b)) - np.repeat(s, lengths)
        v = self.values[b[s[0] :]] * self.powers[at % _MOD]
        return mix(np.add.reduceat(v, s - s[0])), s, np.searchsorted(s, row_off)


def spaces_split() -> Words:
    """Words of everything but space and \\t to \\r."""
    is_word = np.ones(256, bool)
    is_word[[0x20, *range(0x09, 0x0E)]] = False
    return Words(is_word)


def alnum_split() -> Words:
    """Words of ASCII letters and digits and all non-ASCII bytes."""
    is_word = np.zeros(256, bool)
    for lo, hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
        is_word[lo:hi] = True
    return Words(is_word)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; nulls count as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), offsets


def row_chunks(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most so many bytes together; a longer row comes alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def word_rows(column: pa.Array, words: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, first word of each row and the end, hashes) for chunks of rows. A row beyond CHUNK is cut between words while it is hashed, so only 8 bytes a word are held."""
    data, offsets = buffers(column)
    for lo, hi in row_chunks(offsets):
        b = data[offsets[lo] : offsets[hi]]
        if hi == lo + 1 and len(b) > CHUNK:
            parts = [words.hashes(p, np.array([0, len(p)]))[0] for p in pieces(b, words.is_word)]
            h = np.concatenate(parts)
            yield lo, np.array([0, len(h)]), h
        else:
            h, _, first = words.hashes(b, offsets[lo : hi + 1] - offsets[lo])
            yield lo, first, h


def pieces(b: np.ndarray, is_word: np.ndarray, most: int = CHUNK) -> Iterator[np.ndarray]:
    """Cuts of a long text between words (a single word longer than a piece stays whole)."""
    at = 0
    while at < len(b):
        end = min(at + most, len(b))
        while end < len(b):
            gaps = np.flatnonzero(~is_word[b[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
                break
            end = min(end + most, len(b))
        yield b[at:end]
        at = end


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """The sorted distinct k-word shingle hashes of a word sequence; fewer words than k make one shingle; none make none."""
    if not len(h):
        return h
    mul = seeds(k, 5)
    if len(h) < k:
        return mix(np.array([np.sum(h * mul[: len(h)], dtype=np.uint64) + np.uint64(len(h))], np.uint64))
    n = len(h) - k + 1
    s = h[:n] * mul[0]
    for j in range(1, k):
        s = s + h[j : j + n] * mul[j]
    return np.unique(mix(s))
