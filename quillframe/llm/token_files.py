"""Token ids of documents in Parquet files that can be read in part.

A folder of token files has two tables. tokens: a row a document in ascending doc_id order, (doc_id, part, place, n_tokens,
ids): the file's number, the ids before the document in its file, how many it has, and the ids. parts: a row a file, (part,
start, n_tokens): the ids in all files before. So the ids of all documents are one long sequence, a document's start in it is
the sum of two numbers, and files are written by independent tasks.

ids are a list column in dictionary encoding: a few thousand different ids in a row group cost about 12 bits each before
compression. doc_id, place and n_tokens are written without a dictionary by the second version of pages, which encodes
numbers as deltas. Row groups and pages have a bounded size, and pages of each column end at the same few rows, so the page
indexes let a reader of some doc_ids or of a stretch of the sequence skip most pages; readers that want no ids read none.

Texts are cut before they are encoded, at single spaces between characters that are not white space, at marks after letters
and after single ends of lines. The tokenizer never joins what stands before such a place with what follows, so the ids of the
pieces, one after another, are those of the text; a worker asks the tokenizer only for pieces that it does not know. It knows
KEPT bytes of pieces; beyond, it forgets those that it has met least.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm._bytes import buffers, mix, row_chunks, seeds
from quillframe.llm._common import small

END = 2
#: Bytes of a row group and of a page, and the most rows of a page.
ROW_GROUP, PAGE, PAGE_ROWS = 32 << 20, 64 << 10, 256
#: Bytes of pieces whose ids a worker keeps, and of texts that are cut at a time.
KEPT, CHUNK = 16 << 20, 2 << 20
#: Pieces with a space at their start and no white space else, and without any; how many of these are encoded as one text; a byte-level tokenizer's letters for a space and the end of a line.
LONE, BARE, JOINED, SPACE, LINE = "^ [!-~À-ɏ]+$", "^[!-~À-ɏ]+$", 50, "Ġ", "Ċ"


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """The ids of texts by a tokenizer whose words never reach over a space: a byte-level one that splits by its own pattern. The ids of a text are followed by the end id."""

    def __init__(self, path: str, end: int = END, kept: int = KEPT):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are parallel already
        from tokenizers import Tokenizer

        self.tokenizer, self.end, self.most = Tokenizer.from_file(path), end, kept
        vocabulary = self.tokenizer.get_vocab()
        self.opens, self.breaks = np.zeros((2, max(vocabulary.values()) + 1), bool)
        self.opens[[i for t, i in vocabulary.items() if t.startswith(SPACE)]] = True
        self.breaks[[i for t, i in vocabulary.items() if t == LINE]] = True
        # The pieces that are known, in how many chunks each was met again, and the ids of all of them, one after another: those of piece i are ids[starts[i] : starts[i + 1]]. The last piece is the end id, of no text.
        self.known, self.met = pa.array([], pa.large_string()), np.zeros(0, np.int32)
        self.hashes, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # of the known pieces, by hash
        self.starts = np.array([0, 1])
        self.ids = np.array([self.end], np.int32)

    def _forget(self) -> None:
        """Keeps the known pieces that were met most, half of the bytes at most; what was met long ago counts less each time."""
        size, least = buffers(self.known)[1], 1
        size = np.diff(size) + size.itemsize
        keep = self.met >= least
        while size[keep].sum() > self.most / 2:
            least *= 2
            keep = self.met >= least
        stay = keep[self.numbers]
        self.hashes, self.numbers = self.hashes[stay], (np.cumsum(keep, dtype=np.int32) - 1)[self.numbers[stay]]
        self.ids, ends = self._taken(np.flatnonzero(np.append(keep, True)))
        self.starts = np.append(0, ends)
        self.known, self.met = self.known.filter(pa.array(keep)), self.met[keep] // 2

    def _taken(self, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends) of the pieces with these numbers: the ids of all, one after another, and where those of each end."""
        n = np.diff(self.starts)[pieces]
        ends = np.cumsum(n)
        return self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[pieces] - ends + n, n)], ends

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """The ids of each text, and the end id; nulls count as empty."""
        data, offsets = buffers(texts)
        parts = [self._encode(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in row_chunks(offsets, CHUNK)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    def _encode(self, b: np.ndarray, rows: np.ndarray) -> pa.ListArray:
        cuts = np.zeros(len(b) + 1, bool)
        cuts[rows] = cuts[places(b)] = True
        cuts = np.flatnonzero(cuts)
        coded = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(b))).dictionary_encode()
        piece = self._learned(coded.dictionary)[coded.indices.to_numpy()]
        piece = np.insert(piece, np.searchsorted(cuts, rows[1:]), len(self.known))  # the end of each row
        ids, ends = self._taken(piece)
        ends = ends[piece == len(self.known)]
        return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids))

    def _learned(self, pieces: pa.Array) -> np.ndarray:
        """The numbers of the distinct pieces; those that are not known are encoded."""
        if self.known.nbytes > self.most:
            self._forget()
        own, number = hashes(pieces), np.zeros(len(pieces), np.int64)
        if len(self.known):
            order = np.argsort(own)
            at = np.minimum(np.searchsorted(self.hashes, own[order]), len(self.hashes) - 1)
            hit = np.flatnonzero(self.hashes[at] == own[order])
            number[order[hit]] = self.numbers[at[hit]]
            hit = order[hit]
        else:
            hit = np.zeros(0, np.int64)
        hit = hit[pc.equal(self.known.take(pa.array(number[hit])), pieces.take(pa.array(hit))).to_numpy(zero_copy_only=False)]
        self.met[number[hit]] += 1
        fresh = np.ones(len(pieces), bool)
        fresh[hit] = False
        fresh = np.flatnonzero(fresh)
        if len(fresh):
            lone, bare = (pc.match_substring_regex(pieces.take(pa.array(fresh)), x).to_numpy(zero_copy_only=False) for x in (LONE, BARE))
            kinds = [fresh[lone], fresh[bare], fresh[~(lone | bare)]]
            fresh = np.concatenate(kinds)
            lone, bare, rest = (pieces.take(pa.array(x)) for x in kinds)
            got = [self._opened(lone), self._lined(bare), self._alone(rest)]
            ends = self.starts[-2] + np.cumsum(np.concatenate([n for n, _ in got]))
            self.ids = np.concatenate([self.ids[:-1], *(ids for _, ids in got), [self.end]]).astype(np.int32)
            self.starts = np.concatenate([self.starts[:-1], ends, [ends[-1] + 1]])
            number[fresh] = np.arange(len(self.known), len(self.known) + len(fresh))
            order = np.argsort(own[fresh])
            place = np.searchsorted(self.hashes, own[fresh][order])
            self.hashes = np.insert(self.hashes, place, own[fresh][order])
            self.numbers = np.insert(self.numbers, place, number[fresh][order])
            self.known = pa.concat_arrays([self.known, lone, bare, rest])
            self.met = np.append(self.met, np.zeros(len(fresh), np.int32))
        return number

    def _opened(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, ids) of LONE pieces. Several make one text, in which a piece begins with each id that begins with a space."""
        _, ids = self._asked(joined(pieces))
        first = np.flatnonzero(self.opens[ids])
        if len(first) != len(pieces):  # a tokenizer that marks spaces in another way
            return self._alone(pieces)
        return np.diff(np.append(first, len(ids))), ids

    def _lined(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, ids) of BARE pieces. Several make one text, each a line of it."""
        _, ids = self._asked(joined(pc.binary_join_element_wise(pieces, *pa.array(["", "\n"], pa.large_string()))))
        breaks = np.flatnonzero(self.breaks[ids])
        if len(breaks) != len(pieces):  # a tokenizer that marks lines in another way
            return self._alone(pieces)
        return np.diff(breaks, prepend=-1) - 1, np.delete(ids, breaks)

    def _alone(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, ids) of pieces, each of which is a text."""
        return self._asked(pieces.to_pylist())

    def _asked(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, ids) of texts, by the tokenizer."""
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, got), np.int64, len(got))
        return lengths, np.fromiter(chain.from_iterable(got), np.int32, lengths.sum())


def joined(pieces: pa.Array) -> list[str]:
    """Texts of JOINED pieces each."""
    data, offsets = buffers(pieces)
    cuts = offsets[[*range(0, len(pieces), JOINED), len(pieces)]]
    return [data[a:b].tobytes().decode() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


@functools.cache
def worker_encoder(path: str, end: int) -> Encoder:
    """The encoder of a worker process, which may run many tasks."""
    return Encoder(path, end)


def hashes(pieces: pa.Array) -> np.ndarray:
    """64 bits of each piece, none of which is empty."""
    b, offsets = buffers(pieces)
    b, offsets = b[offsets[0] : offsets[-1]], offsets - offsets[0]
    at = np.arange(len(b)) - np.repeat(offsets[:-1], np.diff(offsets))
    return mix(np.add.reduceat(_VALUES[b] * _POWERS[at % len(_POWERS)], offsets[:-1])) if len(pieces) else np.zeros(0, np.uint64)


_VALUES, _POWERS = seeds(256, 17), seeds(512, 19)


#: What a byte may be, by bits: an ASCII character that is no white space, the first of a character of two bytes that is none, the first of a letter of two bytes, an ASCII letter, the second of a letter (but for those of signs among letters), a mark, a space, the end of a line.
_SOLID, _FIRST, _OPENS, _LETTER, _SECOND, _MARK, _SPACE, _LINE = (np.uint8(1 << i) for i in range(8))
_KINDS = np.zeros(256, np.uint8)
for _kind, _bytes in (
    (_SOLID, range(0x21, 0x7F)),
    (_FIRST, range(0xC3, 0xE0)),
    (_OPENS, range(0xC3, 0xCA)),
    (_LETTER, [*range(65, 91), *range(97, 123)]),
    (_SECOND, [i for i in range(0x80, 0xC0) if i not in (0x97, 0xB7)]),
    (_MARK, b",.;:!?)#$%&*\n"),
    (_SPACE, b" "),
    (_LINE, b"\n"),
):
    _KINDS[list(_bytes)] |= _kind


def places(b: np.ndarray) -> np.ndarray:
    """Places in UTF-8 bytes at which a text may be cut, as no word of the tokenizer reaches over them: before a single space between characters that are no white space (ASCII ones, or of two bytes of which the first tells so), before a mark or the end of a line that follows a letter (of ASCII or Latin), and after the end of a line, if it is a single one between such characters."""
    if len(b) < 3:
        return np.zeros(0, np.int64)
    kinds = _KINDS[b]
    solid, letter = (kinds & _SOLID) != 0, (kinds & _LETTER) != 0  # where a character ends
    solid[1:] |= (kinds[:-1] & _FIRST) != 0
    letter[1:] |= ((kinds[:-1] & _OPENS) != 0) & ((kinds[1:] & _SECOND) != 0)
    begins = (kinds & (_SOLID | _FIRST)) != 0
    cut = np.zeros(len(b), bool)
    cut[1:-1] = ((kinds[1:-1] & _SPACE) != 0) & solid[:-2] & begins[2:]
    cut[1:-1] |= ((kinds[1:-1] & _MARK) != 0) & letter[:-2]
    cut[2:] |= ((kinds[1:-1] & _LINE) != 0) & solid[:-2] & begins[2:]
    return np.flatnonzero(cut)


def _encoded(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, before = worker_encoder(path, end), TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column(1)
            for lo, hi in row_chunks(np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())]), CHUNK):
                ids = encoder.encode(texts.slice(lo, hi - lo))
                n = np.diff(ids.offsets.to_numpy()).astype(np.int64)
                place = before + np.cumsum(n) - n
                before += int(n.sum())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.full(len(n), part, np.int32)), pa.array(place), pa.array(n), ids], names=["doc_id", "part", "place", "n_tokens", "ids"])

    return run


def write(docs: DataFrame, folder: str, path: str | None = None, end: int = END, row_group: int = ROW_GROUP, page: int = PAGE, page_rows: int = PAGE_ROWS) -> None:
    """Writes the ids of docs (doc_id, text) to token files in folder, by the tokenizer in path.

    Documents are in ascending doc_id order, null last; rows with one doc_id are in the order of the table, however many
    they are. Null and empty texts have the end id alone. Texts of any length are encoded whole. Without documents there are
    no ids. Other columns are left out. Texts are sorted into ranges of doc_id, the only shuffle.
    """
    path = path or vocabulary()
    spark, tie = docs.sparkSession, "__tie"
    kind = docs.schema["doc_id"].dataType.simpleString()
    order = [F.asc_nulls_last("doc_id"), F.asc(tie)]
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias(tie)).repartitionByRange(*order).sortWithinPartitions(*order)
    ids = rows.select("doc_id", "text").mapInArrow(_encoded(path, end), f"doc_id {kind}, part int, place long, n_tokens long, ids array<int>")
    options = {"parquet.block.size": row_group, "parquet.page.size": page, "parquet.page.row.count.limit": page_rows, "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "true"}
    options |= {f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "part", "place", "n_tokens")}
    ids.write.options(**options, compression="zstd").mode("overwrite").parquet(f"{folder}/tokens")
    counts = spark.read.parquet(f"{folder}/tokens").groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).collect()  # a row a file
    starts, before = [], 0
    for p, n in sorted((r.part, r.n_tokens) for r in counts):
        starts.append((p, before, n))
        before += n
    spark.createDataFrame(starts, "part int, start long, n_tokens long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/parts")


def _read(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    parts = spark.read.schema("part int, start long, n_tokens long").parquet(f"{folder}/parts")
    return spark.read.parquet(f"{folder}/tokens"), small(parts.select("part", F.col("start").alias("part_start")), parts.count())


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of each document; select without ids and none are read, filter by doc_id and only pages that may have it are."""
    tokens, parts = _read(spark, folder)
    return tokens.join(parts, "part").select("doc_id", (F.col("part_start") + F.col("place")).alias("start"), "n_tokens", "ids")


def stretch(spark: SparkSession, folder: str, start: int, end: int) -> DataFrame:
    """(at, ids) of the ids start to end (exclusive) of the whole sequence: of each document that has some of them, those, and where they begin."""
    parts = spark.read.parquet(f"{folder}/parts").filter((F.col("start") < end) & (F.col("start") + F.col("n_tokens") > start)).collect()  # of the files that have some
    tokens, out = spark.read.parquet(f"{folder}/tokens"), None
    if len(parts) > 2:  # files between the first and the last are wanted whole
        lo, hi = min(parts, key=lambda p: p.part), max(parts, key=lambda p: p.part)
        places = [(F.col("part") > lo.part) & (F.col("part") < hi.part), *((F.col("part") == p.part) & (F.col("place") < end - p.start) & (F.col("place") + F.col("n_tokens") > start - p.start) for p in (lo, hi))]
    else:
        places = [(F.col("part") == p.part) & (F.col("place") < end - p.start) & (F.col("place") + F.col("n_tokens") > start - p.start) for p in parts]
    wanted = F.lit(False)
    for x in places:
        wanted = wanted | x
    _, there = _read(spark, folder)
    out = tokens.filter(wanted).join(there, "part").withColumn("at", F.col("part_start") + F.col("place"))
    skip = F.greatest(F.lit(start) - F.col("at"), F.lit(0))
    stop = F.least(F.lit(end) - F.col("at"), F.col("n_tokens"))
    return out.select((F.col("at") + skip).alias("at"), F.slice("ids", (skip + 1).cast("int"), (stop - skip).cast("int")).alias("ids"))


def checksum(ids: str = "ids"):
    """The unsigned CRC-32 of a column of ids as little-endian unsigned 32-bit integers."""

    def run(column: pa.Array) -> pa.Array:
        values, o = column.values.to_numpy(), column.offsets.to_numpy()
        values = values.astype("<i4", copy=False)
        return pa.array([zlib.crc32(values[a:b]) for a, b in zip(o[:-1], o[1:], strict=True)], pa.int64())

    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "long")(F.col(ids))
