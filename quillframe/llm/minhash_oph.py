"""Near-duplicate classes by one-permutation MinHash, banded buckets, star-shaped candidates and exact confirmation.

A document's set holds 64-bit hashes of its distinct k-word shingles. Documents with equal sets form a class, and only
classes are compared. A sketch has K slots: one permutation is cut into bins, of which each keeps its least hash, and
empty bins borrow from a bin that a fixed random probe sequence finds first (optimal densification). Sets too small to
fill K bins use fewer bins and more permutations (two shingles a bin at least), so that densification stays rare; a set
near such a border is entered under both layouts. BANDS keys of K / BANDS slots name the buckets.

Within a bucket candidates are a star: every member with the member whose hash is least. A pair goes on if its sketches
agree in more than the threshold less SLACK (over five standard deviations), and is linked if the full sets say so. That
leaves buckets whose members are still in several components; links among those are found exactly. A member outside its
bucket's main component can miss only so many of its shingles in a partner; of one more than these, its rarest by count
among all such members, a partner must have one. Shingles that nobody else has drop out, and most members with them. Who
would have over HEAVY partners by this is one of a stated set that is compared, in blocks, with all sets by an inverted
index, which gives links but no pairs. So pairs follow the number of members, and no link between components is lost:
pairs found by rare shingles go to the full sets without a look at their sketches.

Rows have numbers, by which everything is joined; a doc_id may repeat or be null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillframe.llm._bytes import mix, seeds, shingles, spaces_split, word_rows
from quillframe.llm._common import discard, free, numbered, picked, small, written

K, BANDS = 128, 32
SLACK = 0.2
#: Partners by rare shingles beyond which a member is compared by index, and shingles in one block of such members.
HEAVY, INDEX_SHINGLES = 128, 2_000_000
_PERMS = seeds(K, 21)
_PROBES = np.random.default_rng(22).integers(0, K, (64, K))


def layout(n: int) -> int:
    """Bins of one permutation for a set of n shingles: a power of two up to K, two shingles a bin at least."""
    return 1 << min(K.bit_length() - 1, max(0, (n // 2).bit_length() - 1))


def sketch(s: np.ndarray, bins: int) -> np.ndarray:
    """K slots of K / bins permutations."""
    perms, shift = K // bins, np.uint64(64 - (bins.bit_length() - 1))
    h = mix(s[None, :] ^ _PERMS[:perms, None])
    slot = np.arange(perms)[:, None] * bins + (h >> shift if bins > 1 else np.zeros_like(h)).astype(np.int64)
    out = np.full(K, np.iinfo(np.uint64).max)
    np.minimum.at(out, slot.ravel(), h.ravel())
    empty = np.flatnonzero(out == np.iinfo(np.uint64).max)
    filled = out.copy()
    for probe in _PROBES:
        if not len(empty):
            return filled
        got = out[empty // bins * bins + probe[empty % bins] % bins]
        ok = got != np.iinfo(np.uint64).max
        filled[empty[ok]] = got[ok]
        empty = empty[~ok]
    for e in empty:
        block = out[e // bins * bins : (e // bins + 1) * bins]
        filled[e] = block[block != np.iinfo(np.uint64).max][0]
    return filled


def bucket_keys(slots: np.ndarray, bins: int) -> np.ndarray:
    rows = slots.reshape(BANDS, -1)
    mul = seeds(rows.shape[1], 23)
    return mix((rows * mul).sum(axis=1, dtype=np.uint64) + np.uint64(bins) * np.uint64(BANDS) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _describe(k: int, similarity: float):
    schema = pa.schema([("at", pa.int64()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("bins", pa.int32()), ("sig", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = spaces_split()
        for batch in batches:
            rows: list[tuple] = []
            for _, first, h in word_rows(batch.column(2), words):
                for i in range(len(first) - 1):
                    s = shingles(h[first[i] : first[i + 1]], k)
                    if not len(s):
                        rows.append((0, None, None, None, None, None))
                        continue
                    k1, k2 = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                    own, other = layout(len(s)), layout(int(np.ceil(similarity * len(s) - 1e-9)))
                    slots = sketch(s, own)
                    keys = bucket_keys(slots, own)
                    if other != own:
                        keys = np.concatenate([keys, bucket_keys(sketch(s, other), other)])
                    rows.append((len(s), int(k1), int(k2), own, (slots & np.uint64(0xFFFF)).astype(np.uint16).tobytes(), np.unique(keys)))
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(6)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[2:], strict=True))], schema=schema)

    return run


def _full_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = spaces_split()
        for batch in batches:
            nodes = batch.column(0)
            for lo, first, h in word_rows(batch.column(1), words):
                sets = [shingles(h[first[i] : first[i + 1]], k) for i in range(len(first) - 1)]
                yield pa.RecordBatch.from_arrays([nodes.slice(lo, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "n", "packed"])

    return run


def _unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.uint64)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes = batch.column(0).to_numpy()
        for i in range(len(batch)):
            tokens = _unpack(batch.column(1)[i].as_py()).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(np.repeat(nodes[i], len(tokens)))], names=["token", "node"])


def _alike(similarity: float):
    """Pairs whose sizes and sketches allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb, ba, bb, sa, sb = (batch.column(i) for i in range(8))
            na, nb, ba, bb = (x.to_numpy(zero_copy_only=False) for x in (na, nb, ba, bb))
            ok = np.minimum(na, nb) >= similarity * np.maximum(na, nb) - 1e-9
            for i in np.flatnonzero(ok & (ba == bb)):
                x, y = (np.frombuffer(s[int(i)].as_py(), np.uint16) for s in (sa, sb))
                ok[i] = np.mean(x == y) > similarity - SLACK
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[bytes, np.ndarray] = (b"", np.empty(0, np.uint64))
        for batch in batches:
            a, b, na, nb, pa_, pb = (batch.column(i) for i in range(6))
            ok = np.zeros(len(batch), bool)
            for i in range(len(batch)):
                small_, large = sorted((na[i].as_py(), nb[i].as_py()))
                if 100 * small_ < percent * large:
                    continue
                x = pa_[i].as_py()
                if x != seen[0]:
                    seen = (x, _unpack(x))
                both = len(np.intersect1d(seen[1], _unpack(pb[i].as_py())))
                ok[i] = 100 * both >= percent * (na[i].as_py() + nb[i].as_py() - both)
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])

    return run


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of every node of links (a, b): comp is the least node that links reach. Labels take the least of their neighbours' and then jump along their own label, until none changes."""
    edges = written(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), 2 * links.count())
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")), edges.count())
    n = labels.count()
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        step = written(labels.join(near, "node").select("node", "comp", F.least("comp", "near").alias("low")), n)
        jump = step.select(F.col("node").alias("low"), F.col("low").alias("lower"))
        new = written(step.join(jump, "low").select("node", F.least("low", "lower").alias("comp"), (F.least("low", "lower") != F.col("comp")).alias("moved")), n)
        more = new.filter("moved").limit(1).count()
        discard(labels, step)
        labels = new
        if not more:
            discard(edges)
            return labels.select("node", "comp")


@dataclass
class _Classes:
    """base: (at, doc_id, n_shingles, k1, k2) of each numbered row; k1, k2 name its shingle set and are null if that is empty. of: (k1, k2, node) of each set, node being the row with the least doc_id (nulls last) and then number that has it. links: (a, b) between nodes of sets that are alike."""

    base: DataFrame
    of: DataFrame
    links: DataFrame


def _classes(rows: DataFrame, k: int, percent: int) -> _Classes:
    """Of numbered rows (at, doc_id, text)."""
    similarity = percent / 100
    base = written(rows.select("at", "doc_id", "text").mapInArrow(_describe(k, similarity), "at long, doc_id long, n_shingles long, k1 long, k2 long, bins int, sig binary, keys array<long>"))
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "at")
    classes = written(base.filter("n_shingles > 0").groupBy("k1", "k2").agg(F.min(order).alias("best"), *(F.first(c).alias(c) for c in ("n_shingles", "bins", "sig", "keys"))).withColumn("node", F.col("best.at")))
    entries = classes.select("node", F.col("n_shingles").alias("n"), F.explode("keys").alias("key"))
    shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min_by("node", F.xxhash64(F.lit(3), "node")).alias("centre")).filter("m > 1")
    members = written(entries.join(shared, "key"))
    n_members = members.count()
    nodes = written(members.select("node").distinct(), n_members)
    sets = written(picked(rows.select(F.col("at").alias("node"), "text"), nodes, "node", "left_semi", lambda found: found.mapInArrow(_full_sets(k), "node long, n long, packed binary")))

    def confirmed(pairs: DataFrame, sketched: bool) -> DataFrame:
        """The pairs (a written table) that full sets confirm; sketched: after a look at their sketches."""
        n, likely = pairs.count(), pairs
        if not n:
            return pairs.sparkSession.createDataFrame([], "a long, b long")
        if sketched:
            side = lambda x: classes.select(F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n_shingles", "bins", "sig")))
            both = small(pairs, n).join(side("a"), "a")
            both = both.join(side("b"), "b").select("a", "b", *(f"{c}_{x}" for c in ("n_shingles", "bins", "sig") for x in "ab"))
            likely = written(both.mapInArrow(_alike(similarity), "a long, b long"), n)
            n = likely.count()
        left = small(likely, n).join(sets.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("packed").alias("p_a")), "a")
        ends = likely.select(F.col("b").alias("node")).distinct()
        right = sets.join(small(ends, n), "node", "left_semi").select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("packed").alias("p_b"))
        out = written(left.join(right, "b").select("a", "b", "n_a", "n_b", "p_a", "p_b").mapInArrow(_confirm(percent), "a long, b long").distinct(), n)
        if sketched:
            discard(likely)
        return out

    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    star = written(members.filter("node != centre").select(*pair("node", "centre")).distinct(), n_members)
    links = confirmed(star, True)
    labels = components(links)
    known = members.join(labels, "node", "left").select("key", "node", "n", F.coalesce("comp", "node").alias("comp"))
    mixed = known.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("n")).groupBy("key").agg(F.max_by("comp", "c").alias("main"), F.count(F.lit(1)).alias("comps"), F.min("n").alias("least")).filter("comps > 1")
    open_ = written(known.join(mixed, "key").groupBy("node", "n", "comp").agg(F.max(F.col("comp") != F.col("main")).alias("minor"), F.min(F.when(F.col("comp") != F.col("main"), F.col("least"))).alias("least")), n_members)
    if open_.limit(1).count():
        links = written(links.union(_rare_links(open_, sets, star, confirmed, similarity, percent)))
    discard(sets, nodes, members, star, open_, labels)
    return _Classes(base.select("at", "doc_id", "n_shingles", "k1", "k2"), classes.select("k1", "k2", "node", F.col("best.doc_id").alias("doc_id")), links)


def _best(found: _Classes, links: DataFrame) -> DataFrame:
    """(k1, k2, at, least) of each set that is in a component of several sets: the component's first row by doc_id (nulls last) and number, and its doc_id."""
    inside = found.of.join(components(links), "node")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", F.col("node").alias("at"))).alias("first")
    return written(inside.select("k1", "k2", "comp").join(inside.groupBy("comp").agg(first), "comp").select("k1", "k2", F.col("first.at").alias("at"), F.col("first.doc_id").alias("least")))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text): component_id is the least doc_id that links of at least percent / 100 Jaccard similarity reach.

    Null and empty texts have no shingles and link with nothing. Rows that repeat a doc_id are one document, whatever their
    texts: what any of them links with is in the component of all, and all are kept if it is. Rows with a null doc_id link
    like others, and may so join two documents; their component_id is the least doc_id reached, and null if there is none,
    in which case they are kept. Texts of any length are read whole. A table without rows gives none. Other columns are
    ignored.
    """
    rows = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "at")
    found = _classes(rows, k, percent)
    discard(rows)
    again = written(found.base.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("doc_id"))
    n = again.count()
    links = found.links
    if n:
        named = written(found.base.join(small(again, n), "doc_id").join(found.of.select("k1", "k2", "node"), ["k1", "k2"]).select("doc_id", "node").distinct())
        hubs = named.groupBy("doc_id").agg(F.min("node").alias("a"))
        links = written(links.union(small(hubs, n).join(named, "doc_id").filter("a != node").select("a", F.col("node").alias("b"))))
        discard(named)
    classes = found.of.select("k1", "k2", "doc_id").join(_best(found, links), ["k1", "k2"], "left").select("k1", "k2", F.when(F.col("at").isNotNull(), F.col("least")).otherwise(F.col("doc_id")).alias("component"))
    out = found.base.join(classes, ["k1", "k2"], "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
    if n:  # an empty text is in the component of its document's other rows
        whole = written(out.join(small(again, n), "doc_id").groupBy("doc_id").agg(F.min("component_id").alias("all")))
        out = out.join(small(whole, n), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("all", "component_id").alias("component_id"))
    return out.withColumn("kept", F.when(F.col("doc_id").isNull(), F.col("component_id").isNull()).otherwise(F.col("doc_id") == F.col("component_id")))


def _rare_links(open_: DataFrame, sets: DataFrame, tested: DataFrame, confirmed: Callable[[DataFrame, bool], DataFrame], similarity: float, percent: int) -> DataFrame:
    """Links (a, b) of minor members of open_ (node, n, comp, minor, least) with any member of another component, by their rarest shingles."""
    spark, n_open = open_.sparkSession, open_.count()
    own_sets = written(sets.join(small(open_.select("node", "comp"), n_open), "node"))
    tokens = written(own_sets.select("node", "packed").mapInArrow(_tokens, "token long, node long"))
    common = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    needed = F.ceil(similarity / (1 + similarity) * (F.col("n") + F.greatest("least", similarity * F.col("n"))) - 1e-6)
    minor = open_.filter("minor").select("node", "comp", "n", (F.col("n") - needed + 1).alias("prefix"))
    shared = tokens.join(small(minor, n_open), "node").join(common, "token")
    by_node = Window.partitionBy("node")
    ranked = shared.withColumn("rank", F.row_number().over(by_node.orderBy("df", "token"))).withColumn("unique", F.col("n") - F.count(F.lit(1)).over(by_node))
    prefix = ranked.filter(F.col("rank") + F.col("unique") <= F.col("prefix")).withColumn("weight", F.sum(F.col("df") - 1).over(by_node))
    prefix = written(prefix.select("token", "node", "comp", "weight"), tokens.count())
    light = prefix.filter(F.col("weight") <= HEAVY).select("token", F.col("node").alias("x"), F.col("comp").alias("cx"))
    other = small(light, light.count()).join(tokens.select("token", F.col("node").alias("y")), "token").filter("x != y").select("x", "y", "cx").distinct()
    other = other.join(small(open_.select(F.col("node").alias("y"), F.col("comp").alias("cy")), n_open), "y").filter("cx != cy")
    fresh = written(other.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().join(tested, ["a", "b"], "left_anti"))
    links = confirmed(fresh, False)
    heavy = written(prefix.filter(F.col("weight") > HEAVY).select("node").distinct(), n_open)
    queries = own_sets.join(small(heavy, n_open), "node", "left_semi")
    blocks = -(-(queries.agg(F.sum("n")).first()[0] or 0) // INDEX_SHINGLES)
    for i in range(blocks):
        block = queries.filter(F.pmod(F.xxhash64("node"), F.lit(blocks)) == i).toArrow()
        sent = spark.sparkContext.broadcast(_Inverted.build(block))
        links = links.union(written(own_sets.select("node", "n", "packed", "comp").mapInArrow(_against(sent, percent), "a long, b long").distinct(), n_open))
    discard(tokens, prefix)
    return links


@dataclass
class _Inverted:
    """An index of sets: the sets that have each token are of[starts[i]:starts[i + 1]]."""

    nodes: np.ndarray
    sizes: np.ndarray
    comps: np.ndarray
    tokens: np.ndarray
    starts: np.ndarray
    of: np.ndarray

    @staticmethod
    def build(block: pa.Table) -> _Inverted:
        sets = [_unpack(b.as_py()) for b in block.column("packed")]
        flat, of = np.concatenate(sets) if sets else np.empty(0, np.uint64), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(flat, kind="stable")
        tokens, starts = np.unique(flat[order], return_index=True)
        return _Inverted(block.column("node").to_numpy(), block.column("n").to_numpy(), block.column("comp").to_numpy(), tokens, np.append(starts, len(flat)), of[order])

    def overlaps(self, s: np.ndarray) -> np.ndarray:
        """How many tokens each set of the index shares with s."""
        at = np.minimum(np.searchsorted(self.tokens, s), len(self.tokens) - 1)
        at = at[self.tokens[at] == s]
        lengths = self.starts[at + 1] - self.starts[at]
        if not len(at):
            return np.zeros(len(self.nodes), np.int64)
        flat = np.arange(lengths.sum()) + np.repeat(self.starts[at] - np.append(0, np.cumsum(lengths)[:-1]), lengths)
        return np.bincount(self.of[flat], minlength=len(self.nodes))


def _against(sent, percent: int):
    """Links between sets of the index and sets (node, n, packed, comp) of another component; of two components, one link from each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, joined = sent.value, {}
        for batch in batches:
            for node, n, packed, comp in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                both = index.overlaps(_unpack(packed.as_py()))
                for i in np.flatnonzero((100 * both >= percent * (n + index.sizes - both)) & (index.comps != comp)):
                    joined.setdefault((comp, int(index.comps[i])), (node, int(index.nodes[i])))
        ends = np.array(sorted(joined.values()), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(ends.min(axis=1)), pa.array(ends.max(axis=1))], names=["a", "b"])

    return run


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs without near copies: of each group of rows whose texts links join, the one with the least doc_id stays (null ones come last; of rows with one doc_id, the first).

    Rows are judged by their texts: rows that share a doc_id but have other texts all stay, and a row with a null doc_id is
    dropped if its text is near that of a row that stays. Null and empty texts link with nothing and stay. A table without
    rows gives none. Columns stay as they are.
    """
    name = free(docs, "__at")
    rows = numbered(docs, name)
    found = _classes(rows.select(F.col(name).alias("at"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), k, percent)
    best = found.of.select("k1", "k2", F.col("node").alias("own")).join(_best(found, found.links).select("k1", "k2", "at"), ["k1", "k2"], "left").select("k1", "k2", F.coalesce("at", "own").alias("stays"))
    gone = written(found.base.join(best, ["k1", "k2"]).filter("at != stays").select(F.col("at").alias(name)))
    return picked(rows, gone, name, "left_anti", lambda left: left.select(*(F.col(f"`{c}`") for c in docs.columns)))
