"""Mixing sources to target weights by Pfair scheduling.

Each source's documents form blocks of block_rows rows. Block i (from 1) of a source with weight w may run from slot
floor((i - 1) / w) and must have run by slot ceil(i / w); each slot runs the released block with the earliest deadline,
which on one resource meets every deadline as the weights sum to 1. So after any slot each source has had its share within
less than one block. When a source has run out, a new phase begins: the weights of the others are scaled up and their
windows start again from that slot; every document is placed once. Weights are fractions of SCALE, so all window ends are
exact integers.

With such weights all windows repeat after SCALE slots, and so does the schedule. Only one period of each phase is ever
worked out, at most SCALE slots however many blocks there are; where a block runs follows from its number by division. All
blocks before a phase's end are full but the last ones of the sources that ran out, so the row at which a slot begins
follows too. The driver holds counts and periods of MOST_SOURCES sources at most, nothing that grows with the documents.

A document's number within its source comes from a written copy of the documents, each part of which is sorted by source:
of the row's number in its part, less that of the part's first row of the source, plus the source's rows in earlier parts.
Only counts by part and source are aggregated: no text is shuffled, and neither null or repeated doc_ids nor a source that
holds most rows makes a task larger than others.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.llm._common import BROADCAST_ROWS, discard, numbered, written

SCALE, BLOCK_ROWS, TEMPER = 100_000, 256, 0.5
#: Sources with windows of their own; a schedule of as many phases has 20 million slots at most. REST: the name of all others.
MOST_SOURCES, REST = 200, "+"
_PART = 33  # numbers of monotonically_increasing_id() hold the part above these bits


@dataclass(frozen=True)
class Phase:
    """Slots from first on, in which each source of quotas has so many of every SCALE slots; done: the blocks that each source ran before; places[s]: the slots of its blocks within a period; short: the rows by which blocks before fall short of being full."""

    first: int
    quotas: dict[str, int]
    done: dict[str, int]
    places: dict[str, list[int]]
    short: int


def quotas(weights: dict[str, float]) -> dict[str, int]:
    """Weights as whole parts of SCALE that add up to it, one at least each."""
    total = sum(weights.values())
    q = {s: max(1, round(w / total * SCALE)) for s, w in weights.items()}
    q[max(q, key=lambda s: (q[s], s))] += SCALE - sum(q.values())
    if min(q.values()) < 1:
        raise ValueError(f"{len(q)} sources are too many for shares of 1 / {SCALE}")
    return q


def period(q: dict[str, int], most: int = SCALE) -> dict[str, list[int]]:
    """The slots of each source's blocks, of the first most of a period, by earliest deadline among released blocks; ties by source."""
    names, most = sorted(q), min(SCALE, most)
    n, own = len(names), np.array([q[s] for s in names])
    source = np.repeat(np.arange(n), own)
    block = np.arange(len(source)) - np.repeat(np.cumsum(own) - own, own)
    release = block * SCALE // own[source]
    order = np.argsort(release, kind="stable")
    order = order[release[order] < most]
    urgent = (-(-(block[order] + 1) * SCALE // own[source[order]]) * n + source[order]).tolist()  # deadlines, then sources
    until = np.searchsorted(release[order], np.arange(most), "right").tolist()
    ready: list[int] = []
    run, at = [], 0
    for end in until:
        while at < end:
            heapq.heappush(ready, urgent[at])
            at += 1
        run.append(heapq.heappop(ready) % n)
    run = np.array(run, np.int64)
    return {s: np.flatnonzero(run == i).tolist() for i, s in enumerate(names)}


def phases(rows: dict[str, int], weights: dict[str, float], block_rows: int) -> list[Phase]:
    """The phases of sources with so many rows, until all blocks have run."""
    blocks = {s: -(-n // block_rows) for s, n in rows.items() if n > 0}
    done, first, short, out = dict.fromkeys(blocks, 0), 0, 0, []
    while left := {s: n - done[s] for s, n in blocks.items() if n > done[s]}:
        q = quotas({s: weights[s] for s in sorted(left)})
        # the phase ends by the last deadline of the source that is due to run out first
        places = period(q, 1 + min(-(-n * SCALE // q[s]) for s, n in left.items()))
        out.append(Phase(first, q, {s: done[s] for s in left}, places, short))

        def last(s: str, left: dict[str, int] = left, q: dict[str, int] = q, places: dict[str, list[int]] = places) -> int:
            turns, i = divmod(left[s] - 1, q[s])
            return turns * SCALE + (places[s][i] if i < len(places[s]) else SCALE)

        slots, ended = min((last(s) + 1, s) for s in left)
        turns, rest = divmod(slots, SCALE)
        for s in left:
            done[s] += turns * q[s] + sum(p < rest for p in places[s])
        first += slots
        short += blocks[ended] * block_rows - rows[ended]
    return out


def tempered(counts: dict[str, int], temper: float = TEMPER) -> dict[str, float]:
    """Weights in proportion to the counts to a power below 1, which lifts small sources."""
    total = sum(n**temper for n in counts.values())
    return {s: n**temper / total for s, n in counts.items()}


def _shares(sources: DataFrame, given: dict[str, float]) -> tuple[dict[str, float], Callable[[Column], Column], Callable[[Column, Column], Column]]:
    """The weights of sources(of), what names the source or group of sources that a row is placed with (each of the MOST_SOURCES of most rows is one, and REST all others), and the weight of a source of so many rows among the others of REST."""
    counts = written(sources.groupBy("of").agg(F.count(F.lit(1)).alias("n")))
    top = [(r.of, r.n) for r in counts.orderBy(F.desc("n"), "of").limit(MOST_SOURCES + 1).collect()]
    own = dict(top if len(top) <= MOST_SOURCES else top[:MOST_SOURCES])
    rest = counts.filter(~F.col("of").isin(list(own))) if len(top) > MOST_SOURCES else None
    usual = sum(given.values()) / len(given) if given else 0.0
    if given:
        shares = {x: w if (w := given.get(x, 0)) > 0 else usual for x in own}
        if rest is not None:
            named = {x: w for x, w in given.items() if x not in own and w > 0}
            known = [r.of for r in rest.filter(F.col("of").isin(list(named))).select("of").collect()] if named else []
            shares[REST] = sum(named[x] for x in known) + usual * (rest.count() - len(known))
    else:
        shares = tempered(own) if own else {}
        if rest is not None:
            lifted = {x: n**TEMPER for x, n in own.items()} | {REST: rest.agg(F.sum(F.pow("n", F.lit(TEMPER)))).first()[0]}
            shares = {x: w / sum(lifted.values()) for x, w in lifted.items()}
    discard(counts)
    told = [(x, w) for x, w in given.items() if w > 0]

    def weight(name: Column, n: Column) -> Column:
        if not given:
            return F.pow(n, F.lit(TEMPER))
        known = F.map_from_entries(F.array(*(F.struct(F.lit(x), F.lit(float(w))) for x, w in told))) if told else None
        return F.lit(float(usual)) if known is None else F.coalesce(F.try_element_at(known, name), F.lit(float(usual)))

    return shares, lambda name: name if rest is None else F.when(name.isin(list(own)), name).otherwise(F.lit(REST)), weight


def _within_rest(parts: DataFrame, weight: Callable[[Column, Column], Column], block_rows: int) -> DataFrame:
    """(part, of, from, to, less): where the rows of parts(part, name, n, from) of the sources of REST stand in their common order: rows numbered from to to of a part, less less. Each source's blocks of block_rows have deadlines in proportion to its weight, and all blocks run in order of deadlines, ties by source, so each source has its share of REST; the order is by a sort in ranges, whatever the number of sources."""
    before = F.coalesce(F.sum("n").over(Window.partitionBy("name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = parts.select("part", "name", "from", "n", before.alias("before"), F.sum("n").over(Window.partitionBy("name")).alias("all"))
    block = lambda rank: F.floor(rank / block_rows).cast("long")
    own = own.select("*", F.explode(F.sequence(block(F.col("before")), block(F.col("before") + F.col("n") - 1))).alias("block"))
    first = F.greatest(F.col("before"), F.col("block") * block_rows)
    end = F.least(F.col("before") + F.col("n"), (F.col("block") + 1) * block_rows)
    own = own.select("part", (F.col("from") + first - F.col("before")).alias("from"), (end - first).alias("n"), ((F.col("block") + 1) / weight(F.col("name"), F.col("all"))).alias("due"), "name", first.alias("first"))
    ranged = numbered(own.orderBy("due", "name", "first"), "at")
    task = F.shiftright("at", _PART)
    sizes = ranged.groupBy(task.alias("task")).agg(F.sum("n").alias("all"))
    starts = sizes.select("task", F.coalesce(F.sum("all").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))  # a row a task
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("task").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranged.withColumn("task", task).withColumn("earlier", earlier).join(F.broadcast(starts), "task")
    return placed.select("part", F.lit(REST).alias("of"), "from", (F.col("from") + F.col("n")).alias("to"), (F.col("start") + F.col("earlier") - F.col("from")).alias("less"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block_rows: int = BLOCK_ROWS, most: int = BROADCAST_ROWS) -> DataFrame:
    """docs (doc_id, source, ...) with mix_slot, mix_block, mix_position: the place of each row in the mixed order, from 0.

    weights gives each source's share; sources that it lacks share the mean weight, and without it shares follow
    tempered(). A null source is a source of its own, and so is each other value, even if there is no row that it had
    weight for. Rows are placed one by one, whatever their doc_id, so it may be null or repeat, and rows that are equal each
    get a place; texts may be null, empty or of any length. Within a source rows keep the order of the table's parts, which
    is the same again for the same files, settings and cluster. A table without rows gives none. Columns of docs stay as
    they are; a column of docs with one of the new names, in any case, is left out. There may be any number of sources: the
    MOST_SOURCES of most rows have windows of their own, all others share those of one source with the sum of their weights,
    within which their blocks run by deadlines of their own, sorted by Spark, so the driver's work has a bound. most: rows of the table of counts by part and source (and block, of such others) to broadcast at once; beyond,
    ranges of parts are placed one after another.
    """
    new = ("mix_slot", "mix_block", "mix_position")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in new])
    pre = "__mix_"
    while any(c.lower().startswith(pre) for c in docs.columns):
        pre += "_"
    spark, own = docs.sparkSession, lambda c: F.col(pre + c)
    name = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    shares, label, weight = _shares(docs.select(name.alias("of")), {f"={x}": w for x, w in (weights or {}).items()})
    rows = numbered(docs.withColumn(pre + "of", label(name)).withColumn(pre + "name", name).sortWithinPartitions(pre + "of", pre + "name"), pre + "at")
    part = F.shiftright(own("at"), _PART)
    parts = written(rows.groupBy(part.alias("part"), own("of").alias("of"), own("name").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.min(own("at")).alias("from")))
    counts = {r.of: r.n for r in parts.groupBy("of").agg(F.sum("n").alias("n")).collect()}
    plan = phases(counts, shares, block_rows)
    ends = [*(p.done for p in plan), {}][1:]
    told = [(x, p.done[x], end.get(x), p.first, p.quotas[x], p.short, p.places[x]) for p, end in zip(plan, ends, strict=True) for x in p.done]
    spans = F.broadcast(spark.createDataFrame(told, "of string, done long, until long, first long, quota long, short long, places array<int>").withColumnsRenamed({c: pre + "s_" + c for c in ("of", "done", "until", "first", "quota", "short", "places")}))
    before = F.sum("n").over(Window.partitionBy("of").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    lone = parts.filter(F.col("of") != REST).select("part", "of", "from", (F.col("from") + F.col("n")).alias("to"), (F.coalesce(before, F.lit(0)) - F.col("from")).alias("less"))
    if REST in counts:
        lone = lone.unionByName(_within_rest(parts.filter(F.col("of") == REST).drop("of"), weight, block_rows))
    offsets = written(lone.withColumnsRenamed({c: pre + "p_" + c for c in ("part", "of", "from", "to", "less")}))
    discard(parts)

    def placed(some: DataFrame, there: DataFrame) -> DataFrame:
        out = some.join(F.broadcast(there), (part == own("p_part")) & (own("of") == own("p_of")) & (own("at") >= own("p_from")) & (own("at") < own("p_to"))).withColumn(pre + "rank", own("at") + own("p_less"))
        out = out.withColumn(pre + "block", F.floor(own("rank") / block_rows).cast("long"))
        out = out.join(spans, (own("of") == own("s_of")) & (own("block") >= own("s_done")) & (own("s_until").isNull() | (own("block") < own("s_until"))))
        turn = own("block") - own("s_done")
        slot = own("s_first") + F.floor(turn / own("s_quota")).cast("long") * SCALE + F.get(own("s_places"), (turn % own("s_quota")).cast("int"))
        return out.withColumn("mix_slot", slot).select(*(F.col(f"`{c}`") for c in docs.columns), "mix_slot", own("block").alias("mix_block"), (F.col("mix_slot") * block_rows - own("s_short") + own("rank") % block_rows).alias("mix_position"))

    cuts, held = [None], 0
    if offsets.count() > most:
        for p, n in offsets.groupBy(pre + "p_part").agg(F.count(F.lit(1))).orderBy(pre + "p_part").toLocalIterator():
            if held and held + n > most:
                cuts.append(p)
                held = 0
            held += n
    out = None
    for lo, hi in zip(cuts, [*cuts[1:], None], strict=True):
        some, there = rows, offsets
        if lo is not None:
            some, there = some.filter(own("at") >= lo << _PART), there.filter(own("p_part") >= lo)
        if hi is not None:
            some, there = some.filter(own("at") < hi << _PART), there.filter(own("p_part") < hi)
        out = placed(some, there) if out is None else out.union(placed(some, there))
    return out


def mixed_order(docs: DataFrame, **how) -> DataFrame:
    """mix(), sorted by mix_position over the whole table (a range-partitioned sort of a written table, so ranks are computed once)."""
    return written(mix(docs, **how)).orderBy("mix_position")
