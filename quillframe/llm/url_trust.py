"""URL verdicts: list rules first, then trust and distrust that flow along links between hosts.

Hosts are nodes; an edge (source, target) weighs as many pages as link from one to the other. Trust is a personalised
PageRank that starts at hosts whose pages an allow rule fits; distrust is one on the reversed edges that starts at hosts
whose pages a block rule fits (who links to bad hosts is suspect). Mass at hosts without outgoing edges would return to
the seeds, which only scales the vector, so it is left out and the vectors are scaled to a sum of 1 at the end. A host is
blocked if its share distrust / (trust + distrust) exceeds the threshold. Only DataFrame operations are used: each step
moves the mass that arrived in the step before, by one join on the host and one sum, and adds it up; steps are written to
the shared folder every CUT of them, and end when what still moves is at most TOLERANCE of the mass at the start.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm._common import discard, small, written

DAMPING, TOLERANCE, CUT, THRESHOLD = 0.85, 1e-4, 4, 0.5
#: Decimals to which shares are compared with the threshold, so that the order of a sum decides no tie.
DECIMALS = 9
#: Rules up to this many are literals of the plan; more are a table that is joined.
LITERAL_RULES = 200
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?:[hH][rR][eE][fF]|[sS][rR][cC])\s*=\s*["']?(?:[hH][tT][tT][pP][sS]?:)?//([^/?#"'\s<>]+)"""


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the host's end up to ?, # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def steps_to(tolerance: float = TOLERANCE, damping: float = DAMPING) -> int:
    """Steps after which at most this part of the mass still moves, whatever the graph."""
    return max(1, math.ceil(math.log(tolerance) / math.log(damping)))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The struct (verdict, rule) of the longest rule that fits, or null. A rule is (verdict, host/path); of two alike the first counts."""
    if not rules:
        return F.lit(None).cast("struct<verdict:string,rule:string>")
    parts = sorted(((v, r, *r.partition("/")[::2]) for v, r in rules), key=lambda x: -len(x[1]))
    listed = F.array(*(F.struct(F.lit(v).alias("verdict"), F.lit(r).alias("rule"), F.lit(h).alias("host"), F.lit(f"/{p}" if "/" in r else "").alias("path")) for v, r, h, p in parts))
    fit = F.get(F.filter(listed, lambda r: ((host == r.host) | F.endswith(host, F.concat(F.lit("."), r.host))) & F.startswith(path, r.path)), F.lit(0))
    return F.when(fit.isNotNull(), F.struct(fit.verdict.alias("verdict"), fit.rule.alias("rule")))


def with_rules(plain: DataFrame, rules: list[tuple[str, str]], literals: int = LITERAL_RULES) -> DataFrame:
    """plain (host, path, ...) with the column r, the struct of rule_of(). Many rules are a table that is joined on each ending of the host."""
    if len(rules) <= literals:
        return plain.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    spark = plain.sparkSession
    rows = [(i, v, r, r.partition("/")[0], f"/{r.partition('/')[2]}" if "/" in r else "") for i, (v, r) in enumerate(rules)]
    listed = spark.createDataFrame(rows, "no long, verdict string, rule string, ending string, start string")
    labels = F.split("host", r"\.", -1)
    endings = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    seen = written(plain.select("host", "path").distinct())
    fits = seen.select("host", "path", F.explode(endings).alias("ending")).join(small(listed, len(rows)), "ending").filter(F.startswith("path", "start"))
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct("verdict", "rule"), F.struct(F.length("rule"), -F.col("no"))).alias("r"))
    return plain.join(best, ["host", "path"], "left").select(*plain.columns, "r")


def host_edges(pages: DataFrame) -> DataFrame:
    """(source, target, weight) between different hosts: the number of pages of source that link to target."""
    own = pages.select(host_of(F.col("url")).alias("source"), F.explode_outer(F.array_distinct(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), 1))).alias("t"))
    own = own.select("source", F.translate("t", UPPER, LOWER).alias("target")).filter("target is not null").filter("source <> '' and target <> '' and source <> target")
    return own.groupBy("source", "target").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust), each scaled to a sum of 1 over hosts, from edges and seeds (host, trusted, blocked)."""
    both = edges.select(F.lit("t").alias("kind"), F.col("source").alias("host"), F.col("target").alias("to"), "weight").union(edges.select(F.lit("b"), "target", "source", "weight"))
    out = both.groupBy("kind", "host").agg(F.sum("weight").alias("total"))
    flow = written(both.join(out, ["kind", "host"]).select("kind", "host", "to", (damping * F.col("weight") / F.col("total")).alias("share")))
    state = written(seeds.select("host", F.expr("stack(2, 't', trusted, 'b', blocked) as (kind, wave)")).filter("wave > 0").select("kind", "host", "wave", F.col("wave").alias("mass")))
    steps, moving = steps_to(tolerance, damping), flow.limit(1).count()
    for i in range(1, steps + 1 if moving else 1):
        moved = state.filter("wave > 0").join(flow, ["kind", "host"]).select("kind", F.col("to").alias("host"), (F.col("wave") * F.col("share")).alias("wave"))
        step = moved.select("*", F.col("wave").alias("mass")).union(state.select("kind", "host", F.lit(0.0), "mass")).groupBy("kind", "host").agg(F.sum("wave").alias("wave"), F.sum("mass").alias("mass"))
        if i % CUT == 0 or i == steps:
            step, old = written(step), state
            discard(old)
            left = step.groupBy("kind").agg((F.sum("wave") > tolerance * (1 - damping) * F.sum("mass")).alias("more"))
            if not left.filter("more").limit(1).count():
                state = step
                break
        state = step
    sums = {r.kind: r.total for r in state.groupBy("kind").agg(F.sum("mass").alias("total")).collect()}
    scaled = lambda k: F.sum(F.when(F.col("kind") == k, F.col("mass")).otherwise(0.0)) / F.lit(sums.get(k) or 1.0)
    return state.groupBy("host").agg(scaled("t").alias("trust"), scaled("b").alias("distrust"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], threshold: float = THRESHOLD, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of each row of pages (page_id, url, html).

    A null url, or one without ://, has an empty host and path, fits no rule and belongs to no host of the graph; null
    html has no links; html of any length is read whole. A page without a rule is blocked if its host's share of distrust,
    to DECIMALS places, exceeds the threshold, and allowed otherwise, as are hosts that neither trust nor distrust reaches
    and shares that equal the threshold. Repeated rows are judged alike and all returned, and count as often as they stand;
    page_id may be null; a table without rows gives none. Other columns are ignored.
    """
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    plain = with_rules(pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), rules)
    hit = lambda v: F.avg(F.when(F.col("r.verdict") == v, 1.0).otherwise(0.0))
    seeds = written(plain.filter("host <> ''").groupBy("host").agg(hit("allow").alias("trusted"), hit("block").alias("blocked")))
    scores = written(propagate(host_edges(pages), seeds, damping, tolerance))
    out = plain.join(small(scores, scores.count()), "host", "left").na.fill(0.0, ["trust", "distrust"])
    both = F.col("trust") + F.col("distrust")
    bad = (both > 0) & (F.round(F.col("distrust") / F.when(both > 0, both), DECIMALS) > threshold)
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce(F.col("r.verdict"), F.when(bad, "block").otherwise("allow")).alias("verdict"), "trust", "distrust")
