"""How filters of documents interact: what each takes out at each place of each order, by a relational pipeline over words.

Words are exploded, counted by (row, word) and then by row, which gives each row's words and distinct words. That is joined,
as outer join, to the flags that need no words, to the least doc_id of texts that occur again, and to labels. Then one
aggregation counts, for each part, the rows of each of the 32 combinations of failed filters, all, good and toxic ones: 32
conditional counts each. All orders of the filters follow from these counts alone, in rows of the parts.

Rows carry a number of their own (a written table), and texts are dealt by it once before they are exploded: then both
aggregations over words stay within a task's rows, so no word is ever shuffled, and a text lies in one task but no
group of texts does. Rows are dealt by hash of their number, so neither copies nor a source nor a common word makes a hot
task; the join by text is one that adaptive execution can split, and parts are summed before they are shuffled.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm._common import numbered, scratch, small, written

FILTERS = "ABCDE"
#: Words of A and, in a hundred, shares of distinct words of B and of capital letters of C; signs of D.
LEAST_WORDS, DISTINCT, CAPITALS, SIGNS = 200, 50, 2, r"[#$%&*|]"
GAPS = r"[\x20\x09-\x0D]+"
KINDS = ("all", "good", "toxic")


def word_counts(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, words, kinds): the words and distinct words of each row of rows(key, text) that has any; key must not repeat."""
    words = rows.select(key, text).repartition(key).select(key, F.explode(F.split(text, GAPS)).alias("word")).filter("word <> ''")
    by_word = words.groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"))
    return by_word.groupBy(key).agg(F.sum("n").alias("words"), F.count(F.lit(1)).alias("kinds"))


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, part, mask, good, toxic) of each row of docs (doc_id, source, text); bit i of mask: it fails filter i of FILTERS. A written table.

    A null text counts as empty, a null source as an empty one. A row with a null doc_id has no smaller one and so passes E,
    and has no labels; a doc_id with several labels is good, or toxic, if one of them says so. Repeated rows each count.
    """
    with scratch() as keep:
        key, text = "row", F.coalesce(F.col("text").cast("string"), F.lit(""))
        rows = numbered(docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text")), key)
        capitals = F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))
        flags = rows.select(key, "doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), (100 * capitals > CAPITALS * F.length("text")).alias("C"), F.col("text").rlike(SIGNS).alias("D"))
        facts = written(flags.join(word_counts(rows, key, "text"), key, "left"))
        again = written(facts.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
        is_one = lambda c: F.coalesce(F.max(F.col(c).cast("int") == 1), F.lit(False))
        told = written(labels.filter("doc_id is not null").groupBy("doc_id").agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic")).filter("good or toxic"))
        all_ = facts.join(small(again, again.count()), "digest", "left").join(small(told, told.count()), "doc_id", "left")
        words, kinds, no = F.coalesce("words", F.lit(0)), F.coalesce("kinds", F.lit(0)), F.lit(False)
        fails = (words < LEAST_WORDS, 100 * kinds < DISTINCT * words, F.col("C"), F.col("D"), F.coalesce(F.col("doc_id") > F.col("least"), no))
        mask = sum(F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails))
        return keep(written(all_.select("doc_id", "part", mask.alias("mask"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))))


def combinations(fails: DataFrame) -> DataFrame:
    """(part, all, good, toxic): of rows(part, mask, good, toxic), arrays of 32 counts, one for each value of mask."""
    whose = {"all": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    counts = [F.count_if((F.col("mask") == m) & whose[k]).alias(f"{k}_{m}") for k in KINDS for m in range(1 << len(FILTERS))]
    return fails.groupBy("part").agg(*counts).select("part", *(F.array(*(f"{k}_{m}" for m in range(1 << len(FILTERS)))).alias(k) for k in KINDS))


def left_after(counts: Column) -> Column:
    """For each set of filters, as bits: the rows that fail none of them."""
    sets = F.array(*(F.lit(s) for s in range(1 << len(FILTERS))))
    return F.transform(sets, lambda s: F.aggregate(F.transform(counts, lambda n, m: F.when(m.bitwiseAND(s) == 0, n).otherwise(0)), F.lit(0).cast("long"), lambda a, n: a + n))


def orders() -> list[tuple[str, int, int, int]]:
    """(filter_order, step, the filter's number, the filters before it as bits) of all orders."""
    out = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(order, 1):
            out.append(("".join(FILTERS[i] for i in order), step, f, before))
            before |= 1 << f
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of each part, order and step.

    docs has doc_id, source and text, labels doc_id, quality and toxic; for null, repeated and odd rows see failures(). Every
    part has all 600 rows, with zeros; without documents there are none. Texts may be of any length, other columns are ignored.
    """
    counts = combinations(failures(docs, labels)).select("part", "all", *(left_after(F.col(k)).alias(f"left_{k}") for k in KINDS))
    plan = F.array(*(F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(b).alias("before"), F.lit(1 << f).alias("bit")) for o, s, f, b in orders()))
    steps = counts.select("*", F.explode(plan).alias("x")).select("*", "x.*")
    at = lambda k, s: F.get(F.col(f"left_{k}"), s)
    after = F.col("before").bitwiseOR(F.col("bit"))
    lost = lambda k: at(k, F.col("before")) - at(k, after)
    # a filter finds the same set before it in |set|! * (4 - |set|)! orders
    ways, n = (24, 6, 4, 6, 24), len(FILTERS)
    shares = F.array(*(F.lit(ways[bin(s).count("1")] if s < (1 << n) - 1 else 0) for s in range(1 << n)))
    added = F.transform(F.col("left_all"), lambda x, s: F.when(s.bitwiseAND(F.col("bit")) == 0, F.get(shares, s) * (x - F.get(F.col("left_all"), s.bitwiseOR(F.col("bit"))))).otherwise(0))
    return steps.select(
        "part",
        "filter_order",
        "step",
        at("all", after).alias("kept"),
        lost("all").alias("removed"),
        (at("all", F.lit(0)) - at("all", F.col("bit")) - lost("all")).alias("redundant"),
        F.get("all", F.col("bit")).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        F.aggregate(added, F.lit(0).cast("long"), lambda a, x: a + x).alias("shapley"),
    )
