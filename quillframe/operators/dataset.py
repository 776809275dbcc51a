"""Training examples and their split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.sources import tables


#: Bits of a hash by which one round of smallest() counts, and the hashes that are left when it stops counting.
ROUND_BITS, LEFT = 12, 1024


def smallest(hashes: DataFrame, ranks: list[int]) -> dict[int, str]:
    """For each rank from 1, the value at it of the sorted distinct md5 sums h of hashes(h), or the last if there are fewer; none for an empty table.

    Each round counts values by their next ROUND_BITS bits, which gives the driver 2 ** ROUND_BITS counts at most, and goes
    on within the one range that holds the rank, until LEFT values are left, which are sorted on the driver. So no task and
    no driver holds more than that, whatever the ranks are.
    """
    digits, total, out = ROUND_BITS // 4, hashes.count(), {}
    for rank in {min(r, total) for r in ranks if r > 0} if total else ():
        prefix, before, n = "", 0, total
        while n > LEFT and len(prefix) < 32:
            own = hashes.filter(F.startswith("h", F.lit(prefix))) if prefix else hashes
            counts = own.groupBy(F.substring("h", len(prefix) + 1, digits).alias("next")).agg(F.count(F.lit(1)).alias("n")).collect()
            for r in sorted(counts, key=lambda r: r.next):
                if before + r.n >= rank:
                    prefix, n = prefix + r.next, r.n
                    break
                before += r.n
        left = sorted(r.h for r in hashes.filter(F.startswith("h", F.lit(prefix))).collect())
        out[rank] = left[rank - before - 1]
    return {r: out[min(r, total)] for r in ranks if r > 0} if total else {}


def split(items: DataFrame, key: str, val: int, test: int, seed: int) -> DataFrame:
    """Items with a column split: of their distinct keys, the first test ones in the order of a seeded hash, then val ones, and the rest train. All rows of a key are in one part, and none is added. smallest() finds the last key of test and of val, at any size of the parts; the parts follow from comparing with these two, without a join. A null key is in train."""
    order = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))
    keys = tables.once(items.select(order.alias("h")).filter("h is not null").distinct())
    last = smallest(keys, [test, test + val])
    tables.discard(keys)
    out = F.lit("train")
    for name, n in (("val", test + val), ("test", test)):
        if n in last:
            out = F.when(order <= last[n], name).otherwise(out)
    return items.withColumn("split", out)


def examples(documents: DataFrame, template: str) -> DataFrame:
    """(image, template, output) of documents(image, output)."""
    return documents.select("image", F.lit(template).alias("template"), "output")


def short_enough(items: DataFrame, column: str, most: int) -> DataFrame:
    """Rows whose text has so many characters at most."""
    return items.filter(F.length(column) <= most)


def head(lines: DataFrame, n: int, row_no: str = "row_no") -> DataFrame:
    """S7, T-4: of lines(row_no, value), the first n before the first blank one. files.lines() numbers the lines of a file."""
    stop = lines.filter(F.trim(F.regexp_replace("value", r"\s", "")) == "").agg(F.min(row_no).alias("stop")).first().stop
    return (lines if stop is None else lines.filter(F.col(row_no) < stop)).orderBy(row_no).limit(n).select(row_no, "value")


def heads(lines: DataFrame, n: int) -> DataFrame:
    """S7 of many files: of lines(path, line_no, value), each file's first n before its first blank one; a file's kept lines are n at most, so no task gathers more of it."""
    stops = lines.filter(F.trim(F.regexp_replace("value", r"\s", "")) == "").groupBy("path").agg(F.min("line_no").alias("stop"))
    return lines.filter(F.col("line_no") < n).join(stops, "path", "left").filter("stop is null or line_no < stop").select("path", "line_no", "value")


def demonstrations(lines: DataFrame, n: int) -> DataFrame:
    """(no, image, output) of the first n examples of lines(line_no, value), a JSON object a line."""
    return head(lines, n, "line_no").select(F.col("line_no").alias("no"), F.from_json("value", "image string, output string").alias("e")).select("no", "e.*")
