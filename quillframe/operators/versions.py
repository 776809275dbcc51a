"""Rule tables that change over time: each document is read by the rules that were in force on its day.

A versioned table has a row for each rule of each version: (valid_from, alias, field), (valid_from, token, month) or
(valid_from, lgo, signature, priority). A version is all rows with one valid_from, and is in force from that day until the
next one. Documents before the first version have no rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillframe.functions import exprs as x
from quillframe.sources import tables


def in_force(documents: DataFrame, rules: DataFrame, day: str) -> DataFrame:
    """documents with valid_from: the last version of rules(valid_from) that began on the day of documents(day) or before, or null; an as-of join.

    The distinct days of both sides are put in order, and each takes the last version so far; documents then join on equal
    days. Days are bounded by the calendar, so one task may order them, whatever the number of documents is.
    """
    own, begun = F.col(day).cast("date").alias("__day"), F.col("valid_from").cast("date")
    marks = documents.select(own, F.lit(None).cast("date").alias("valid_from")).union(rules.select(begun.alias("__day"), begun.alias("valid_from")))
    marks = marks.filter("__day is not null").groupBy("__day").agg(F.max("valid_from").alias("valid_from"))
    known = tables.once(marks.select("__day", F.last("valid_from", ignorenulls=True).over(Window.orderBy("__day")).alias("valid_from")))
    return documents.withColumn("__day", own).join(tables.small(known, known.count()), "__day", "left").drop("__day")


def columns(headers: DataFrame, aliases: DataFrame, label: str = "label", day: str = "day") -> DataFrame:
    """F1 by version: headers(label, day, ...) with field, the canonical column of the header cell under aliases(valid_from, alias, field), or null. Aliases are compared stripped and lower-cased; of several fields of one alias in a version the least counts."""
    key = F.lower(x.strip(F.col("alias")))
    own = aliases.select(F.col("valid_from").cast("date").alias("valid_from"), key.alias("__key"), "field").groupBy("valid_from", "__key").agg(F.min("field").alias("field"))
    own = tables.once(own)
    found = in_force(headers, aliases, day).withColumn("__key", F.lower(x.strip(F.col(label))))
    return found.join(tables.small(own, own.count()), ["valid_from", "__key"], "left").drop("__key", "valid_from")


def months(labels: DataFrame, tokens: DataFrame, label: str = "label", day: str = "day", reference_year: str = "reference_year") -> DataFrame:
    """F2 by version: labels(label, day, reference_year, ...) with month, as yyyy-MM, of the first token by rank that is a word of the label under tokens(valid_from, token, month, rank); the year is the first 20xx of the label, else the reference year."""
    own = tokens.select(F.col("valid_from").cast("date").alias("valid_from"), F.struct("rank", F.lower(x.strip(F.col("token"))).alias("token"), F.lpad(F.col("month").cast("string"), 2, "0").alias("month")).alias("t"))
    own = tables.once(own.groupBy("valid_from").agg(F.sort_array(F.collect_list("t")).alias("__tokens")))  # a row a version, of one rule table
    found = in_force(labels, tokens, day).join(tables.small(own, own.count()), "valid_from", "left")
    low = F.lower(x.strip(F.col(label)))
    words = F.split(low, r"[^\p{L}\p{N}_]+")
    first = F.get(F.filter("__tokens", lambda t: F.array_contains(words, t.token)), F.lit(0))
    year = F.coalesce(F.nullif(F.regexp_extract(low, "(20[0-9]{2})", 1), F.lit("")), F.col(reference_year).cast("string"))
    return found.withColumn("month", F.concat(year, F.lit("-"), first.month)).drop("__tokens", "valid_from")
