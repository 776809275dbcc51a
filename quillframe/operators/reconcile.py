"""Printed totals against computed sums, month by month."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.functions import exprs as x


def month_sums(cells: DataFrame) -> DataFrame:
    """A4, A10: (doc_id, month, computed): sums over all lines, in double precision."""
    return cells.groupBy("doc_id", "month").agg(F.sum(F.col("quantity").cast("double")).alias("computed"))


def compared(cells: DataFrame, printed: DataFrame) -> DataFrame:
    """JN3: (doc_id, month, printed, computed, ok) for the months that are printed; a month without cells has the sum 0."""
    out = printed.select("doc_id", "month", F.col("quantity").cast("double").alias("printed")).join(month_sums(cells), ["doc_id", "month"], "left")
    out = out.withColumn("computed", F.coalesce("computed", F.lit(0.0)))
    return out.withColumn("ok", F.col("computed") == F.col("printed"))


def reconcile(cells: DataFrame, printed: DataFrame) -> DataFrame:
    """A4: (doc_id, totals_reconciled, flags) of documents with printed totals; flags are in order of months."""
    told = F.concat(F.lit("month "), F.col("month"), F.lit(": computed="), x.float_text(F.col("computed")), F.lit(", printed="), x.plain_number(F.col("printed")))
    flags = F.transform(F.array_sort(F.collect_list(F.when(~F.col("ok"), F.struct("month", told.alias("flag"))))), lambda f: f.flag)
    return compared(cells, printed).groupBy("doc_id").agg(F.min("ok").alias("totals_reconciled"), flags.alias("flags"))


def reconcile_export(documents: DataFrame, cells: DataFrame, printed: DataFrame) -> DataFrame:
    """A5: (doc_id, totals_reconciled) of all documents; without printed totals it is false, and there are no flags."""
    found = compared(cells, printed).groupBy("doc_id").agg(F.min("ok").alias("ok"))
    return documents.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("ok", F.lit(False)).alias("totals_reconciled"))


def reconcile_sales(told: DataFrame) -> DataFrame:
    """reconcile_export() of told(doc_id, sales) with a row a doc_id, each sale being a struct (month, quantity, printed) with one of the numbers: rows that lie together by document need no shuffle, and nothing is joined."""
    months = told.select("doc_id", F.inline_outer("sales")).groupBy("doc_id", "month").agg(F.sum(F.col("quantity").cast("double")).alias("computed"), F.max(F.col("printed").cast("double")).alias("printed"))
    ok = F.when(F.col("printed").isNotNull(), F.coalesce("computed", F.lit(0.0)) == F.col("printed"))
    return months.groupBy("doc_id").agg(F.coalesce(F.min(ok), F.lit(False)).alias("totals_reconciled"))


def structure(documents: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, row_count, flags): documents without lines are flagged."""
    counts = lines.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return documents.select("doc_id").join(counts, "doc_id", "left").select("doc_id", n.alias("row_count"), F.when(n == 0, F.array(F.lit("no product lines extracted"))).otherwise(F.array().cast("array<string>")).alias("flags"))
