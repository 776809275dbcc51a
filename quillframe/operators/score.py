"""Extractions against gold, cell by cell. The measure is precision: gold lines that an extraction lacks are not counted.

Tables: lines(doc_id, line_no, code_produit), cells(doc_id, line_no, month, quantity).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillframe.functions import exprs as x


def last_lines(lines: DataFrame) -> DataFrame:
    """JN1: of lines with the same code, the last one."""
    return lines.groupBy("doc_id", "code_produit").agg(F.max("line_no").alias("line_no"))


def matched_cells(expected_lines: DataFrame, expected_cells: DataFrame | None, actual_lines: DataFrame, actual_cells: DataFrame | None) -> DataFrame:
    """JN1, JN2: (doc_id, line_no, code_produit, month, expected, actual) over the months of either side, for each actual line whose code the gold has; and a row without a month for each other actual line. A side without cells has its quantities by month in a map own of its lines, of which a line_no is one."""
    gold, actual = _with_months(expected_lines, expected_cells), _with_months(actual_lines, actual_cells)
    no = lambda like: F.lit(None).cast(like.schema["line_no"].dataType)
    none = F.lit(None).cast("map<string,double>")
    sides = gold.filter("code_produit is not null").select("doc_id", "code_produit", F.col("line_no").alias("gold_no"), no(actual).alias("line_no"), F.col("months").alias("gold"), none.alias("own"))
    sides = sides.unionByName(actual.select("doc_id", "code_produit", no(gold).alias("gold_no"), "line_no", none.alias("gold"), F.col("months").alias("own")))
    # a code's last gold line comes first, then the actual lines
    by = Window.partitionBy("doc_id", "code_produit").orderBy(F.col("gold_no").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    pairs = sides.select("doc_id", "line_no", "code_produit", F.first("gold").over(by).alias("gold"), "own").filter("line_no is not null")
    # first the months of the gold, then the line's others; a line that the gold lacks has one row without a month
    month = F.transform(F.array_union(F.map_keys("gold"), F.map_keys("own")), lambda m: F.struct(m.alias("month"), F.try_element_at("gold", m).alias("expected"), F.try_element_at("own", m).alias("actual")))
    missing = F.array(F.lit(None).cast("struct<month:string,expected:double,actual:double>"))
    told = pairs.select("doc_id", "line_no", "code_produit", F.inline_outer(F.coalesce(F.when(F.col("gold").isNotNull(), F.filter(month, lambda m: m.month.isNotNull())), missing)), F.col("gold").isNull().alias("extra"))
    return told.filter("extra or month is not null").drop("extra")


def _with_months(lines: DataFrame, cells: DataFrame | None) -> DataFrame:
    """(doc_id, line_no, code_produit, months) of each line, its quantities by month in a map; of several quantities of a month the greatest."""
    if cells is None:
        return lines.select("doc_id", "line_no", "code_produit", F.col("own").alias("months"))
    own = cells.select("doc_id", "line_no", F.lit(None).cast("string").alias("code_produit"), "month", F.col("quantity").cast("double").alias("quantity"), F.lit(False).alias("line"))
    both = lines.select("doc_id", "line_no", F.col("code_produit").alias("code_produit"), F.lit(None).cast("string").alias("month"), F.lit(None).cast("double").alias("quantity"), F.lit(True).alias("line")).unionByName(own)
    both = both.groupBy("doc_id", "line_no", "month").agg(F.max("code_produit").alias("code_produit"), F.max("quantity").alias("quantity"), F.max("line").alias("line"))
    found = both.groupBy("doc_id", "line_no").agg(F.max("code_produit").alias("code_produit"), F.map_from_entries(F.collect_list(F.when(F.col("month").isNotNull(), F.struct("month", "quantity")))).alias("months"), F.max("line").alias("line"))
    return found.filter("line").drop("line")


def diffs(cells: DataFrame) -> DataFrame:
    """(doc_id, path, expected, actual) of each cell that differs and each line that the gold lacks."""
    wrong = cells.filter(F.col("month").isNull() | ~F.col("expected").eqNullSafe(F.col("actual")))
    line = F.concat(F.lit("lines["), F.col("code_produit"), F.lit("]"))
    path = F.when(F.col("month").isNull(), line).otherwise(F.concat(line, F.lit(".quantities["), F.col("month"), F.lit("]")))
    side = lambda c, missing: F.when(F.col("month").isNull(), missing).otherwise(x.plain_number(F.col(c)))
    return wrong.select("doc_id", path.alias("path"), side("expected", F.lit("<missing>")).alias("expected"), side("actual", F.col("code_produit")).alias("actual"))


def precision(matched, compared):
    """Matched / compared, and 1 if nothing was compared."""
    return F.when(compared == 0, F.lit(1.0)).otherwise(matched / compared)


def by_document(documents: DataFrame, cells: DataFrame, reconciled: DataFrame | None = None) -> DataFrame:
    """(doc_id, cells_compared, cells_matched, cell_precision[, reconciled_rate]). reconciled: (doc_id, expected, actual) booleans; the rate is 1 where they agree."""
    ok = F.col("expected").eqNullSafe(F.col("actual"))
    counts = cells.filter("month is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("cells_compared"), F.count(F.when(ok, 1)).alias("cells_matched"))
    out = documents.select("doc_id").join(counts, "doc_id", "left").na.fill(0, ["cells_compared", "cells_matched"])
    out = out.withColumn("cell_precision", precision(F.col("cells_matched"), F.col("cells_compared")))
    if reconciled is None:
        return out
    return out.join(reconciled.select("doc_id", (F.col("expected") == F.col("actual")).cast("double").alias("reconciled_rate")), "doc_id", "left")


def dataset(scores: DataFrame) -> DataFrame:
    """One row (files_evaluated, cells_compared, cells_matched, cell_precision, reconciled_rate): precision over all cells, the rate over files."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return scores.agg(
        F.count(F.lit(1)).alias("files_evaluated"),
        total("cells_compared").alias("cells_compared"),
        total("cells_matched").alias("cells_matched"),
        precision(total("cells_matched"), total("cells_compared")).alias("cell_precision"),
        F.coalesce(F.avg("reconciled_rate"), F.lit(0.0)).alias("reconciled_rate"),
    )


def worst(scores: DataFrame, n: int = 10) -> DataFrame:
    """T-1: the n files of least precision, in input order where equal."""
    return scores.orderBy("cell_precision", "doc_id").limit(n)


def first_diffs(found: DataFrame, n: int = 10) -> DataFrame:
    """T-2: the first n differences, by document and path."""
    return found.orderBy("doc_id", "path").limit(n)
