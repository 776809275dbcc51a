"""Statements laid out as tables again: the cells and text lines of a printed page, without drawing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.functions import exprs as x
from quillframe.plans.rules import DEFAULT, Rules

# Headers of a printed grid.
HEADERS = ("Code EAN", "Désignation", "PA cat", "PA cat net", "PV TTC")


def monthly_grid(lines: DataFrame, cells: DataFrame, rules: Rules = DEFAULT, totals: bool = True) -> DataFrame:
    """K6, A10: raw_cells of a grid per document; see monthly_rows(). lines(doc_id, line_no, code_produit, designation, pa_cat, pa_cat_net, pv_ttc), cells(doc_id, line_no, month, quantity), of which those of one month are summed."""
    own = cells.groupBy("doc_id", "line_no", "month").agg(F.sum("quantity").alias("quantity")).groupBy("doc_id", "line_no").agg(F.map_from_entries(F.collect_list(F.struct("month", F.col("quantity").cast("double")))).alias("own"))
    # a document's months may be those of cells without a line
    rows = monthly_rows(lines.join(own, ["doc_id", "line_no"], "full"), rules, totals)
    # the outer form, as the inner one makes Spark compute the values once more for a filter on their number
    long = rows.select("doc_id", F.lit(1).alias("page_no"), "table_no", "row_no", F.posexplode_outer("texts").alias("col_no", "value"))
    return long.filter("col_no is not null")


def monthly_rows(lines: DataFrame, rules: Rules = DEFAULT, totals: bool = True) -> DataFrame:
    """K6, A10: (doc_id, table_no, row_no, cols, texts) of a grid per document, a row per row, of lines with their quantities by month in a map own; a null code_produit is no line: five fixed columns and one per month, in order; a missing cell prints 0; a last row TOTAL has the sum of each month. Lines are joined with their document's months alone, so lines that are dealt by doc_id are not shuffled."""
    sums = lines.select("doc_id", F.when(F.col("code_produit").isNotNull(), F.col("line_no")).alias("line_no"), F.explode_outer("own").alias("month", "q")).groupBy("doc_id", "month").agg(F.sum("q").cast("double").alias("s"), F.min("line_no").alias("first"), F.max("line_no").alias("last"))
    sums = sums.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.when(F.col("month").isNotNull(), F.struct("month", "s")))).alias("sums"), F.min("first").alias("first"), F.max("last").alias("last")).filter("size(sums) > 0")
    fixed = F.array("code_produit", "designation", *(x.french_number(F.col(c)) for c in ("pa_cat", "pa_cat_net", "pv_ttc")))
    found = F.transform("sums", lambda m: x.plain_number(F.coalesce(F.try_element_at("own", m.month), F.lit(0.0))))
    heads = F.concat(F.array(*map(F.lit, HEADERS)), F.transform("sums", lambda m: x.month_label(m.month, rules)))
    row = lambda at, values: F.struct(at.cast("long").alias("row_no"), values.alias("texts"))
    body = lines.filter("code_produit is not null").select("doc_id", "line_no", "own", fixed.alias("fixed"))
    none, words = F.lit(None).cast("struct<row_no:bigint,texts:array<string>>"), F.array(F.lit(""), F.lit("TOTAL"), *[F.lit("")] * (len(HEADERS) - 2))
    line, no = row(F.col("line_no") + 1, F.concat("fixed", found)), F.col("line_no")
    head, total = row(F.lit(0), heads), row(F.col("last") + 2, F.concat(words, F.transform("sums", lambda m: x.plain_number(m.s)))) if totals else none
    edge = no.isNull() | (no == F.col("first")) | (no == F.col("last"))
    parts = F.when(~edge, F.array(line)).otherwise(F.array(F.when(no.isNull() | (no == F.col("first")), head), F.when(no.isNotNull(), line), F.when(no == F.col("last"), total)))
    rows = sums.join(body, "doc_id", "left").select("doc_id", F.lit(0).alias("table_no"), F.inline_outer(parts)).filter("row_no is not null")
    return rows.select("doc_id", "table_no", "row_no", F.sequence(F.lit(0), F.size("texts") - 1).alias("cols"), "texts")


def transactions(lines: DataFrame, cells: DataFrame) -> DataFrame:
    """(doc_id, line_no, code_produit, designation, date, quantity, amount): one transaction on the first of each month of positive quantity; amounts are blank."""
    positive = cells.filter("quantity > 0").join(lines.select("doc_id", "line_no", "code_produit", "designation"), ["doc_id", "line_no"])
    return _transactions(positive)


def transactions_of(lines: DataFrame) -> DataFrame:
    """transactions() of lines with their quantities by month in a map own, without a join."""
    return _transactions(lines.select("doc_id", "line_no", "code_produit", "designation", F.explode("own").alias("month", "quantity")).filter("quantity > 0"))


def _transactions(positive: DataFrame) -> DataFrame:
    return positive.select("doc_id", "line_no", "code_produit", "designation", F.concat("month", F.lit("-01")).alias("date"), x.plain_number(F.col("quantity").cast("double")).alias("quantity"), F.lit("").alias("amount"))


def page_header(documents: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """K8: (doc_id, text) of the lines above a table: signature, name, address, id and supplier."""
    lines = (x.signature(F.col("lgo"), rules), x.text(F.col("pharmacy_name")), x.text(F.col("address")), F.concat(F.lit("ID: "), x.text(F.col("pharmacy_id"))), F.concat(F.lit("Fournisseur: "), x.text(F.col("supplier"))))
    return documents.select("doc_id", F.concat_ws("\n", *lines).alias("text"))
