"""From raw table cells to lines and month cells.

Tables: raw_cells(doc_id, page_no, table_no, row_no, col_no, value), table_no counted through the document and row_no 0 the
header; page_texts(doc_id, page_no, text). Row order is data: first and last always mean by these numbers. Joins and sums
are on (doc_id, table_no, ...), so a document is spread over tasks by its tables and rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.functions import exprs as x
from quillframe.plans.rules import DEFAULT, FIXED_COLUMNS, Rules
from quillframe.sources import tables

TABLE, ROW = ["doc_id", "table_no"], ["doc_id", "table_no", "row_no"]
LAYOUT = ["fields", "months", "repeats"]


def document_text(page_texts: DataFrame) -> DataFrame:
    """(doc_id, text, page_count): a document's pages in order, joined by newlines; page_count is 1 at least."""
    pages = F.transform(F.array_sort(F.collect_list(F.struct("page_no", x.text(F.col("text")).alias("text")))), lambda p: p.text)
    return page_texts.groupBy("doc_id").agg(F.array_join(pages, "\n").alias("text"), F.greatest(F.count(F.lit(1)), F.lit(1)).cast("int").alias("page_count"))


def layouts(raw_cells: DataFrame, years: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """(doc_id, table_no, fields, months, repeats) of each table with a header: fields maps known columns to their (last) column number, months lists (col_no, month) of other header cells that name a month, in order, and repeats tells that a month is there twice. years: (doc_id, reference_year); documents without one count from 2000."""
    heads = gathered(raw_cells.filter("row_no = 0")).join(years, "doc_id", "left")
    return _with_layout(heads, F.lit(True), rules).select(*TABLE, *LAYOUT)


def _with_layout(rows: DataFrame, head: Column, rules: Rules) -> DataFrame:
    """gathered() rows with reference_year, and the layout of those that are headers, null in others."""
    cells = F.zip_with("cols", "texts", lambda c, v: F.struct(x.normalize_column(v, rules).alias("field"), c.alias("col_no"), v.alias("value")))
    fixed = lambda c: F.coalesce(c.field.isin(*FIXED_COLUMNS), F.lit(False))
    named = lambda c: F.struct(c.col_no.alias("col_no"), F.when(~fixed(c), x.normalize_month(c.value, F.coalesce("reference_year", F.lit(2000)), rules)).alias("month"))
    rows = rows.withColumn("cells", F.when(head, cells))
    rows = rows.withColumn("columns", F.sort_array(F.transform(F.filter("cells", lambda c: c.field.isNotNull()), lambda c: F.struct(c.field.alias("field"), c.col_no.alias("col_no")))))
    rows = rows.withColumn("months", F.sort_array(F.filter(F.transform("cells", named), lambda m: m.month.isNotNull())))
    last = F.filter("columns", lambda c, i: ~F.coalesce(F.get(F.col("columns"), i + 1).field == c.field, F.lit(False)))
    return rows.withColumn("fields", F.map_from_entries(last)).withColumn("repeats", F.size(F.array_distinct("months.month")) < F.size("months")).drop("cells", "columns", "reference_year")


def statement_types(found: DataFrame) -> DataFrame:
    """(doc_id, statement_type) by whether the header of a document's first table has a date column; found are layouts."""
    dated = F.min_by(F.map_contains_key("fields", F.lit("date")), "table_no")
    return found.groupBy("doc_id").agg(F.when(dated, "period").otherwise("monthly").alias("statement_type"))


def gathered(raw_cells: DataFrame) -> DataFrame:
    """JN10: (doc_id, table_no, row_no, cols, texts): a row per table row, the columns and the texts of its cells side by side."""
    rows = raw_cells.groupBy(*ROW).agg(F.collect_list(F.struct("col_no", "value")).alias("c"))
    return rows.select(*ROW, F.col("c.col_no").alias("cols"), F.col("c.value").alias("texts"))


def table_rows(raw_cells: DataFrame, found: DataFrame) -> DataFrame:
    """gathered() rows below the headers, each beside its table's layout."""
    return gathered(raw_cells.filter("row_no > 0")).join(found, TABLE)


def laid_rows(rows: DataFrame, years: DataFrame | None = None, rules: Rules = DEFAULT) -> DataFrame:
    """table_rows() of rows that are gathered() already, as decoders give them, and the headers, with the statement_type of each. Rows are sorted within their documents and nothing is joined, so rows that are dealt by doc_id are not shuffled."""
    rows = rows.withColumn("reference_year", F.lit(2000)) if years is None else rows.join(years, "doc_id", "left")
    rows = _with_layout(rows, F.col("row_no") == 0, rules)
    sofar = lambda keys, *order: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    dated = F.first(F.when(F.col("row_no") == 0, F.map_contains_key("fields", F.lit("date"))), True).over(sofar(["doc_id"], "table_no", "row_no"))
    told = rows.select(*ROW, "cols", "texts", *(F.first(c, True).over(sofar(TABLE, "row_no")).alias(c) for c in LAYOUT), dated.alias("dated"))
    return told.filter("fields is not null").withColumn("statement_type", F.when(F.col("dated"), "period").otherwise("monthly")).drop("dated")


def _raw_at(col_no: Column) -> Column:
    return F.get("texts", F.array_position("cols", col_no).cast("int") - 1)


def value_at(col_no: Column) -> Column:
    """The stripped cell of a gathered row, empty where there is none."""
    return x.strip(_raw_at(col_no))


def field_of(name: str) -> Column:
    return value_at(F.try_element_at("fields", F.lit(name)))


def monthly(raw_cells: DataFrame, years: DataFrame, rules: Rules = DEFAULT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A2, A3, P4 of monthly grids; see grid(). The rows that were read are written once, as all three tables come from them."""
    return grid(tables.once(grid_rows(table_rows(raw_cells, layouts(raw_cells, years, rules)))))


def grid_rows(rows: DataFrame) -> DataFrame:
    """What table_rows() say: (doc_id, table_no, row_no[, statement_type], code_produit, designation, pa_cat, pa_cat_net, pv_ttc, date, quantity, numbers). numbers lists (month, quantity), of month columns that repeat the last number; a row without a 13-digit code has only its numbers."""
    keep = [*ROW, *(c for c in ("statement_type",) if c in rows.columns)]
    told = F.filter(F.transform("months", lambda m: F.struct(m.month.alias("month"), x.cell_number(_raw_at(m.col_no)).alias("quantity"))), lambda c: c.quantity.isNotNull())
    rows = rows.select(*keep, "cols", "texts", "fields", "repeats", told.alias("all"), x.code_digits(field_of("code_produit")).alias("code"))
    last = F.filter("all", lambda c, i: ~F.exists(F.slice(F.col("all"), i + 2, F.size("all")), lambda later: later.month == c.month))
    own = lambda c: F.when(x.is_code(F.col("code")), c)
    text = [own(field_of(c)).alias(c) for c in ("designation", "date", "quantity")]
    return rows.select(*keep, own(F.col("code")).alias("code_produit"), *text, *(own(x.french_decimal(field_of(c))).alias(c) for c in FIXED_COLUMNS[2:]), F.when(F.col("repeats"), last).otherwise(F.col("all")).alias("numbers"))


def grid(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines, cells, printed totals) of grid_rows().

    lines: (doc_id, table_no, row_no, code_produit, designation, pa_cat, pa_cat_net, pv_ttc); cells: (doc_id, table_no,
    row_no, code_produit, month, quantity); totals: (doc_id, month, quantity) of the last row without a 13-digit code but
    with a number, of the last table that has one.
    """
    coded = rows.filter("code_produit is not null")
    other = rows.filter("code_produit is null and size(numbers) > 0")
    printed = other.groupBy("doc_id").agg(F.max_by("numbers", F.struct("table_no", "row_no")).alias("numbers"))
    return coded.select(*ROW, *FIXED_COLUMNS), listed(coded, [*ROW, "code_produit"]), listed(printed, ["doc_id"])


def listed(rows: DataFrame, keep: list[str]) -> DataFrame:
    """(*keep, month, quantity) of each of a row's numbers. The outer form is used, as the inner one makes Spark compute the list once more for a filter on its size."""
    return rows.select(*keep, F.inline_outer("numbers")).filter("month is not null")


def period_rows(rows: DataFrame) -> DataFrame:
    """The transactions (doc_id, table_no, row_no, code_produit, designation, date, quantity) of table_rows(), as text."""
    return rows.select(*ROW, *(field_of(f).alias(f) for f in ("code_produit", "designation", "date", "quantity")))


def _valid(rows: DataFrame) -> DataFrame:
    valid = rows.select(*ROW, x.code_digits(F.col("code_produit")).alias("code_produit"), x.text(F.col("designation")).alias("designation"), x.month_prefix(F.col("date")).alias("month"), x.cell_number(F.col("quantity")).alias("quantity"))
    return valid.filter(x.is_code(F.col("code_produit")) & F.col("month").isNotNull() & F.col("quantity").isNotNull())


def period(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines, cells) of transactions, per table and code: months' quantities are summed, the designation is the first row's, and row_no is the first row's, which orders lines."""
    valid = _valid(rows)
    cells = valid.groupBy(*TABLE, "code_produit", "month").agg(F.sum("quantity").alias("quantity"))
    lines = valid.groupBy(*TABLE, "code_produit").agg(F.min_by("designation", "row_no").alias("designation"), F.min("row_no").alias("row_no"))
    return lines, cells


def period_lines(rows: DataFrame) -> DataFrame:
    """period() as one table, in the form of grid_rows(): each line with its months in numbers, so that nothing is joined."""
    first = [F.min_by("designation", "row_no").alias("designation"), F.min("row_no").alias("row_no")]
    months = _valid(rows).groupBy(*TABLE, "code_produit", "month").agg(F.sum("quantity").alias("quantity"), *first)
    return months.groupBy(*TABLE, "code_produit").agg(*first, F.collect_list(F.struct("month", "quantity")).alias("numbers"))


def months_of(cells: DataFrame, descending: bool) -> DataFrame:
    """(doc_id, months): a document's distinct months in order."""
    return cells.groupBy("doc_id").agg(F.sort_array(F.collect_set("month"), not descending).alias("months"))
