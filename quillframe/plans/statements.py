"""Whole statements: page texts and raw cells of many documents in, lines, cells and documents out, in one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.functions import exprs as x
from quillframe.operators import assemble, reconcile
from quillframe.plans.rules import DEFAULT, Rules
from quillframe.sources import tables


@dataclass
class Statements:
    """documents(doc_id, lgo, statement_type, pharmacy_name, address, pharmacy_id, supplier, months, page_count, row_count, totals_reconciled, flags), lines and cells."""

    documents: DataFrame
    lines: DataFrame
    cells: DataFrame


def native(page_texts: DataFrame, raw_cells: DataFrame, rules: Rules = DEFAULT) -> Statements:
    """Assembly of documents from tables and texts. Months are in descending order; only monthly documents with printed totals are reconciled; a document without tables is monthly and has no lines. Layouts and the rows that were read are written once: lines, cells, sums and documents all come from them, and raw_cells is read twice."""
    texts = assemble.document_text(page_texts)
    found = tables.once(assemble.layouts(raw_cells, _years(texts), rules))
    kinds = assemble.statement_types(found)
    rows = assemble.grid_rows(assemble.table_rows(raw_cells, found.join(kinds, "doc_id")))
    return _assembled(texts, kinds, tables.once(rows), rules)


def native_rows(page_texts: DataFrame, table_rows: DataFrame, rules: Rules = DEFAULT, keep: bool = True) -> Statements:
    """native() of tables whose rows are gathered already, table_rows(doc_id, table_no, row_no, cols, texts), best dealt by doc_id. With keep the rows that were read are written once; without, each table that is asked for reads them again, which is less if it is only one."""
    texts = assemble.document_text(page_texts)
    rows = assemble.grid_rows(assemble.laid_rows(table_rows, _years(texts), rules))
    rows = tables.once(rows) if keep else rows
    kinds = rows.filter("row_no = 0").groupBy("doc_id").agg(F.min("statement_type").alias("statement_type"))
    return _assembled(texts, kinds, rows.filter("row_no > 0"), rules)


def _years(texts: DataFrame) -> DataFrame:
    return texts.select("doc_id", x.reference_year(F.col("text")).alias("reference_year"))


def _assembled(texts: DataFrame, kinds: DataFrame, rows: DataFrame, rules: Rules) -> Statements:
    """A13 of documents' texts and types and the grid_rows() of all their tables."""
    m_lines, m_cells, printed = assemble.grid(rows.filter("statement_type = 'monthly'"))
    flat = assemble.period_lines(rows.filter("statement_type = 'period'"))
    lines = m_lines.unionByName(flat.drop("numbers"), allowMissingColumns=True)
    cells = m_cells.unionByName(assemble.listed(flat, [*assemble.ROW, "code_produit"]))
    checked = reconcile.reconcile(m_cells, printed)
    counts = lines.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("row_count"))
    out = texts.join(kinds, "doc_id", "left").join(counts, "doc_id", "left").join(checked, "doc_id", "left").join(assemble.months_of(cells, descending=True), "doc_id", "left")
    out = out.withColumn("meta", x.header_meta(F.col("text")))
    none = F.array().cast("array<string>")
    documents = out.select(
        "doc_id",
        F.coalesce(x.fingerprint(F.col("text"), rules), F.lit("")).alias("lgo"),
        F.coalesce("statement_type", F.lit("monthly")).alias("statement_type"),
        F.col("meta.name").alias("pharmacy_name"),
        F.col("meta.address").alias("address"),
        F.col("meta.id").alias("pharmacy_id"),
        F.col("meta.supplier").alias("supplier"),
        F.coalesce("months", none).alias("months"),
        "page_count",
        F.coalesce("row_count", F.lit(0)).alias("row_count"),
        F.coalesce("totals_reconciled", F.lit(False)).alias("totals_reconciled"),
        F.coalesce("flags", none).alias("flags"),
    )
    return Statements(documents, lines, cells)


def nested(s: Statements) -> DataFrame:
    """(doc_id, document, lines, validation): the tables as one object per document, for JSON. Lines are in order of tables and rows. Lines that have their cells beside them, in numbers as grid_rows() gives them, are joined with none."""
    key = ["doc_id", "table_no", "row_no"]
    rows = s.lines
    if "numbers" not in rows.columns:
        rows = rows.join(s.cells.groupBy(*key).agg(F.collect_list(F.struct("month", "quantity")).alias("numbers")), key, "left")
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    line = lambda e: F.struct(
        e.code_produit.alias("code_produit"), e.designation.alias("designation"), e.prices.alias("prices"), F.coalesce(F.map_from_entries(e.numbers), empty).alias("quantities"), F.lit(1.0).alias("confidence"),
        F.struct(F.lit(1).alias("page"), F.array(*[F.lit(0.0)] * 4).alias("row_bbox")).alias("source"),
    )
    # maps have no order and a comparison of one's own is slow, so quantities become maps after lines are sorted
    body = F.struct(*key[1:], "code_produit", "designation", F.struct("pa_cat", "pa_cat_net", "pv_ttc").alias("prices"), F.sort_array("numbers").alias("numbers"))
    lines = rows.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(body)), line).alias("lines"))
    head = F.struct(
        F.col("doc_id").cast("string").alias("source_file"), "lgo", "statement_type", F.struct(F.col("pharmacy_name").alias("name"), "address", F.col("pharmacy_id").alias("id")).alias("pharmacy"),
        "supplier", "months", F.lit(None).cast("date").alias("generated_at"), "page_count",
    )
    return s.documents.join(lines, "doc_id", "left").select("doc_id", head.alias("document"), "lines", F.struct("totals_reconciled", "row_count", "flags").alias("validation"))
