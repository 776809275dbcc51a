"""What a user calls: whole jobs from files to tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.functions import exprs as x
from quillframe.operators import assemble, dataset, engine, pairing, reconcile, score, semistructured
from quillframe.plans import rules, statements
from quillframe.sources import files, tables

validate_config = rules.validate
_NONE = "array<string>"


def from_completions(raw: DataFrame) -> statements.Statements:
    """J2 of raw(doc_id, completion): documents, lines and cells of model output. Months are in ascending order, nothing is reconciled, and a completion without an object gives a document without lines."""
    parsed = raw.select("doc_id", semistructured.completion(F.col("completion")).alias("v"))
    lines, cells = semistructured.completion_lines(parsed)
    counts = lines.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("row_count"))
    documents = semistructured.completion_documents(parsed).join(counts, "doc_id", "left").join(assemble.months_of(cells, descending=False), "doc_id", "left")
    documents = documents.select(
        "doc_id", F.lit("").alias("lgo"), "statement_type", "pharmacy_name", F.lit("").alias("address"), "pharmacy_id", "supplier", F.coalesce("months", F.array().cast(_NONE)).alias("months"), F.lit(1).alias("page_count"),
        F.coalesce("row_count", F.lit(0)).alias("row_count"), F.lit(False).alias("totals_reconciled"), F.array().cast(_NONE).alias("flags"),
    )
    number = lambda df: df.withColumn("table_no", F.lit(0)).withColumnRenamed("line_no", "row_no")
    price = [F.lit(None).cast("double").alias(c) for c in ("pa_cat", "pa_cat_net", "pv_ttc")]
    return statements.Statements(documents, number(lines).select(*assemble.ROW, "code_produit", "designation", *price), number(cells).select(*assemble.ROW, "code_produit", "month", F.col("quantity").cast("double").alias("quantity")))


def extract(spark: SparkSession, path: str, decoder: files.Decoder | None = None, factory: Callable[[], engine.Engine] | None = None) -> tuple[statements.Statements, DataFrame]:
    """(statements, rejects(doc_id, reason)) of all files below a folder, by suffix: PDF through the decoder, images through the engine; files of other kinds, or of a kind that nothing was given for, are rejects, as are files that the decoder cannot read. Each file is decoded, and each image goes through the engine, once: pages and completions are written before anything is made of them."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("doc_id"), x.route(F.col("path")).alias("kind"))
    wanted = [k for k, given in (("pdf", decoder), ("image", factory)) if given]
    rejects = names.filter(F.col("kind").isNull() | ~F.col("kind").isin(wanted)).select("doc_id", F.when(F.col("kind").isNull(), "unsupported suffix").otherwise(F.concat(F.lit("nothing given for "), "kind")).alias("reason"))
    parts = []
    if decoder:
        pages = tables.once(files.documents(spark, path, decoder))
        parts.append(statements.native(files.page_texts(pages), files.raw_cells(pages)))
        rejects = rejects.unionByName(files.unreadable(pages))
    if factory:
        parts.append(from_completions(tables.once(engine.completions(files.images(spark, path).withColumnRenamed("path", "doc_id"), factory))))
    if not parts:
        raise ValueError("neither a decoder nor an engine was given")
    if len(parts) == 1:
        return parts[0], rejects
    a, b = parts
    return statements.Statements(a.documents.unionByName(b.documents), a.lines.unionByName(b.lines), a.cells.unionByName(b.cells)), rejects


def convert_exports(spark: SparkSession, path: str, glob: str = "*.json") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(documents, lines, cells, line_rejects, file_rejects) of annotation exports in a folder, compressed ones if glob ends in .gz. A file that is no JSON object, or that has a month that is not yyyy-MM or a confidence out of range, is refused as a whole. Each file is read and parsed once: what the tables need of it is written before any of them is made."""
    told = tables.once(semistructured.exports(files.json_texts(spark, path, glob).withColumnRenamed("name", "doc_id")))
    good = told.filter("reason is null")
    lines, rejects = semistructured.line_tables(good)
    own = F.filter("lines", lambda p: p["good"])
    documents = good.select(
        "doc_id", F.coalesce(x.fingerprint(F.col("text")), F.lit("")).alias("lgo"), F.lit("monthly").alias("statement_type"), x.report_date(F.col("date")).alias("generated_at"),
        F.array_sort(F.array_distinct(F.flatten(F.transform(own, lambda p: p["sales"]["month"])))).alias("months"), F.size(own).alias("row_count"),
    )
    sales = good.select("doc_id", semistructured.compared_sales(F.col("lines"), F.col("totals")).alias("sales"))
    documents = documents.join(reconcile.reconcile_sales(sales), "doc_id").select("doc_id", "lgo", "statement_type", "generated_at", F.coalesce("months", F.array().cast(_NONE)).alias("months"), "totals_reconciled", F.when(F.col("row_count") > 0, F.col("row_count")).otherwise(0).alias("row_count"))
    return documents, lines, semistructured.line_cells(good), rejects, told.filter("reason is not null").select("doc_id", "reason")


def conversion_counters(documents: DataFrame, line_rejects: DataFrame, file_rejects: DataFrame) -> DataFrame:
    """One row (converted, skipped, failures)."""
    names = {"converted": documents, "skipped": line_rejects, "failures": file_rejects}
    found = None
    for name, df in names.items():
        own = df.select(F.lit(name).alias("what"))
        found = own if found is None else found.union(own)
    return found.agg(*(F.count(F.when(F.col("what") == name, 1)).alias(name) for name in names))


def compare(expected: statements.Statements, actual: statements.Statements) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scores by document, dataset row, differences) of an extraction against gold with the same doc_ids. Lines count in order of tables and rows. The compared cells are written once, as all three come from them."""
    number = F.col("table_no").cast("long") * 2**32 + F.col("row_no")
    numbered = lambda df: df.withColumn("line_no", number)
    cells = tables.once(score.matched_cells(numbered(expected.lines), numbered(expected.cells), numbered(actual.lines), numbered(actual.cells)))
    agreed = expected.documents.select("doc_id", F.col("totals_reconciled").alias("expected")).join(actual.documents.select("doc_id", F.col("totals_reconciled").alias("actual")), "doc_id")
    scores = score.by_document(agreed, cells, agreed)
    return scores, score.dataset(scores), score.diffs(cells)


def console_report(summary: DataFrame, found: DataFrame, n: int = 10) -> str:
    """K5: the measures, the first n differences and how many more there are."""
    s, total = summary.first(), found.count()
    told = [f"cell_precision: {s.cell_precision:.4f}", f"reconciled_rate: {s.reconciled_rate:.4f}", f"cells_compared: {s.cells_compared}", f"cells_matched: {s.cells_matched}"]
    told += [f"{r.path}: expected {r.expected}, got {r.actual}" for r in score.first_diffs(found, n).collect()]
    return "\n".join([*told, f"… and {total - n} more"] if total > n else told)


def training_split(spark: SparkSession, gold: DataFrame, images_path: str, outputs: DataFrame, val: int, test: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(examples(stem, image, template, output, split), unmatched stems): gold(stem) paired with images, outputs(stem, output) as answers."""
    pairs = pairing.pair(gold, files.images(spark, images_path).select("path"))
    matched = pairs.filter("path is not null").select("stem", F.col("path").alias("image")).join(outputs, "stem")
    told = matched.select("stem", "image", F.lit(engine.TEMPLATE).alias("template"), "output")
    return dataset.split(told, "stem", val, test, seed), pairing.unmatched(pairs)


def gold_images(spark: SparkSession, gold_path: str, images_path: str, glob: str = "*.json", limit: int | None = None) -> DataFrame:
    """S9, JN5, T-3: pairs of the gold files of a folder, by stem without .expected, with the images below another, the first limit by stem; a gold file may name its image itself."""
    texts = files.json_texts(spark, gold_path, glob).select(F.regexp_replace("name", r"(\.expected)?\.json$", "").alias("stem"), "value")
    named = texts.select("stem", semistructured.image_name(F.col("value")).alias("image")).filter("image is not null")
    pairs = pairing.pair(texts.select("stem"), files.images(spark, images_path).select("path"), named)
    return pairs if limit is None else pairing.first(pairs, limit)
