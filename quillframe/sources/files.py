"""Scans and sinks of files. All paths are read and written by Spark, so they may lie in any store that it reaches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillframe.functions import exprs as x
from quillframe.plans.rules import IMAGE_SUFFIXES
from quillframe.sources import filesink, pages, tables
from quillframe.sources.pages import Decoder

STATEMENT_DDL = (
    "document struct<source_file:string,lgo:string,statement_type:string,pharmacy:struct<name:string,address:string,id:string>,supplier:string,months:array<string>,generated_at:date,page_count:int>,"
    "lines array<struct<code_produit:string,designation:string,prices:struct<pa_cat:double,pa_cat_net:double,pv_ttc:double>,quantities:map<string,double>,confidence:double,source:struct<page:int,row_bbox:array<double>>>>,"
    "validation struct<totals_reconciled:boolean,row_count:int,flags:array<string>>"
)

def documents(spark: SparkSession, path: str, decoder: Decoder, glob: str = "*.[pP][dD][fF]") -> DataFrame:
    """(doc_id, page_no, text, cells) of each page of the files; decoder gives (text, tables) per page. A file that it cannot read gives one row with page_no 0 and the error as text, and no cells. See pages.PageSource for a source that leaves out what is not asked for."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ("table_no", "row_no", "col_no", "value")
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rows = [(*row[:3], [dict(zip(names, c, strict=True)) for c in row[3]]) for row in pages.decoded(name, bytes(content), decoder)]
                yield pd.DataFrame(rows, columns=["doc_id", "page_no", "text", "cells"])

    return _whole_files(spark, path, glob).select("path", "content").mapInPandas(run, pages.PAGES)


def text_layers(spark: SparkSession, path: str, decoder: Decoder, min_chars: int = 20, glob: str = "*.[pP][dD][fF]") -> DataFrame:
    """(doc_id, has_text) of the files: pages are decoded until they have so many characters, and no further. Null for a file that cannot be read so far."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [pages.enough_text(bytes(c), decoder, min_chars) for c in batch["content"]]
            yield pd.DataFrame({"doc_id": batch["path"], "has_text": pd.array(found, "boolean")})

    return _whole_files(spark, path, glob).select("path", "content").mapInPandas(run, "doc_id string, has_text boolean")


def _whole_files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """Files by name; others are not opened."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


def page_texts(read: DataFrame) -> DataFrame:
    return read.filter("page_no > 0").select("doc_id", "page_no", "text")


def raw_cells(read: DataFrame) -> DataFrame:
    return read.select("doc_id", "page_no", F.explode("cells").alias("c")).select("doc_id", "page_no", "c.*")


def unreadable(read: DataFrame) -> DataFrame:
    """(doc_id, reason) of the files that the decoder failed on."""
    return read.filter("page_no = 0").select("doc_id", F.col("text").alias("reason"))


def has_text_layer(texts: DataFrame, min_chars: int = 20) -> DataFrame:
    """(doc_id, has_text): whether the stripped texts of the pages of texts(doc_id, text) have so many characters together."""
    return texts.groupBy("doc_id").agg((F.sum(F.length(x.strip(F.col("text")))) >= min_chars).alias("has_text"))


def images(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of image files in any folder below; files of other names are not opened. Select path alone and no bytes are read."""
    either = lambda suffix: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in suffix)
    return _whole_files(spark, path, "*{" + ",".join(map(either, IMAGE_SUFFIXES)) + "}").select("path", "content")


def json_texts(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """(name, value) of whole files, of which the name is given without .gz; parse with semistructured.strict_object, whose nulls are the failures."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter=glob)
    return files.select(F.regexp_extract(F.input_file_name(), r"([^/]*?)(\.gz)?$", 1).alias("name"), "value")


def statements(spark: SparkSession, path: str, glob: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """(statements, rejects(name, reason)) of canonical JSON files, checked against the constraints."""
    from quillframe.operators.semistructured import computed

    texts = json_texts(spark, path, glob)
    parsed = computed(texts, ["name"], F.from_json("value", STATEMENT_DDL, {"mode": "PERMISSIVE"}).alias("s"))
    s = F.col("s")
    line = F.get(F.filter(F.transform(s.lines, lambda i: x.bad_line(i.code_produit, F.coalesce(i.confidence, F.lit(1.0)))), lambda r: r.isNotNull()), F.lit(0))
    reason = F.coalesce(F.when(s.isNull() | s.document.isNull(), "not a statement"), x.bad_document(F.coalesce(s.document.months, F.array()), F.coalesce(s.document.page_count, F.lit(1)), F.coalesce(s.validation.row_count, F.lit(0))), line)
    told = parsed.withColumn("reason", reason)
    return told.filter("reason is null").select("name", "s.*"), told.filter("reason is not null").select("name", "reason")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, value) of each line of text files, numbered from 0 within its file, however many splits a file is read in: by the lines of its splits before, of which a row a split is counted."""
    split = ["path", "block"]
    read = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), "value")
    counts = read.groupBy(*split).agg(F.min("n").alias("first"), F.count(F.lit(1)).alias("lines"))
    before = F.sum("lines").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*split, (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    starts = tables.once(starts)
    return read.join(tables.small(starts, starts.count()), split).select("path", (F.col("n") + F.col("shift")).alias("line_no"), "value")


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, value, v) of each line that is not blank: its text, and its object as VARIANT, null if it is none."""
    from quillframe.operators.semistructured import strict_object

    return lines(spark, path).filter(F.trim("value") != "").withColumn("v", strict_object(F.col("value")))


def write_statements(df: DataFrame, path: str) -> None:
    """K1, K2 in bulk: one compact JSON object a line, UTF-8 as it is, fields without a value as null."""
    df.select(_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def write_statement_files(statements: DataFrame, path: str, suffix: str = ".json", indent: int = 0) -> tuple[DataFrame, dict[str, int]]:
    """K1, K2: a file for each of statements(doc_id, document, lines, validation), named by the last part of doc_id without its suffix, and suffix (.expected.json for gold); indent lays it out. Gives (name, row_count) of what was written, and the counts of the commit (files, bytes, tasks)."""
    stem = F.regexp_replace(F.regexp_extract(F.col("doc_id").cast("string"), r"([^/]*)$", 1), r"(.)\.[^.]*$", "$1")
    rows = tables.once(statements.select(F.concat(stem, F.lit(suffix)).alias("name"), F.col("validation.row_count").alias("row_count"), _json(F.struct("document", F.coalesce("lines", F.from_json(F.lit("[]"), statements.schema["lines"].dataType)).alias("lines"), "validation")).cast("binary").alias("content")))
    counts = filesink.write_files(rows, path, indent)
    return rows.select("name", "row_count"), counts


def _json(value: Column) -> Column:
    return F.to_json(value, {"ignoreNullFields": "false"})


def write_split(df: DataFrame, path: str) -> None:
    """K3: JSON lines in ASCII, other characters escaped, a folder for each value of split."""
    df.write.mode("overwrite").partitionBy("split").option("ignoreNullFields", "false").option("writeNonAsciiCharacterAsCodePoint", "true").json(path)


def report(scores: DataFrame, summary: DataFrame) -> DataFrame:
    """K4: (at, value): the lines, in order of at, of one JSON object {"summary": ..., "per_file": [...]} of the dataset row and the files' scores (doc_id, cell_precision, cells_compared, reconciled_rate). No task and no driver sees all files; scores has a row a doc_id."""
    whole = scores.agg(F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("files")).first()
    head = summary.select(F.lit(0).alias("part"), F.lit(None).cast(scores.schema["doc_id"].dataType).alias("doc_id"), F.concat(F.lit('{"summary": '), _json(F.struct("*")), F.lit(', "per_file": [' + ("" if whole.files else "]}"))).alias("value"))
    row = _json(F.struct(F.col("doc_id").alias("name"), "cell_precision", "cells_compared", (F.col("reconciled_rate") == 1).alias("reconciled")))
    body = scores.select(F.lit(1).alias("part"), "doc_id", F.concat(row, F.when(F.col("doc_id") == F.lit(whole.last), "]}").otherwise(",")).alias("value"))
    return head.union(body).select(F.struct("part", "doc_id").alias("at"), "value")


def write_report(scores: DataFrame, summary: DataFrame, path: str) -> None:
    """K4: report() as one file. Its lines are sorted and written in parts, and the parts copied one after another."""
    spark = scores.sparkSession
    parts = tables.fresh(spark)
    report(scores, summary).orderBy("at").select("value").write.text(f"{parts}/lines")
    tables.joined(spark, f"{parts}/lines", path)
