"""The corpus pipeline: STAGES over documents, each written as Parquet and reread as the next one's documents.

Every stage but the last returns the columns of documents; the last adds mix_slot, mix_block and mix_position, the place of
each document in the mixed order. No stage has an equal in SQL (learned scores come first), so ORACLE_SQL is None.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillframe.llm import decontam, minhash_oph, pfair_mix, quality_bt, secret_scan
from quillframe.llm._common import discard, scratch, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality ranking does not reject.

    Each row is judged by its own text, null ones as empty, whatever its doc_id; equal rows share their fate. No text is too
    long. Without labels of both kinds, or without rows, nothing is dropped. Columns stay as they are, whatever their names.
    """
    return quality_bt.accepted(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): the one with the least doc_id.

    Rows are compared by their texts: of equal rows one stays, rows with one doc_id but other texts all stay, and a row with
    a null doc_id goes if a row with an id is in its group. Null and empty texts are in no group and stay. No text is too
    long. Without rows there is nothing to drop. Columns stay as they are, whatever their names.
    """
    return minhash_oph.one_of_each(docs, k=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item.

    Each row is judged by its own text, whatever its doc_id; null and empty texts hold nothing; equal rows share their fate.
    No text is too long. Without items, or without rows, nothing is dropped. Columns stay as they are, whatever their names.
    """
    return decontam.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without secrets.

    Each row is judged by its own text, whatever its doc_id; null and empty texts have none; equal rows share their fate. No
    text is too long. Without rows there is nothing to drop. Columns stay as they are, whatever their names.
    """
    return secret_scan.without_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents left, with their place in the mix of sources.

    Every row has a place of its own, equal rows and those with a null doc_id or text too; a null source is a source.
    Without rows there are no places. Columns stay as they are, but for any that has the name of a new one.
    """
    return pfair_mix.mix(docs)


STAGES = [("quality classifier", quality), ("near dedup", near_dedup), ("decontamination", decontaminate), ("secret scan", secrets), ("mixing", mixing)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before = docs
        with scratch() as keep:
            docs = keep(written(stage(spark, docs, sf_dir)))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
