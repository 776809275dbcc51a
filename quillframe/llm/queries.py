"""The registered queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm import ann_rabitq, decontam, filter_audit, importance, langid_viterbi, license_scan, minhash_oph, pfair_mix, quality_bt, secret_scan, sql, token_files, toxicity_nb, url_trust
from quillframe.llm._common import fresh, table


def op1_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trust.judge(table(spark, sf_dir, "pages"), sql.RULES).select("page_id", "host", "path", "rule", "verdict")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.filter("found", lambda x: x.base)
    starts = F.transform(base, lambda x: x.start.cast("long"))
    names = lambda xs: F.array_join(F.array_sort(F.array_distinct(F.transform(xs, lambda x: x.label))), ",")
    return license_scan.scan(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"),
        names(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x.share)), F.lit(0.0)).alias("score"),
    )


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda s: s.kind == k)).cast("long")
    docs = table(spark, sf_dir, "documents")
    return secret_scan.scan(docs, likely=secret_scan.ordinary(docs)).select(
        "doc_id",
        *(count(i).alias(f"n_{k}") for i, k in enumerate(secret_scan.KINDS[:3])),
        F.sha2(secret_scan.listed(F.col("base")), 256).alias("base_sha256"),
        secret_scan.listed(F.concat("base", "random")).alias("spans"),
    )


def op4_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_bt.rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_toxicity_nb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_nb.rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfair_mix.mix(table(spark, sf_dir, "documents"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_oph.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op9_ann_rabitq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_rabitq.nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op10_language_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid_viterbi.identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh(spark)
    token_files.write(table(spark, sf_dir, "documents"), folder)
    return token_files.read(spark, folder).select("doc_id", "start", "n_tokens", token_files.checksum().alias("ids_crc32"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_trust": op1_url_trust,
    "op2_license_scan": op2_license_scan,
    "op3_secret_scan": op3_secret_scan,
    "op4_quality_ranking": op4_quality_ranking,
    "op5_toxicity_nb": op5_toxicity_nb,
    "op6_bm25_decontamination": op6_bm25_decontamination,
    "op7_pfair_mixing": op7_pfair_mixing,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_ann_rabitq": op9_ann_rabitq,
    "op10_language_viterbi": op10_language_viterbi,
    "op11_filter_audit": op11_filter_audit,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_token_files": op13_token_files,
}

ORACLE_SQL: dict[str, str] = {
    "op1_url_trust": sql.op1(),
    "op2_license_scan": sql.op2(),
    "op8_minhash_near_dedup": sql.OP8,
    "op9_ann_rabitq": sql.OP9,
    "op11_filter_audit": sql.OP11,
    "op12_importance_resampling": sql.OP12,
}
