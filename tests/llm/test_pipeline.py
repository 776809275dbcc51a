"""The pipeline over a small table with planted cases, and against the operators one by one."""

from pyspark.sql import functions as F

import corpus_pipeline
import __spark_entry__
from quillframe.llm import decontam, minhash_oph, pfair_mix, quality_bt, queries, secret_scan


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    want = docs
    bad = ids(queries.op4_quality_ranking(spark, sf).filter("predicted = 0"))
    want = want.filter(~want.doc_id.isin(*bad))
    want = want.join(minhash_oph.near_duplicates(want, 5, 80).filter("kept").select("doc_id"), "doc_id", "left_semi")
    leaks, secrets = ids(queries.op6_bm25_decontamination(spark, sf)), ids(queries.op3_secret_scan(spark, sf).filter("spans <> ''"))
    left = ids(want) - leaks - secrets
    got = corpus_pipeline.run(spark, sf)
    rows = got.collect()
    assert {r.doc_id for r in rows} == left and len(rows) == len(left)
    assert got.columns == [*docs.columns, "mix_slot", "mix_block", "mix_position"] and sorted(r.mix_position for r in rows) == list(range(len(rows)))
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.text == texts[r.doc_id] for r in rows)


def test_stages_keep_columns(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", "1 as __gone", "2 as score")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.columns[: len(docs.columns)] == docs.columns, name
        assert stage(spark, docs.limit(0), sf).count() == 0, name


def test_registered():
    names = list(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and len(corpus_pipeline.STAGES) == 5
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_mix_has_each_row_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert pfair_mix.mix(docs).count() == docs.count()


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Null ids, null and empty texts, rows that repeat, texts under one id, through all stages."""
    sf = "/root/testdata/sf0.001"
    for name in ("labels", "benchmark"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{sf}/{name}.parquet")
    docs, labels, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    rated = quality_bt.rate(docs, labels).join(docs.select("doc_id", "text"), "doc_id")
    final = {r.doc_id for r in corpus_pipeline.run(spark, sf).select("doc_id").collect()}
    alone = {r.m for r in minhash_oph.near_duplicates(docs).groupBy("component_id").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("m")).filter("n = 1").collect()}
    good = sorted((r.doc_id, r.text) for r in rated.filter("predicted = 1").collect() if r.doc_id in final & alone and len(r.text.split()) > 50)[:7]
    bad = rated.filter("predicted = 0").orderBy("doc_id").first().text
    a, b, c, d, e, f, g = (t for _, t in good)
    rows = [(None, bad), (None, f"{f} password = abcdef0123456789"), (None, f"{g} {items.orderBy('item_id').first().text}"), (None, a), (None, a), (10**6 + 7, b), (10**6 + 7, c), (10**6 + 7, c), (10**6 + 3, d), (None, d), (10**6 + 9, e), (10**6 + 8, f"{e} more"), (None, None), (None, None), (10**6 + 5, ""), (10**6 + 5, "")]
    odd = spark.createDataFrame([(i, t, "odd", "s" if i else None, 0) for i, t in rows], docs.select("doc_id", "text", "lang", "source", "n_chars").schema)
    docs.select(*odd.columns).filter(~docs.doc_id.isin([i for i, _ in good])).union(odd).selectExpr("*", "1 as mix_slot", "2 as at").coalesce(1).write.parquet(f"{tmp_path}/d")
    next(tmp_path.glob("d/*.parquet")).rename(tmp_path / "documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    empty = [(None, None), (None, None), (10**6 + 5, ""), (10**6 + 5, "")]
    got = sorted(str((r.doc_id, r.text)) for r in out if r.lang == "odd" and r.text)
    assert got == sorted(map(str, [(None, a), (10**6 + 7, b), (10**6 + 7, c), (10**6 + 3, d), (10**6 + 8, f"{e} more")]))
    assert sum(r.lang == "odd" and not r.text for r in out) in (0, len(empty))  # as the ranking rates an empty text
    assert sorted(r.mix_position for r in out) == list(range(len(out))) and {r["at"] for r in out} == {2}


def test_stages_judge_rows_with_null_or_shared_ids(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    rated = quality_bt.rate(docs, labels).join(docs.select("doc_id", "text"), "doc_id")
    good, bad = (rated.filter(f"predicted = {i}").orderBy("doc_id").first().text for i in (1, 0))
    secret, item = "password = abcdef0123456789", items.orderBy("item_id").first().text
    for stage, name, text in ((lambda d: quality_bt.accepted(d, labels), "quality", bad), (lambda d: decontam.without_contaminated(d, items), "items", item), (secret_scan.without_secrets, "secrets", secret)):
        more = spark.createDataFrame([(None, text, 1), (None, good, 2), (10**6, text, 3), (10**6, good, 4)], "doc_id long, text string, n int")
        got = stage(docs.selectExpr("doc_id", "text", "0 as n").union(more))
        assert {r.n for r in got.filter("n > 0").collect()} == {2, 4}, name
