import json

from quillframe.streaming import completions


def test_completions(spark, tmp_path):
    (tmp_path / "in").mkdir()
    say = lambda q: json.dumps({"products": [{"code_produit": "3614810004843", "sales": [{"month": "2026-01-01", "quantity": q}, {"month": "x", "quantity": 1}]}, {"code_produit": "1"}]})
    for i, text in enumerate((say(2), f"```json\n{say(3)}\n```", "nothing")):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"doc_id": str(i), "completion": text}) + "\n")
    stream = completions.arriving(spark, str(tmp_path / "in"), 1)
    q = completions.write_sales(stream, str(tmp_path / "out"), str(tmp_path / "mark"))
    assert q.awaitTermination(120)
    assert sorted((r.doc_id, r.quantity) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("0", 2), ("1", 3)]
    q = completions.month_totals(stream).writeStream.format("memory").queryName("totals").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.month, r.quantity) for r in spark.table("totals").collect()] == [("2026-01", 5)]
