import json

import pytest
from pyspark.sql import functions as F

from quillframe.operators import assemble, dataset, engine, pairing, reconcile, render, score, semistructured
from quillframe.plans import rules, statements
from quillframe.sources import files

#: A grid of three month columns, and transactions of which two cannot be read.
MONTHLY = [["CIP", "Libellé", "PA cat.", "PA cat net", "PV TTC", "mars 2031", "févr. 2031", "nov. 2030"], ["3401597302468", "Gel main 75 ml", "4,10", "3,69", "6,90", "12", "5", "7"], ["34015 12309875", "Spray nasal", "", None, "?", "0", "", "2"]]
PERIOD = [["Code produit", "Libelle", "Date de vente", "Quantité", "Montant"], ["3401597302468", "Gel main 75 ml", "2031-03-02", "6", "41,40"], ["3401597302468", "Gel (promo)", "2031-03-28", "4", "24,00"], ["990017", "sans code", "2031-03-28", "2", ""], ["3401597302468", "Gel", "hier", "1", ""]]


def pages(spark, *documents):
    """documents: (doc_id, text, tables)."""
    cells = [(d, 1, t, r, c, v) for d, _, tables in documents for t, table in enumerate(tables) for r, row in enumerate(table) for c, v in enumerate(row)]
    return spark.createDataFrame([(d, 1, text) for d, text, _ in documents], "doc_id string, page_no int, text string"), spark.createDataFrame(cells, "doc_id string, page_no int, table_no int, row_no long, col_no int, value string")


def test_native(spark):
    total = lambda *sums: ["", "TOTAL", "", "", "", *sums]
    s = statements.native(*pages(spark, ("ok", "ETAT DES VENTES\nPharmacie du Lac\n8 quai Nord\nID: 41", [[*MONTHLY, total("12", "5", "9")]]), ("off", "", [[*MONTHLY, total("13", "5", "8")]]), ("flat", "LGPI", [PERIOD]), ("none", "x", [])))
    d = {r.doc_id: r for r in s.documents.collect()}
    assert d["ok"].totals_reconciled and d["ok"].row_count == 2 and d["ok"].months == ["2031-03", "2031-02", "2030-11"] and d["ok"].lgo == "etat_des_ventes" and d["ok"].pharmacy_id == "41"
    assert not d["off"].totals_reconciled and d["off"].flags == ["month 2030-11: computed=9.0, printed=8", "month 2031-03: computed=12.0, printed=13"]
    assert d["flat"].statement_type == "period" and d["flat"].row_count == 1 and not d["flat"].totals_reconciled and d["flat"].flags == []
    assert d["none"].statement_type == "monthly" and d["none"].row_count == 0 and d["none"].months == []
    cells = sorted((r.doc_id, r.row_no, r.month, r.quantity) for r in s.cells.filter("doc_id in ('ok', 'flat')").collect())
    assert cells == [("flat", 1, "2031-03", 10.0), ("ok", 1, "2030-11", 7.0), ("ok", 1, "2031-02", 5.0), ("ok", 1, "2031-03", 12.0), ("ok", 2, "2030-11", 2.0), ("ok", 2, "2031-03", 0.0)]
    line = s.lines.filter("doc_id = 'ok' and row_no = 1").first()
    assert (line.pa_cat, line.pa_cat_net, line.pv_ttc) == (4.1, 3.69, 6.9)
    nested = {r.doc_id: r for r in statements.nested(s).collect()}
    assert [x.code_produit for x in nested["ok"].lines] == ["3401597302468", "3401512309875"] and nested["ok"].lines[0].quantities == {"2031-03": 12.0, "2031-02": 5.0, "2030-11": 7.0} and nested["none"].lines is None


def test_short_code_is_read_as_total(spark):
    texts, cells = pages(spark, ("d", "", [[*MONTHLY, ["990017", "sans code", "", "", "", "8", "", ""]]]))
    _, _, printed = assemble.monthly(cells, spark.createDataFrame([], "doc_id string, reference_year int"))
    assert [(r.month, r.quantity) for r in printed.collect()] == [("2031-03", 8.0)]


def test_round_trip(spark):
    lines = spark.createDataFrame([("d", 0, "3401597302468", "A", 32.0, None, 1234.5), ("d", 1, "3401512309875", "B", None, None, None)], "doc_id string, line_no int, code_produit string, designation string, pa_cat double, pa_cat_net double, pv_ttc double")
    cells = spark.createDataFrame([("d", 0, "2026-01", 3.0), ("d", 0, "2025-12", 2.0), ("d", 1, "2026-01", 1.5)], "doc_id string, line_no int, month string, quantity double")
    got_lines, got_cells, printed = assemble.monthly(render.monthly_grid(lines, cells), spark.createDataFrame([], "doc_id string, reference_year int"))
    gold = cells.union(spark.createDataFrame([("d", 1, "2025-12", 0.0)], cells.schema))
    numbered = lambda df: df.withColumn("line_no", (F.col("row_no") - 1).cast("int"))
    found = score.by_document(lines.select("doc_id").distinct(), score.matched_cells(lines, gold, numbered(got_lines), numbered(got_cells)))
    assert [(r.cells_compared, r.cell_precision) for r in found.collect()] == [(4, 1.0)]
    assert {(r.month, r.quantity) for r in printed.collect()} == {("2026-01", 4.5), ("2025-12", 2.0)}
    assert got_lines.filter("pa_cat is null").count() == 1


def test_scores(spark):
    line, cell = "doc_id string, line_no int, code_produit string", "doc_id string, line_no int, month string, quantity double"
    gold = spark.createDataFrame([("d", 0, "a"), ("d", 1, "a"), ("d", 2, "unseen")], line), spark.createDataFrame([("d", 0, "m1", 9.0), ("d", 1, "m1", 3.0), ("d", 1, "m2", 0.0)], cell)
    actual = spark.createDataFrame([("d", 0, "a"), ("d", 5, "new")], line), spark.createDataFrame([("d", 0, "m1", 3.0), ("d", 5, "m1", 1.0)], cell)
    cells = score.matched_cells(*gold, *actual)
    diffs = sorted((r.path, r.expected, r.actual) for r in score.diffs(cells).collect())
    assert diffs == [("lines[a].quantities[m2]", "0", None), ("lines[new]", "<missing>", "new")]
    docs = spark.createDataFrame([("d",), ("empty",)], "doc_id string")
    scores = score.by_document(docs, cells, docs.select("doc_id", F.lit(True).alias("expected"), (F.col("doc_id") == "d").alias("actual")))
    got = {r.doc_id: (r.cells_compared, r.cells_matched, r.cell_precision, r.reconciled_rate) for r in scores.collect()}
    assert got == {"d": (2, 1, 0.5, 1.0), "empty": (0, 0, 1.0, 0.0)}
    total = score.dataset(scores).first()
    assert (total.files_evaluated, total.cell_precision, total.reconciled_rate) == (2, 0.5, 0.5)
    none = score.dataset(scores.limit(0)).first()
    assert (none.files_evaluated, none.cell_precision, none.reconciled_rate) == (0, 1.0, 0.0)
    assert [r.doc_id for r in score.worst(scores, 1).collect()] == ["d"]


@pytest.mark.parametrize(("text", "value"), [('{"a": 1}', 1), ('x ```json\n{"a": 2}\n``` y', 2), ('so {"a": 3} it is', 3), ("```\n{\"a\": 4}```", 4), ("no", None), ("", None), (None, None), ("[1]", None), ('{"a": 1}],[{}', None), ('{"a": 1}, "b": {}', None), ('{"a": "}],[{"}', None), (' {"a": 5}\n', 5), ('{"v": 1, "a": 6}', 6), ('{"a": 1} x {"a": 2}', None), ('{"a": 1},{"a": 2}', None), ('{"a": 1', None)])
def test_completion(spark, text, value):
    v = spark.range(1).select(semistructured.completion(F.lit(text).cast("string")).alias("v"))
    assert v.select(F.try_variant_get("v", "$.a", "int").alias("a")).first().a == value


def test_completion_lines(spark):
    raw = {"pharmacy": {"name": "P", "id": 5}, "supplier": None, "report_date": "2026-02-03", "products": [{"code_produit": "34015 97302468", "designation": "A", "sales": [{"month": "2026-01-01", "quantity": 2}, {"month": "2026-01", "quantity": "1.9"}, {"month": "x", "quantity": 1}, 3, None]}, 7, None, {"code_produit": "123"}, {"designation": "no code"}, {"code_produit": 3401512309875, "sales": "none"}]}
    df = spark.createDataFrame([(1, json.dumps(raw)), (2, "[]"), (3, '{"products": {}}')], "doc_id int, s string").select("doc_id", semistructured.completion(F.col("s")).alias("v"))
    lines, cells = semistructured.completion_lines(df)
    assert sorted((r.line_no, r.code_produit, r.designation) for r in lines.collect()) == [(0, "3401597302468", "A"), (5, "3401512309875", "")]
    assert [(r.month, r.quantity) for r in cells.collect()] == [("2026-01", 3)]
    d = {r.doc_id: r for r in semistructured.completion_documents(df).collect()}
    assert (d[1].pharmacy_name, d[1].pharmacy_id, d[1].supplier, str(d[1].generated_at)) == ("P", "5", "", "2026-02-03") and d[2].generated_at is None


def test_inverse(spark):
    docs = spark.createDataFrame([(1, "P", "7", "S")], "doc_id int, pharmacy_name string, pharmacy_id string, supplier string").withColumn("generated_at", F.lit("2026-02-03").cast("date"))
    lines = spark.createDataFrame([(1, 0, "3401597302468", "A"), (1, 1, "3401512309875", "B")], "doc_id int, line_no int, code_produit string, designation string")
    cells = spark.createDataFrame([(1, 0, "2026-01", 3.0), (1, 0, "2025-12", 2.0)], "doc_id int, line_no int, month string, quantity double")
    out = json.loads(semistructured.completion_of(docs, lines, cells).first().output)
    assert out["report_date"] == "2026-02-03" and out["products"][0]["sales"] == [{"month": "2025-12-01", "quantity": 2}, {"month": "2026-01-01", "quantity": 3}] and out["products"][1]["sales"] == []


def test_lines_with_their_quantities_beside_them(spark):
    """A completion is parsed once, and lines that have their months in a map are joined with no cells."""
    sale = lambda m, q: {"month": m, "quantity": q}
    products = [{"code_produit": "34015 97302468", "designation": "A", "sales": [sale("2026-01-01", 2), sale("2026-02", "5"), sale("2026-01", "1.9"), sale("x", 1), 3, None]}, 7, {"code_produit": "123"}, {"code_produit": 3401512309875, "sales": "none"}, {"code_produit": "3401512309876", "sales": [sale("2026-03", 4), sale("2026-04", None)]}]
    df = spark.createDataFrame([(1, json.dumps({"products": products})), (2, "[]"), (3, '{"products": {}}')], "doc_id int, s string").select("doc_id", semistructured.completion(F.col("s")).alias("v"))
    own = semistructured.completion_own(df)
    assert sorted(own.collect()) == [(1, 0, "3401597302468", "A", {"2026-01": 3.0, "2026-02": 5.0}), (1, 3, "3401512309875", "", {}), (1, 4, "3401512309876", "", {"2026-03": 4.0})]
    lines, cells = semistructured.completion_lines(df)
    assert sorted(own.select("doc_id", "line_no", "code_produit", F.explode("own").alias("month", "q")).collect()) == sorted(cells.collect())
    assert all(r.expected == r.actual for r in score.matched_cells(lines, cells, own, None).collect()) and score.matched_cells(own, None, lines, cells).filter("month is not null").count() == 3
    docs = spark.createDataFrame([(1, "P", "7", "S"), (2, "P", "8", "S")], "doc_id int, pharmacy_name string, pharmacy_id string, supplier string").withColumn("generated_at", F.lit(None).cast("date"))
    assert sorted(semistructured.completion_of(docs, own).collect()) == sorted(semistructured.completion_of(docs, lines, cells).collect())
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    assert plan(score.matched_cells(own, None, own, None)).count("Aggregate") == 0 and plan(semistructured.completion_of(docs, own)).count("Join ") == 1


def export(text="ETAT DES VENTES", dates=("2026-02-03",), total=((("2026-01", "5"),),), codes=("34015 97302468", "123")):
    sale = lambda m, q: {"type": "sales_by_month", "properties": [{"type": "month_period_normalized", "normalizedValue": {"text": m}}, {"type": "sales_quantity", "mentionText": q}]}
    entities = [{"type": "report_date", "mentionText": d} for d in dates]
    entities += [{"type": "product_line", "confidence": 0.5, "properties": [{"type": "product_ean", "mentionText": c}, {"type": "product_designation", "normalizedValue": {"text": 5}, "mentionText": "D"}, sale("2026-01", "2"), sale("2026-01-31", "3"), sale("2026-02", "3.0")]} for c in codes]
    entities += [{"type": "total_line", "properties": [sale(*s) for s in t]} for t in total]
    return json.dumps({"text": text, "entities": entities})


def test_export(spark):
    docs = [(1, export()), (2, export(total=())), (3, export(total=((("2026-01", "6"),),), dates=("soon", "2026-01-01"))), (4, "{}")]
    raw = spark.createDataFrame(docs, "doc_id int, s string").select("doc_id", semistructured.strict_object(F.col("s")).alias("v"))
    lines, cells, rejects = semistructured.export_lines(raw)
    assert sorted((r.doc_id, r.code_produit, r.designation, r.confidence) for r in lines.collect()) == [(i, "3401597302468", "D", 0.5) for i in (1, 2, 3)]
    assert {(r.month, r.quantity) for r in cells.collect()} == {("2026-01", 5)}
    assert [(r.reason, r.raw_code) for r in rejects.filter("doc_id = 1").collect()] == [("non-13-digit code", "123")]
    got = {r.doc_id: r.totals_reconciled for r in reconcile.reconcile_export(raw, cells, semistructured.export_totals(raw)).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False}
    assert {r.doc_id: str(r.generated_at) for r in semistructured.export_dates(raw).collect()} == {1: "2026-02-03", 2: "2026-02-03", 3: "None"}


def test_pairs(spark):
    gold = spark.createDataFrame([("vitrine",), ("lot_88_rue_0412",), ("Qu-ai",), ("515",), ("n",)], "stem string")
    images = spark.createDataFrame([("/a/vitrine.jpg",), ("/a/vitrine_1.png",), ("/z/lot_88_rue_0412_17.JPG",), ("/b/lot_88_rue_0412_18.jpg",), ("/c/quai.tif",), ("/c/516.png",), ("/c/n.txt",), ("/d/other.jpg",)], "path string")
    named = spark.createDataFrame([("n", "other.JPG"), ("m", "x.y.png"), ("o", "Oth-er.gif"), ("o", "none.png"), ("515", "unseen.jpg")], "stem string, image string")
    gold = gold.union(spark.createDataFrame([("m",), ("o",)], "stem string"))
    images = images.union(spark.createDataFrame([("/d/x.y.tif",), ("/e/X-Y.png",)], "path string"))
    got = {r.stem: (r.path, r.tier, r.ambiguous) for r in pairing.pair(gold, images, named).collect()}
    assert got["vitrine"] == ("/a/vitrine.jpg", 1, False) and got["Qu-ai"] == ("/c/quai.tif", 3, False) and got["515"] == (None, None, False) and got["n"] == ("/d/other.jpg", 4, False)
    assert got["m"] == ("/d/x.y.tif", 4, False) and got["o"] == ("/d/other.jpg", 4, False)
    assert got["lot_88_rue_0412"] == ("/b/lot_88_rue_0412_18.jpg", 2, True)
    assert pairing.counters(pairing.pair(gold, images)).first()[:] == (3, 1, 4)


def test_split(spark):
    items = spark.range(20).withColumnRenamed("id", "k")
    split = lambda seed: {r.k: r.split for r in dataset.split(items, "k", 4, 3, seed).collect()}
    got = split(42)
    assert sorted(got.values()).count("train") == 13 and list(got.values()).count("val") == 4 and list(got.values()).count("test") == 3
    assert got == split(42) and got != split(43)
    assert {r.split for r in dataset.split(items, "k", 0, 0, 1).collect()} == {"train"}
    rows = [(k, i) for i, k in enumerate(["a", "a", "a", "b", "b", "c", "d", "e", None, None])]
    again = dataset.split(spark.createDataFrame(rows, "k string, n int"), "k", 2, 1, 5).collect()
    parts = {}
    for r in again:
        parts.setdefault(r.split, set()).add(r.k)
    assert sorted(r.n for r in again) == list(range(10)) and len(parts["test"]) == 1 and len(parts["val"]) == 2 and parts["train"] == {"a", "b", "c", "d", "e", None} - parts["test"] - parts["val"]


def test_head(spark):
    lines = spark.createDataFrame([(0, "a"), (1, "b"), (2, " "), (3, "c")], "row_no int, value string")
    assert [[r.value for r in dataset.head(lines, n).collect()] for n in (1, 10, 0)] == [["a"], ["a", "b"], []]


class Fake:
    def extract(self, image, template):
        if image == b"bad":
            raise ValueError
        return '```json\n{"products": [{"code_produit": "3401597302468", "sales": [{"month": "2026-01", "quantity": 3}]}]}\n```'


def test_engine(spark):
    images = spark.createDataFrame([(1, b"x"), (2, b"bad")], "doc_id int, content binary")
    gold = spark.createDataFrame([(1, 0, "3401597302468")], "doc_id int, line_no int, code_produit string"), spark.createDataFrame([(1, 0, "2026-01", 3.0)], "doc_id int, line_no int, month string, quantity double")
    got = {r.doc_id: (r.cells_compared, r.cell_precision) for r in engine.evaluate(images, Fake, *gold).collect()}
    assert got == {1: (1, 1.0), 2: (0, 1.0)}
    with pytest.raises(engine.MissingDependency):
        engine.require("surely_not_installed", "install it")


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    good = {"document": {"source_file": "f", "lgo": "", "statement_type": "monthly", "months": ["2026-01"], "page_count": 1}, "lines": [{"code_produit": "3401597302468", "quantities": {"2026-01": 3}, "confidence": 1.0}], "validation": {"totals_reconciled": True, "row_count": 1, "flags": []}}
    bad = json.loads(json.dumps(good))
    bad["lines"][0]["code_produit"] = "123"
    for name, x in (("a.expected.json", good), ("b.expected.json", bad)):
        (tmp_path / "in" / name).write_text(json.dumps(x, indent=2))
    (tmp_path / "in" / "c.expected.json").write_text("no json")
    kept, rejects = files.statements(spark, str(tmp_path / "in"), "*.expected.json")
    assert [r.name for r in kept.collect()] == ["a.expected.json"] and {r.name: r.reason for r in rejects.collect()} == {"b.expected.json": "code is not 13 digits", "c.expected.json": "not a statement"}
    (tmp_path / "pdf").mkdir()
    (tmp_path / "pdf" / "a.PDF").write_bytes(json.dumps([["text", [MONTHLY]], [None, None]]).encode())
    (tmp_path / "pdf" / "b.pdf").write_bytes(b"broken")
    read = files.documents(spark, str(tmp_path / "pdf"), lambda content: [tuple(p) for p in json.loads(content)])
    assert files.raw_cells(read).filter("row_no = 0").count() == 8 and files.page_texts(read).count() == 2 and files.unreadable(read).count() == 1
    files.write_split(dataset.split(spark.range(5), "id", 1, 1, 7), str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").glob("split=*")) == ["split=test", "split=train", "split=val"]
    assert files.json_lines(spark, str(tmp_path / "out")).count() == 5
    texts = spark.createDataFrame([("a", " x" * 10), ("a", "y" * 12), ("b", " " * 50)], "doc_id string, text string")
    assert {r.doc_id: r.has_text for r in files.has_text_layer(texts).collect()} == {"a": True, "b": False}


def test_scans_of_a_plan(spark):
    """Layouts and rows come from written tables, so the cells are not derived again for each output."""
    s = statements.native(*pages(spark, ("d", "", [MONTHLY])))
    plan = s.documents._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") <= 3 and plan.count("Relation [") < 10


def test_rules_from_files(spark, tmp_path):
    for name, x in (("months", {"Mai": 5}), ("aliases", {"Code": "code_produit"}), ("signatures", [{"id": "z", "signatures": ["ZZ"]}])):
        (tmp_path / f"{name}.json").write_text(json.dumps(x, indent=1))
    r = rules.load(spark, str(tmp_path))
    assert r.month_map() == {"mai": "05"} and r.alias_map() == {"code": "code_produit"} and r.signatures == (("z", ("ZZ",)),)
    (tmp_path / "months.json").write_text("[]")
    with pytest.raises(TypeError):
        rules.load(spark, str(tmp_path))


def test_report(spark, tmp_path):
    scores = spark.createDataFrame([(f"f{i:03}", i / 50, 4, float(i % 2)) for i in range(50)], "doc_id string, cell_precision double, cells_compared long, reconciled_rate double")
    summary = spark.createDataFrame([(0.6, None)], "cell_precision double, other string")
    files.write_report(scores.repartition(4), summary, str(tmp_path / "report.json"))
    got = json.loads((tmp_path / "report.json").read_text())
    assert got == {"summary": {"cell_precision": 0.6, "other": None}, "per_file": [{"name": f"f{i:03}", "cell_precision": i / 50, "cells_compared": 4, "reconciled": i % 2 == 1} for i in range(50)]}
    files.write_report(scores.limit(0), summary, str(tmp_path / "none.json"))
    assert json.loads((tmp_path / "none.json").read_text())["per_file"] == []


def test_reconcile_and_structure(spark):
    cells = spark.createDataFrame([(1, "2026-01", 3.0), (1, "2025-12", 3.0), (1, "2026-01", 1.0)], "doc_id int, month string, quantity double")
    printed = lambda rows: spark.createDataFrame(rows, "doc_id int, month string, quantity double")
    assert reconcile.reconcile(cells, printed([(1, "2026-01", 4.0), (1, "2025-12", 3.0)])).first()[1:] == (True, [])
    off = reconcile.reconcile(cells, printed([(1, "2026-02", 5.0)])).first()
    assert off.flags == ["month 2026-02: computed=0.0, printed=5"]
    docs = spark.createDataFrame([(1,), (2,)], "doc_id int")
    assert {r.doc_id: (r.row_count, r.flags) for r in reconcile.structure(docs, cells).collect()} == {1: (3, []), 2: (0, ["no product lines extracted"])}


def test_gathered_rows_give_what_cells_give(spark):
    """Two tables, one with a month twice, one without a header, in rows and as cells."""
    twice = [[*MONTHLY[0], MONTHLY[0][-1]], [*MONTHLY[1], "4"], [*MONTHLY[2], ""], ["", "TOTAL", "", "", "", "1", "", "2", "3"]]
    cells = pages(spark, ("a", "", [twice, MONTHLY]), ("b", "", [MONTHLY]))[1]
    cells = cells.unionByName(cells.filter("doc_id = 'b' and row_no > 0").withColumn("table_no", F.lit(7)))
    want = assemble.monthly(cells, spark.createDataFrame([], "doc_id string, reference_year int"))
    got = assemble.grid(assemble.grid_rows(assemble.laid_rows(assemble.gathered(cells)).filter("row_no > 0")))
    for w, g in zip(want, got, strict=True):
        rows = sorted(map(repr, w.collect()))
        assert rows and rows == sorted(map(repr, g.select(*w.columns).collect()))


def test_grids_are_dealt_once(spark):
    """Printing and reading a grid shuffles its orders' items and nothing that was made of them."""
    from quillframe.plans import queries
    from tests.oracle import SF

    for name in ("monthly_roundtrip", "monthly_lines", "grid_totals", "native_cells"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert 0 < plan.count("REPARTITION_BY_COL") == plan.count(" Exchange "), name


def test_comparison_joins_nothing_of_dealt_lines(spark):
    from quillframe.plans import queries
    from tests.oracle import SF

    plan = queries.QUERIES["cell_diffs"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.count("REPARTITION_BY_COL") == plan.count(" Exchange ") and "Join" not in plan


def test_comparison_of_repeated_and_missing_lines(spark):
    """Two lines of one code are both held against the last gold line of it; lines without a code, or of another one, are a row without a month."""
    lines = lambda *rows: spark.createDataFrame(rows, "doc_id string, line_no int, code_produit string")
    cells = lambda *rows: spark.createDataFrame(rows, "doc_id string, line_no int, month string, quantity double")
    gold = lines(("d", 0, "A"), ("d", 1, "A"), ("d", 2, None)), cells(("d", 0, "2026-01", 9.0), ("d", 1, "2026-02", 2.0), ("d", 5, "2026-02", 2.0))
    own = lines(("d", 0, "A"), ("d", 1, "A"), ("d", 2, "B"), ("d", 3, None)), cells(("d", 0, "2026-02", 2.0), ("d", 1, "2026-03", 1.0), ("d", 2, "2026-01", 1.0))
    found = sorted((r.line_no, r.month or "", r.expected, r.actual) for r in score.matched_cells(*gold, *own).collect())
    assert found == [(0, "2026-02", 2.0, 2.0), (1, "2026-02", 2.0, None), (1, "2026-03", None, 1.0), (2, "", None, None), (3, "", None, None)]
