import json
import uuid

import pytest
from pyspark.sql import functions as F

from quillframe.operators import engine, pairing
from quillframe.plans import api, rules
from quillframe.sources import files
from tests.test_statements import MONTHLY, Fake, export


def test_extract_and_compare(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "s.pdf").write_bytes(json.dumps([["LGPI", [[*MONTHLY, ["", "TOTAL", "", "", "", "12", "5", "9"]]]]]).encode())
    (tmp_path / "a" / "bad.pdf").write_bytes(b"x")
    (tmp_path / "p.JPG").write_bytes(b"photo")
    (tmp_path / "n.txt").write_text("x")
    decode = lambda content: [tuple(p) for p in json.loads(content)]
    s, rejects = api.extract(spark, str(tmp_path), decode, Fake)
    d = {r.doc_id.rsplit("/", 1)[1]: r for r in s.documents.collect()}
    assert d["s.pdf"].totals_reconciled and d["s.pdf"].row_count == 2 and d["p.JPG"].row_count == 1 and d["p.JPG"].months == ["2026-01"]
    assert {r.doc_id.rsplit("/", 1)[1]: r.reason.split(":")[0] for r in rejects.collect()} == {"bad.pdf": "JSONDecodeError", "n.txt": "unsupported suffix"}
    scores, total, diffs = api.compare(s, s)
    assert total.first().cell_precision == 1.0 and diffs.count() == 0 and scores.count() == 2
    assert api.console_report(total, diffs).startswith("cell_precision: 1.0000\nreconciled_rate: 1.0000\ncells_compared: 6")
    only, rejects = api.extract(spark, str(tmp_path), decode)
    assert only.documents.count() == 1 and rejects.filter("reason like 'nothing given%'").count() == 1
    with pytest.raises(ValueError):
        api.extract(spark, str(tmp_path))
    assert api.validate_config(rules.DEFAULT) is rules.DEFAULT


class Counting:
    """Leaves a file for each image it reads."""

    def __init__(self, folder):
        self.folder = folder

    def extract(self, image, template):
        (self.folder / uuid.uuid4().hex).touch()
        return Fake().extract(image, template)


def test_each_file_is_read_once(spark, tmp_path):
    seen, decoded = tmp_path / "seen", tmp_path / "decoded"
    for d in (seen, decoded, tmp_path / "in"):
        d.mkdir()
    for i in range(6):
        (tmp_path / "in" / f"{i}.png").write_bytes(b"photo")
        (tmp_path / "in" / f"{i}.pdf").write_bytes(json.dumps([["", [MONTHLY]]]).encode())

    def decode(content):
        (decoded / uuid.uuid4().hex).touch()
        return [tuple(p) for p in json.loads(content)]

    s, rejects = api.extract(spark, str(tmp_path / "in"), decode, lambda: Counting(seen))
    assert (s.documents.count(), s.lines.count(), s.cells.count(), rejects.count()) == (12, 18, 36, 0)
    assert len(list(seen.iterdir())) == len(list(decoded.iterdir())) == 6
    gold = s.lines.filter("doc_id like '%png'").select("doc_id", F.col("row_no").alias("line_no"), "code_produit"), s.cells.filter("doc_id like '%png'").select("doc_id", F.col("row_no").alias("line_no"), "month", "quantity")
    images = files.images(spark, str(tmp_path / "in")).withColumnRenamed("path", "doc_id")
    assert {r.cell_precision for r in engine.evaluate(images, lambda: Counting(seen), *gold).collect()} == {1.0} and len(list(seen.iterdir())) == 12
    begun = spark.sparkContext.accumulator(0)
    engine.completions(images, Fake, progress=begun).collect()
    assert begun.value == 6 and [engine.device(*a) for a in (("cpu", True), (None, True), (None, False))] == ["cpu", "cuda", "cpu"]


def test_gold_and_images(spark, tmp_path):
    for d in ("gold", "photos/a"):
        (tmp_path / d).mkdir(parents=True)
    for name, x in (("one.expected.json", {}), ("two.json", {"uri": "store:/x/shop.JPG"}), ("three.expected.json", {"image": 5})):
        (tmp_path / "gold" / name).write_text(json.dumps(x))
    for name in ("one_3.png", "SHOP.jpg"):
        (tmp_path / "photos" / "a" / name).write_bytes(b"x")
    pairs = api.gold_images(spark, str(tmp_path / "gold"), str(tmp_path / "photos"))
    assert {r.stem: r.tier for r in pairs.collect()} == {"one": 2, "two": 4, "three": None}
    assert [(r.stem, r.image, r.gold) for r in pairing.mapping(api.gold_images(spark, str(tmp_path / "gold"), str(tmp_path / "photos"), limit=1)).collect()] == [("one", "images/one_3.png", "jsons/one.expected.json")]


def test_convert(spark, tmp_path):
    for name, text in (("a", export()), ("b", "broken"), ("c", export().replace('"2026-01-31"', '"later"')), ("d", export().replace("0.5", "1.5"))):
        (tmp_path / f"{name}.json").write_text(text)
    documents, lines, cells, skipped, failures = api.convert_exports(spark, str(tmp_path))
    assert [(r.doc_id, r.lgo, r.totals_reconciled, r.row_count, r.months) for r in documents.collect()] == [("a.json", "etat_des_ventes", True, 1, ["2026-01"])]
    assert lines.count() == 1 and cells.count() == 1 and {r.doc_id: r.reason for r in failures.collect()} == {"b.json": "not a JSON object", "c.json": "month is not yyyy-MM", "d.json": "confidence out of range"}
    assert api.conversion_counters(documents, skipped, failures).first()[:] == (1, 1, 3)


def test_exports_are_read_once(spark, tmp_path):
    """All tables come from one reading of the files, so they agree whatever becomes of the files after it."""
    sale = lambda text, month="2026-01": '{"type": "sales_by_month", "properties": [{"type": "month_period_normalized", "mentionText": "%s-01"}, {"type": "sales_quantity", "mentionText": "4", "normalizedValue": {"text": %s}}]}' % (month, text)
    line = '{"type": "product_line", "properties": [{"type": "product_ean", "mentionText": "%s"}, %s]}'
    good = line % ("3400900000001", ", ".join(map(sale, ('"2"', "9", '" +3 "', "null", "{}", '"x"', '"2.0"')))) + ", " + line % ("12", sale('"1"', "soon"))
    total = '{"type": "total_line", "properties": [%s, 7, %s]}' % (sale('"17"'), sale('"0"', "2026-02"))
    (tmp_path / "a.json").write_text('{"entities": [5, null, %s, %s, {"type": "total_line"}]}' % (good, total))
    (tmp_path / "b.json").write_text('{"entities": {}}')
    (tmp_path / "c.json").write_text('{"entities": [%s], "entities": []}' % good)
    documents, lines, cells, skipped, failures = api.convert_exports(spark, str(tmp_path))
    for name in "abc":
        (tmp_path / f"{name}.json").unlink()
    assert sorted((r.doc_id, r.totals_reconciled, r.row_count, r.months) for r in documents.collect()) == [("a.json", True, 1, ["2026-01"]), ("b.json", False, 0, [])]
    assert [r.line_no for r in lines.collect()] == [2] and [r[:] for r in cells.collect()] == [("a.json", 2, "3400900000001", "2026-01", 17)]
    assert [r[:] for r in skipped.collect()] == [("a.json", 3, "non-13-digit code", "12")] and [r[:] for r in failures.collect()] == [("c.json", "not a JSON object")]


def test_training_split(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"g{i}_1.png").write_bytes(b"x")
    gold = spark.createDataFrame([(f"g{i}",) for i in range(6)], "stem string")
    rows, unmatched = api.training_split(spark, gold, str(tmp_path), gold.selectExpr("stem", "concat('{', stem, '}') as output"), 1, 1)
    assert sorted(r.split for r in rows.collect()) == ["test", "train", "train", "train", "val"] and [r.stem for r in unmatched.collect()] == ["g5"]
    demos = spark.createDataFrame([(1, "b.png", "{}"), (0, "a.png", "[]")], "no int, image string, output string")
    m = engine.messages(demos).first().messages
    assert [(t.role, t.image, t.text) for t in m][::2] == [("user", "a.png", engine.TEMPLATE), ("user", "b.png", engine.TEMPLATE)] and m[1].text == "[]"
