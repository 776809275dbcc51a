"""Sources and sinks of whole files, and lines in their order."""

import json
import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillframe.operators import dataset, pairing
from quillframe.plans import statements
from quillframe.sources import files, filesink, pages, tables
from tests import decoders
from tests.test_statements import MONTHLY
from tests.test_statements import pages as made

SINK = """
import os, sys
from pathlib import Path
from pyspark.sql import SparkSession
from quillframe.sources import filesink

out, marks, how = sys.argv[1:]
spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.python.worker.faulthandler.enabled", "false").getOrCreate()

def once(batches):
    for i, batch in enumerate(batches):
        yield batch
        mark = Path(marks) / f"failed-{batch['id'].iloc[0] // 50}"
        if how != "never" and not mark.exists():
            mark.touch()
            os._exit(1) if how == "killed" else 1 / 0

rows = spark.range(0, 200, 1, 4).mapInPandas(once, "id long").selectExpr("concat('d', id % 3, '/', id, '.expected.json') as name", "cast(concat('{\\"id\\": ', id, ', \\"t\\": \\"é\\"}') as binary) as content")
spark.dataSource.register(filesink.FileSink)
rows.write.format("file_a_row").option("indent", 2).mode("overwrite").save(out)
print(filesink.committed(spark, out))
"""


@pytest.mark.parametrize("how", ["failed", "killed"])
def test_sink_commits_each_file_once(tmp_path, how):
    (tmp_path / "marks").mkdir()
    out = tmp_path / "out"
    done = subprocess.run([sys.executable, "-c", SINK, str(out), str(tmp_path / "marks"), how], env=os.environ | {"PYTHONPATH": os.getcwd()}, capture_output=True, text=True, timeout=200)
    assert done.returncode == 0, done.stderr[-2000:]
    found = sorted(p for p in out.rglob("*.json") if p.name != filesink.COUNTS)
    assert len(list((tmp_path / "marks").iterdir())) == 4
    assert sorted(int(p.name.split(".")[0]) for p in found) == list(range(200)) and {p.parent.name for p in found} == {"d0", "d1", "d2"}
    counts = json.loads((out / filesink.COUNTS).read_text())
    assert counts == {"files": 200, "bytes": sum(p.stat().st_size for p in found), "tasks": 4}
    assert found[0].read_text() == '{\n  "id": 0,\n  "t": "é"\n}'
    assert sorted(p.name for p in tmp_path.iterdir()) == ["marks", "out"]  # no staging folder is left


def test_sink_is_all_or_nothing(spark, tmp_path):
    rows = lambda names: spark.createDataFrame([(n, n.encode()) for n in names], "name string, content binary").repartition(3)
    out = str(tmp_path / "out")
    assert filesink.write_files(rows(["a.txt", "b/c.txt"]), out) == {"files": 2, "bytes": 12, "tasks": 3}
    for odd in (["x", "x"], ["x", "../y"], ["ok", "_z"]):
        with pytest.raises(Exception, match="name"):
            filesink.write_files(rows(odd), out)
    with pytest.raises(ValueError, match="None"):
        filesink.write_files(spark.createDataFrame([(None, b"x")], "name string, content binary"), out)
    assert sorted(str(p.relative_to(out)) for p in Path(out).rglob("*.txt")) == ["a.txt", "b/c.txt"] and os.listdir(tmp_path) == ["out"]
    filesink.write_files(rows(["n.txt"]), out, mode="append")
    assert sorted(p.name for p in Path(out).rglob("*.txt")) == ["a.txt", "c.txt", "n.txt"]
    assert filesink.write_files(rows(["z.txt"]), out)["files"] == 1 and [p.name for p in Path(out).rglob("*.txt")] == ["z.txt"]
    assert filesink.write_files(rows(["z.txt"]).limit(0), out)["files"] == 0 and not list(Path(out).rglob("*.txt"))


def test_rows_reach_the_sink_in_small_batches(spark, tmp_path):
    """Python before the sink gets batches of the same bound, so names by batch tell how large they are; the setting is the session's own again."""
    key, before = "spark.sql.execution.arrow.maxBytesPerBatch", spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")

    def named(batches):
        for i, b in enumerate(batches):
            yield b.assign(name=[f"{i}-{k}" for k in b["id"]])[["name", "content"]]

    rows = spark.range(0, 24, 1, 1).selectExpr("id", "cast(repeat('x', 1 << 20) as binary) as content").mapInPandas(named, "name string, content binary")
    assert filesink.write_files(rows, str(tmp_path / "out")) == {"files": 24, "bytes": 24 << 20, "tasks": 1}
    batches = [p.name.split("-")[0] for p in (tmp_path / "out").iterdir() if "-" in p.name]
    assert len(batches) == 24 and max(map(batches.count, batches)) <= 5
    assert spark.conf.get(key) == before


def test_a_task_that_runs_on_leaves_nothing(tmp_path):
    """After an abort, and after a commit, a task of the same job cannot bring its folder back."""
    row = Row("name", "content")
    for end in ("abort", "commit"):
        writer = filesink.FileSink({"path": str(tmp_path / end)}).writer(StructType.fromDDL("name string, content binary"), True)

        def rows(writer=writer, end=end):
            yield row("a/b.txt", b"x")
            getattr(writer, end)([])
            yield row("c/d.txt", b"y")

        with pytest.raises(OSError):
            writer.write(rows())
        with pytest.raises(OSError):
            writer.write(iter([row("e.txt", b"z")]))
        writer.abort([])
    assert [str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file()] == [f"commit/{filesink.COUNTS}"] and not list(tmp_path.glob(".*"))


def test_statement_files(spark, tmp_path):
    s = statements.native(*made(spark, ("/in/a.v1.pdf", "LGPI", [MONTHLY]), ("/in/b", "é", [])))
    told, counts = files.write_statement_files(statements.nested(s), str(tmp_path / "gold"), ".expected.json", 2)
    assert {r.name: r.row_count for r in told.collect()} == {"a.v1.expected.json": 2, "b.expected.json": 0} and counts["files"] == 2
    text = (tmp_path / "gold" / "a.v1.expected.json").read_text()
    assert text.startswith('{\n  "document": {\n    "source_file": "/in/a.v1.pdf",') and '"generated_at": null' in text and "Libell" not in text
    assert json.loads((tmp_path / "gold" / "b.expected.json").read_text())["lines"] == []
    read, rejects = files.statements(spark, str(tmp_path / "gold"), "*.expected.json")
    assert {r.name: len(r.lines) for r in read.collect()} == {"a.v1.expected.json": 2, "b.expected.json": 0} and rejects.count() == 0


def test_gold_is_gathered_and_parsed_once(spark, tmp_path):
    """Lines with their cells beside them need no join, in the order of their numbers; a text is parsed once for its reason and its lines."""
    documents = spark.createDataFrame([("/in/a.pdf", ["2031-03"], 3)], "doc_id string, months array<string>, row_count int").selectExpr("doc_id", "'' as lgo", "'monthly' as statement_type", "'P' as pharmacy_name", "'' as address", "'1' as pharmacy_id", "'S' as supplier", "months", "1 as page_count", "row_count", "false as totals_reconciled", "array('') as flags")
    kind = "doc_id string, table_no int, row_no long, code_produit string, designation string, pa_cat double, pa_cat_net double, pv_ttc double, numbers array<struct<month:string,quantity:double>>"
    rows = [(1, 2, "3400000000002", [("2031-03", 2.0), ("2031-02", 1.0)]), (0, 11, "3400000000011", None), (0, 9, "3400000000009", [])]
    s = statements.Statements(documents, spark.createDataFrame([("/in/a.pdf", t, n, c, "d", None, 1.5, None, q) for t, n, c, q in rows], kind), None)
    files.write_statement_files(statements.nested(s), str(tmp_path / "gold"), ".expected.json", 2)
    read, _ = files.statements(spark, str(tmp_path / "gold"), "*.expected.json")
    (found,) = read.collect()
    assert [(i.code_produit, i.quantities) for i in found.lines] == [("3400000000009", {}), ("3400000000011", {}), ("3400000000002", {"2031-02": 1.0, "2031-03": 2.0})]
    told = read.select("name", F.explode("lines").alias("l")).select("name", "l.code_produit", F.explode("l.quantities"))
    assert told._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1


def test_pairs_are_copied(spark, tmp_path):
    for d in ("gold", "photos/x", "photos/y"):
        (tmp_path / d).mkdir(parents=True)
    for n in ("one", "two", "three", "alone"):
        (tmp_path / "gold" / f"{n}.json").write_text(n)
    for n, b in (("x/one.PNG", b"1" * 3_000_000), ("x/two_1.jpg", b"x2"), ("y/two_1.jpg", b"y2"), ("y/t hrée.tif", b"3"), ("y/notes.txt", b"n")):
        (tmp_path / "photos" / n).write_bytes(b)
    gold = spark.read.format("binaryFile").load(str(tmp_path / "gold")).select("path", F.regexp_extract("path", r"([^/]*)\.json$", 1).alias("stem"))
    named = spark.createDataFrame([("three", "T-hre.png")], "stem string, image string")
    pairs = pairing.pair(gold, files.images(spark, str(tmp_path / "photos")).select("path"), named)
    counts = pairing.copy(pairs, gold, str(tmp_path / "out"))
    assert counts["files"] == 6 and pairing.counters(pairs).first()[:] == (3, 1, 1)
    assert {str(p.relative_to(tmp_path / "out")): p.read_bytes()[:2] for d in ("images", "jsons") for p in (tmp_path / "out" / d).iterdir()} == {"images/one.PNG": b"11", "images/two_1.jpg": b"x2", "images/t hrée.tif": b"3", "jsons/one.json": b"on", "jsons/two.json": b"tw", "jsons/three.json": b"th"}
    assert {(r.image, r.gold) for r in pairing.mapping(pairs, '.json').collect()} == {("images/one.PNG", "jsons/one.json"), ("images/two_1.jpg", "jsons/two.json"), ("images/t hrée.tif", "jsons/three.json")}


def seen(folder, kind):
    return len(list(folder.glob(f"{kind}-*")))


def test_page_source(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    mark = tmp_path / "seen"
    mark.mkdir()
    told = lambda *p: json.dumps({"seen": str(mark), "pages": p})
    for name, content in (("a.pdf", told(["text", [MONTHLY, [["x", None]]]], [None, None])), ("sub/b.PDF", told(["é", [[["y"]]]])), ("c.pdf", "broken"), ("d.txt", "{}"), ("_e.pdf", "x")):
        (tmp_path / "in" / name).write_text(content)
    spark.dataSource.register(pages.PageSource)
    read = lambda: spark.read.format("statement_pages").option("decoder", "tests.decoders:counting").option("partition_bytes", 1)
    everything = read().load(str(tmp_path / "in"))
    assert everything.rdd.getNumPartitions() == 3
    key = lambda r: (r.doc_id.rsplit("/", 1)[1], r.page_no, r.text.split(":")[0], sorted(map(tuple, r.cells)))
    want = sorted(map(key, files.documents(spark, str(tmp_path / "in"), decoders.counting).filter("doc_id not like '%/_e.pdf'").collect()))
    assert sorted(map(key, everything.collect())) == want and len(want) == 4
    assert files.unreadable(everything).count() == 1 and files.raw_cells(everything).count() == sum(map(len, MONTHLY)) + 3
    for f in mark.iterdir():
        f.unlink()
    texts = read().schema("text string, doc_id string, page_no int").load(str(tmp_path / "in"))
    assert sorted(r.text for r in files.page_texts(texts).collect()) == ["", "text", "é"] and (seen(mark, "page"), seen(mark, "table")) == (3, 0)
    with pytest.raises(Exception, match="has the columns"):
        read().schema("words long").load(str(tmp_path / "in")).count()
    with pytest.raises(Exception, match="FileNotFound"):
        read().load(str(tmp_path / "none")).count()


def test_decoding_ends_early(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "seen").mkdir()
    for name, lengths in (("long", [5, 0, 30, 30, 30]), ("short", [9, 9]), ("none", [])):
        (tmp_path / "in" / f"{name}.pdf").write_text(json.dumps({"seen": str(tmp_path / "seen"), "pages": [[" " * 40 + "x" * n, []] for n in lengths]}))
    (tmp_path / "in" / "bad.pdf").write_text("?")
    want = {"long": True, "short": False, "none": False, "bad": None}
    spark.dataSource.register(pages.PageSource)
    source = spark.read.format("statement_pages").option("decoder", "tests.decoders:counting").schema("doc_id string, has_text boolean").load(str(tmp_path / "in"))
    for i, df in enumerate((source, files.text_layers(spark, str(tmp_path / "in"), decoders.counting)), 1):
        assert {Path(r.doc_id).stem: r.has_text for r in df.collect()} == want
        assert (seen(tmp_path / "seen", "page"), seen(tmp_path / "seen", "table")) == (5 * i, 0)


def test_other_files_are_not_opened(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "p.JpEg").write_bytes(b"x")
    (tmp_path / "a" / "q.tiff").write_bytes(b"y")
    os.truncate(os.open(tmp_path / "a" / "huge.bin", os.O_CREAT | os.O_RDWR), 3 << 30)  # more than a row can hold
    assert sorted((Path(r.path).name, bytes(r.content)) for r in files.images(spark, str(tmp_path)).collect()) == [("p.JpEg", b"x"), ("q.tiff", b"y")]


def test_lines_keep_their_order(spark, tmp_path):
    for name, n, blank in (("a", 5000, 3100), ("b", 40, None), ("c", 3, 0)):
        (tmp_path / f"{name}.jsonl").write_text("".join("  \n" if i == blank else json.dumps({"image": f"{name}{i}", "output": "x" * (i % 90)}) + "\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = files.lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 10
        got = {}
        for r in lines.collect():
            got.setdefault(Path(r.path).name, {})[r.line_no] = r.value
        for name in "abc":
            assert [got[f"{name}.jsonl"][i] for i in range(len(got[f"{name}.jsonl"]))] == (tmp_path / f"{name}.jsonl").read_text().splitlines()
        one = files.lines(spark, str(tmp_path / "a.jsonl"))
        assert [r.line_no for r in dataset.head(one, 9999, "line_no").collect()] == list(range(3100))
        assert [(r.no, r.image) for r in dataset.demonstrations(one, 2).collect()] == [(0, "a0"), (1, "a1")]
        assert sorted((Path(r.path).name, r.line_no) for r in dataset.heads(lines, 2).collect()) == [("a.jsonl", 0), ("a.jsonl", 1), ("b.jsonl", 0), ("b.jsonl", 1)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_compressed_texts(spark, tmp_path):
    out = str(tmp_path / "out")
    filesink.write_files(spark.createDataFrame([("a.json.gz", b'{"t": "aaaaaaaaaa"}' * 99), ("b.json", b"{}"), ("c.gz", b"x")], "name string, content binary"), out)
    assert files.json_texts(spark, out, "*.json.gz").collect() == [Row(name="a.json", value='{"t": "aaaaaaaaaa"}' * 99)]
    assert files.json_texts(spark, out, "[a-z]*.json").collect() == [Row(name="b.json", value="{}")]
    assert (tmp_path / "out/a.json.gz").stat().st_size < 99


def test_split_files_are_ascii(spark, tmp_path):
    rows = spark.createDataFrame([("é €", None, "test")], "image string, output string, split string")
    files.write_split(rows, str(tmp_path / "s"))
    (part,) = (tmp_path / "s" / "split=test").glob("part-*")
    assert part.read_bytes().isascii() and json.loads(part.read_text()) == {"image": "é €", "output": None}


@pytest.mark.parametrize("left", [1, dataset.LEFT])
def test_ranks_are_exact(spark, monkeypatch, left):
    monkeypatch.setattr(dataset, "LEFT", left)
    h = spark.range(20_000).select(F.md5(F.col("id").cast("string")).alias("h")).union(spark.createDataFrame([("0" * 31 + x,) for x in "0123"], "h string"))
    h = tables.once(h)
    want = sorted(r.h for r in h.collect())
    ranks = [1, 3, 4, 5, 10_000, 20_004, 99_999, 0]
    assert dataset.smallest(h, ranks) == {r: want[min(r, len(want)) - 1] for r in ranks if r}
    assert dataset.smallest(h.limit(0), ranks) == {}
