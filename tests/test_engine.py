"""Images in batches by pixels, counts of what is written, signatures by the thousand, rules by date."""

import json
import os
import struct
import subprocess
import sys
import uuid
import zlib
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from quillframe.functions import exprs as x
from quillframe.operators import engine, signatures, versions
from quillframe.plans import rules


def png(w, h):
    return b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)


def jpeg(w, h):
    return b"\xff\xd8\xff\xe0\x00\x10JFIF\0" + b"\0" * 9 + b"\xff\xff\xc4\x00\x05abc\xff\xc2\x00\x11\x08" + struct.pack(">HH", h, w) + b"\x03" * 10


def tiff(w, h, order="<"):
    head = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 10) + b"xx"
    return head + struct.pack(order + "HHHIIHHIHH", 2, 256, 4, 1, w, 257, 3, 1, h, 0)


def test_sizes():
    for make in (png, jpeg, tiff, lambda w, h: tiff(w, h, ">")):
        assert engine.image_size(make(4000, 3000)) == (4000, 3000)
    for odd in (b"", b"GIF89a", png(1, 1)[:20], jpeg(1, 1)[:30], b"II*\0\xff\xff\xff\xff"):
        assert engine.image_size(odd) is None


def test_scaled_as_by_columns(spark):
    sizes = [(4000, 3000), (800, 600), (10, 10_000_000), (3, 1_000_001), (1, 1)]
    rows = spark.createDataFrame(sizes, "w int, h int").select(x.target_size(F.col("w").cast("long"), F.col("h").cast("long"), F.lit(1_000_000)).alias("s")).collect()
    assert [engine.scaled(s, 1_000_000) for s in sizes] == [r.s and (r.s.width, r.s.height) for r in rows]
    assert engine.scaled((9, 9), None) is None and engine.scaled(None, 5) is None


def test_no_batch_is_above_the_budget():
    images = [(i, png(100 + 37 * i % 900, 1000)) for i in range(60)] + [("large", png(5000, 5000)), ("odd", b"?"), ("last", png(1, 1))]
    batches = list(engine.packed(images, 500_000, 1_200_000))
    assert [k for b in batches for k, *_ in b] == [k for k, _ in images]
    pixels = [[(to or engine.image_size(c) or (0, 0)) for _, c, to in b] for b in batches]
    assert all(sum(w * h for w, h in b) <= 1_200_000 for b in pixels) and max(map(len, batches)) > 2
    assert [len(b) for b in engine.packed(images, None, 1_200_000) if b[0][0] in ("large", "odd")] == [1, 1]


class Batching:
    """Tells each image's size and scale; leaves a file for each load and each batch. Batches with a bad image fail."""

    def __init__(self, folder):
        self.folder = Path(folder)
        (self.folder / f"load-{os.getpid()}-{uuid.uuid4().hex}").touch()

    def extract_many(self, images, template):
        (self.folder / f"batch-{len(images)}-{uuid.uuid4().hex}").touch()
        if any(c == b"bad" for c, _ in images):
            raise ValueError("a bad image")
        return [json.dumps({"size": engine.image_size(c), "to": to}) for c, to in images]


def test_batches_change_no_result(spark, tmp_path):
    rows = [(i, b"bad" if i == 33 else png(100 + 7 * i, 900)) for i in range(120)]
    images = spark.createDataFrame(rows, "doc_id int, content binary").repartition(12)
    got = []
    for budget in (1, 700_000, 10**9):
        counts = Observation()
        found = engine.completions(images, lambda: Batching(tmp_path), max_pixels=300_000, budget=budget, counts=counts)
        got.append({r.doc_id: (r.completion, r.reason) for r in found.collect()})
        assert counts.get == {"images": 120, "failed": 1}
    assert got[0] == got[1] == got[2] and got[0][33] == (None, "ValueError: a bad image")
    assert json.loads(got[0][119][0]) == {"size": [933, 900], "to": [557, 537]}
    loads = [p.name.split("-")[1] for p in tmp_path.glob("load-*")]
    assert max(loads.count(p) for p in set(loads)) <= 3  # of three factories, each once a process
    assert any(int(p.name.split("-")[1]) > 5 for p in tmp_path.glob("batch-*"))


COUNTED = """
import os, sys
from pathlib import Path
from pyspark.sql import Observation, SparkSession
from quillframe.operators import engine

out, marks = sys.argv[1:]
spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.execution.arrow.maxRecordsPerBatch", "10").getOrCreate()

class Once:
    def extract(self, image, template):
        mark = Path(marks) / image.decode().split()[0]
        if not mark.exists():
            mark.touch()
            os._exit(1)
        if image.endswith(b"7"):
            raise ValueError("seven")
        return "{}"

counts, progress = Observation(), spark.sparkContext.accumulator(0)
images = spark.range(0, 100, 1, 4).selectExpr("id as doc_id", "cast(concat(spark_partition_id(), if(id % 25 = 15, 'x', ''), ' ', id) as binary) as content")
engine.completions(images, Once, counts=counts, progress=progress).write.parquet(out)
read = spark.read.parquet(out)
print("COUNTS", counts.get["images"], counts.get["failed"], read.count(), read.filter("reason is not null").count())
"""


def test_counts_are_of_what_is_written(tmp_path):
    (tmp_path / "marks").mkdir()
    done = subprocess.run([sys.executable, "-c", COUNTED, str(tmp_path / "out"), str(tmp_path / "marks")], env=os.environ | {"PYTHONPATH": os.getcwd()}, capture_output=True, text=True, timeout=200)
    assert done.returncode == 0, done.stderr[-2000:]
    assert len(list((tmp_path / "marks").iterdir())) == 8 and "COUNTS 100 10 100 10" in done.stdout


@pytest.mark.parametrize("most", [signatures.BYTES_A_PASS, 60])
def test_many_signatures(spark, most):
    told = [("z", "Straße", 5), ("a", "ÉTAT", 7), ("a", "état des", 7), ("b", "needle 9", 1), ("c", "dd", 9), ("d", None, 0), ("e", "x", None), ("f", "Needle 99", 0), *((f"n{i}", f"needle {i}", 100 + i) for i in range(10, 60))]
    rows = [(1, "un État des lieux"), (2, "the NEEDLE 99 is"), (3, "needle 9"), (4, None), (5, "zzz"), (6, "straße"), (7, "needle 44 needle 12")]
    docs, table = spark.createDataFrame(rows, "k int, text string"), spark.createDataFrame(told, "lgo string, signature string, priority long")
    got = {r.k: r.lgo for r in signatures.fingerprints(docs, table, most).collect()}
    assert got == {1: "a", 2: "f", 3: "b", 4: None, 5: None, 6: "z", 7: "n12"}
    empty = table.union(spark.createDataFrame([("all", "", 8)], table.schema))
    assert {r.k: r.lgo for r in signatures.fingerprints(docs, empty, most).collect()} == got | {4: "all", 5: "all", 7: "all"}
    assert {r.lgo for r in signatures.fingerprints(docs, table.limit(0), most).collect()} == {None}
    own = signatures.table(spark, rules.DEFAULT)
    texts = docs.union(spark.createDataFrame([(8, "win pharma LGPI"), (9, "Etat des VENTES lgpi")], docs.schema))
    assert {(r.k, r.lgo, r.l) for r in signatures.fingerprints(texts, own, most).select("k", "lgo", x.fingerprint(F.col("text")).alias("l")).collect()} == {(k, None, None) for k in range(1, 8)} | {(8, "lgpi", "lgpi"), (9, "etat_des_ventes", "etat_des_ventes")}


def test_rules_in_force(spark):
    at = lambda y, m, d: date(y, m, d)
    aliases = spark.createDataFrame([(at(2020, 1, 1), " CIP ", "code"), (at(2021, 6, 1), "cip", "old"), (at(2021, 6, 1), "cip", "code2"), (at(2021, 6, 1), "Ean", "code"), (None, "cip", "never")], "valid_from date, alias string, field string")
    heads = spark.createDataFrame([(1, "Cip", at(2019, 12, 31)), (2, "CIP", at(2020, 1, 1)), (3, "cip ", at(2021, 5, 31)), (4, "cip", at(2021, 6, 1)), (5, "EAN", at(2030, 1, 1)), (6, "EAN", at(2020, 2, 1)), (7, "cip", None), (8, None, at(2022, 1, 1))], "k int, label string, day date")
    assert {r.k: r.field for r in versions.columns(heads, aliases).collect()} == {1: None, 2: "code", 3: "code", 4: "code2", 5: "code", 6: None, 7: None, 8: None}
    tokens = spark.createDataFrame([(at(2020, 1, 1), "jan", 1, 0), (at(2021, 1, 1), "janv", 1, 1), (at(2021, 1, 1), "déc", 12, 0)], "valid_from date, token string, month int, rank int")
    labels = spark.createDataFrame([(1, "Jan 2020", at(2020, 5, 1)), (2, "jan", at(2021, 5, 1)), (3, "janv. DÉC", at(2021, 5, 1)), (4, "janv", at(2021, 1, 1))], "k int, label string, day date").withColumn("reference_year", F.lit(1999))
    assert {r.k: r.month for r in versions.months(labels, tokens).collect()} == {1: "2020-01", 2: None, 3: "1999-12", 4: "1999-01"}
    assert {r.k: r.field for r in versions.columns(heads, aliases.limit(0)).collect()} == dict.fromkeys(range(1, 9))
