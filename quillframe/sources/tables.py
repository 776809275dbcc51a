"""Tables that a job writes once and reads several times."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a slim table up to which a join may broadcast it; beyond, the join shuffles.
BROADCAST_ROWS = 400_000

_LOCAL: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master.startswith("local-cluster") or not master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="statements-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return _LOCAL[0]


def _hadoop(spark: SparkSession, place: str):
    """(file system, path) in the JVM."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path


def fresh(spark: SparkSession) -> str:
    """An empty folder in the shared folder, deleted when the driver's JVM ends."""
    place = f"{shared_folder(spark)}/statements-{uuid.uuid4().hex}"
    fs, path = _hadoop(spark, place)
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return place


def once(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: whatever reads it sees the same rows, and nothing before it runs again. discard() deletes it; else it goes when the driver's JVM ends."""
    place = f"{fresh(df.sparkSession)}/table"
    df.write.parquet(place)
    out = df.sparkSession.read.schema(df.schema).parquet(place)
    out._place = place.rpartition("/")[0]
    return out


def small(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows are within the bound."""
    return F.broadcast(df) if rows <= most else df


def discard(*tables: DataFrame) -> None:
    """Deletes tables of once() that no later plan reads."""
    for t in tables:
        if place := getattr(t, "_place", None):
            fs, path = _hadoop(t.sparkSession, place)
            fs.delete(path, True)


def joined(spark: SparkSession, folder: str, path: str) -> None:
    """The part files of a folder, in order, as one file; bytes are streamed."""
    fs, source = _hadoop(spark, folder)
    there, target = _hadoop(spark, path)
    out = there.create(target, True)
    try:
        for status in sorted(fs.listStatus(source), key=lambda s: s.getPath().getName()):
            if status.getPath().getName().startswith("part-"):
                part = fs.open(status.getPath())
                spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
                part.close()
    finally:
        out.close()
