"""What the training-data operators share: table access, written intermediate tables, size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of a slim (a few dozen bytes) side up to which a join may broadcast it; beyond, the join shuffles.
BROADCAST_ROWS = 400_000
#: Slim tables of a known number of rows have so many of them in a file at least, unless that would leave too few files.
ROWS_A_FILE, LEAST_FILES = 50_000, 8

_LOCAL: list[str] = []
_SCRATCH: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="quillframe-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return _LOCAL[0]


def _hadoop(spark: SparkSession, path: str):
    """(file system, path) of a path in the JVM."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def written(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df as a table in the shared folder, computed once: lineage ends there and a lost executor loses nothing. It is deleted by discard() or, at the latest, when the driver's JVM ends. rows: a bound for its number of slim rows, from which follows how many files are enough."""
    if hasattr(df, "_qf_path"):
        return df
    return _written(df.sparkSession, df.schema, [df if rows is None else df.coalesce(max(LEAST_FILES, -(-rows // ROWS_A_FILE)))])


def _written(spark: SparkSession, schema: StructType, parts: Iterable[DataFrame]) -> DataFrame:
    path = f"{shared_dir(spark)}/quillframe-{uuid.uuid4().hex}"
    fs, p = _hadoop(spark, path)
    for df in parts:
        df.write.mode("append").parquet(path)
        fs.deleteOnExit(p)
    out = spark.read.schema(schema).parquet(path)
    out._qf_path = path
    for made in _SCRATCH:
        made.append(out)
    return out


def fresh(spark: SparkSession) -> str:
    """An empty folder in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/quillframe-{uuid.uuid4().hex}"
    fs, p = _hadoop(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Discards, at its end, the tables written within, but for those that the function it gives has kept: for steps whose result has been written itself."""
    made: list[DataFrame] = []
    kept: list[str] = []

    def keep(t: DataFrame) -> DataFrame:
        kept.append(t._qf_path)
        return t

    _SCRATCH.append(made)
    try:
        yield keep
    finally:
        _SCRATCH.remove(made)
        discard(*(t for t in made if t._qf_path not in kept))


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables of written() that no later plan reads."""
    for t in tables:
        path = getattr(t, "_qf_path", None)
        if path:
            fs, p = _hadoop(t.sparkSession, path)
            fs.delete(p, True)


def small(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows are within the bound, else as it is (the join then shuffles)."""
    return F.broadcast(df) if rows <= most else df


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df as a written table with a number for each row, unique but with gaps; rows of one task have consecutive numbers."""
    return written(df.withColumn(name, F.monotonically_increasing_id()))


def picked(rows: DataFrame, ids: DataFrame, name: str, how: str, then: Callable[[DataFrame], DataFrame] = lambda x: x, most: int | None = None) -> DataFrame:
    """then() of the rows of a numbered() table whose number is among the distinct ids(name) (how: left_semi), or is not (left_anti).

    No row of the table is shuffled, however many ids there are: ids are broadcast in slices of at most so many, each for
    a range of numbers, of which the scan reads only the row groups that may have any. Several slices give a written table.
    """
    most = most or BROADCAST_ROWS
    step = most.bit_length() - 1  # a chunk of numbers holds 2 ** step ids at most
    ranges: list[list[int]] = []
    for chunk, n in sorted((r.chunk, r.n) for r in ids.groupBy(F.shiftright(F.col(name), step).alias("chunk")).agg(F.count(F.lit(1)).alias("n")).collect()):
        if ranges and ranges[-1][1] + n <= most:
            ranges[-1][1] += n
        else:
            ranges.append([chunk << step, n])
    lows = [r[0] for r in ranges]
    if len(lows) < 2:
        return then(rows.join(F.broadcast(ids), name, how))
    key = F.col(name)
    parts = []
    for lo, hi in zip([None, *lows[1:]], [*lows[1:], None], strict=True):
        within = F.lit(True)
        if lo is not None:
            within = within & (key >= lo)
        if hi is not None:
            within = within & (key < hi)
        parts.append(then(rows.filter(within).join(F.broadcast(ids.filter(within)), name, how)))
    return _written(rows.sparkSession, parts[0].schema, parts)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(key: Column | str, folds: int, fold: int) -> Column:
    """True where crc32 of the key as text, mod folds, is fold; a null key is never held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string") if isinstance(key, str) else key.cast("string")) % folds == fold, F.lit(False))


def free(df: DataFrame, stem: str) -> str:
    """A column name that df does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def kept_by(docs: DataFrame, passes: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows of docs whose text passes: from a batch of texts, a truth value each. Only texts go to Python, and only truth values come back."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array(passes(texts), pa.bool_())

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return docs.filter(F.arrow_udf(run, "boolean")(F.col("text").cast("string")))
