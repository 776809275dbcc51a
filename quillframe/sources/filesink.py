"""A sink that writes a file of its own for each row, for which Spark's writers have no form.

    spark.dataSource.register(FileSink)
    rows.write.format("file_a_row").mode("overwrite").save(folder)

rows: name (of the file, below the folder), and content (bytes; compressed if the name ends in .gz) or copy_from (a file whose
bytes are copied, so that large files never pass through rows). Each task writes to a folder of its own below a hidden staging folder and moves its files to their
names there when it has them all; what a failed or killed attempt leaves is in no message and is deleted. Tasks report how
much they wrote; the driver writes the sums beside the files and makes the folder visible by a single rename, however many
files there are. Until then readers see the old folder, or none. mode("append") moves the new files one by one instead.

Names must be distinct (write_files() checks that), and rows must be the same when a task runs again.
"""

from __future__ import annotations

import gzip
import json
import shutil
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from quillframe.sources.stores import opened

ROWS = "name string, content binary, copy_from string"
#: The file with the counts of a commit; readers pass over names that begin so.
COUNTS = "_committed.json"
#: Bytes of rows that reach a task of the sink at once. A worker holds a batch several times over, in columns and in rows.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@dataclass
class Written(WriterCommitMessage):
    """What a task has written."""

    files: int
    bytes: int


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_a_row"

    def schema(self) -> str:
        return ROWS

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        writer = FileWriter(self.options["path"], overwrite, int(self.options.get("indent", 0)), schema.fieldNames())
        store, staging = opened(writer.staging)
        store.create_dir(staging, recursive=True)  # tasks make none, so one that runs on after an abort leaves nothing
        return writer


class FileWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool, indent: int, columns: list[str]):
        self.path, self.overwrite, self.indent, self.columns = path.rstrip("/"), overwrite, indent, columns
        head, _, tail = self.path.rpartition("/")
        self.staging = f"{head}/.{tail}-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        store, staging = opened(self.staging)
        own = f"{staging}/.attempt-{uuid.uuid4().hex}"
        made: set[str] = set()
        names, size = [], 0
        store.create_dir(own, recursive=False)
        for row in (Row(**(dict.fromkeys(("content", "copy_from")) | dict(zip(self.columns, r, strict=True)))) for r in iterator):
            if row.name.startswith(("/", ".", "_")) or "/." in row.name:
                raise ValueError(f"{row.name} cannot be a file's name here")
            _folders(store, own, row.name, made)
            with store.open_output_stream(f"{own}/{row.name}", compression=None) as out:
                if row.copy_from is not None:
                    source, path = opened(row.copy_from)
                    with source.open_input_stream(path, compression=None) as content:
                        shutil.copyfileobj(content, out, 1 << 20)
                else:
                    content = self._laid_out(bytes(row.content or b""))
                    out.write(gzip.compress(content, 1, mtime=0) if row.name.endswith(".gz") else content)
                size += out.tell()
            names.append(row.name)
        for name in names:
            _folders(store, staging, name, made)
            store.move(f"{own}/{name}", f"{staging}/{name}")
        return Written(len(names), size)

    def _laid_out(self, content: bytes) -> bytes:
        return json.dumps(json.loads(content), ensure_ascii=False, indent=self.indent).encode() if self.indent else content

    def commit(self, messages: list[Written | None]) -> None:
        store, staging = opened(self.staging)
        _, target = opened(self.path)
        told = [m for m in messages if m is not None]
        for left in store.get_file_info(fs.FileSelector(staging)):
            if left.base_name.startswith(".attempt-"):
                store.delete_dir(left.path)
        with store.open_output_stream(f"{staging}/{COUNTS}") as out:
            out.write(json.dumps({"files": sum(m.files for m in told), "bytes": sum(m.bytes for m in told), "tasks": len(told)}).encode())
        there = store.get_file_info(target).type != fs.FileType.NotFound
        if there and not self.overwrite:
            for f in store.get_file_info(fs.FileSelector(staging, recursive=True)):
                if f.type == fs.FileType.File:
                    name = f.path[len(staging) + 1 :]
                    _folders(store, target, name, set())
                    store.move(f.path, f"{target}/{name}")
            store.delete_dir(staging)
            return
        if there:
            store.move(target, f"{staging}-old")
        store.move(staging, target)
        if there:
            store.delete_dir(f"{staging}-old")

    def abort(self, messages: list[Written | None]) -> None:
        store, staging = opened(self.staging)
        for _ in range(5):  # a task that still runs may put a file beside those that are deleted
            try:
                if store.get_file_info(staging).type != fs.FileType.NotFound:
                    store.delete_dir(staging)
                return
            except OSError:
                time.sleep(0.2)


def _folders(store: fs.FileSystem, root: str, name: str, made: set[str]) -> None:
    """The folders of a file below a folder that is there, each once."""
    path = root
    for part in name.split("/")[:-1]:
        path = f"{path}/{part}"
        if path not in made:
            store.create_dir(path, recursive=False)
            made.add(path)


def write_files(rows: DataFrame, path: str, indent: int = 0, mode: str = "overwrite") -> dict[str, int]:
    """Writes rows (name, content or copy_from) as files, and gives the commit's counts. indent lays JSON contents out. Two rows of one name, or a null name, are a ValueError, before anything is written."""
    columns = dict(rows.dtypes)
    all_ = rows.select("name", *((F.col(c) if c in columns else F.lit(None)).cast(kind).alias(c) for c, kind in (("content", "binary"), ("copy_from", "string"))))
    odd = all_.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or name is null").select("name").first()
    if odd is not None:
        raise ValueError(f"the name {odd.name} is not a row's own")
    rows.sparkSession.dataSource.register(FileSink)
    conf = rows.sparkSession.conf
    before = conf.get(_BATCH, None)
    conf.set(_BATCH, BATCH_BYTES)
    try:
        all_.write.format("file_a_row").option("indent", indent).mode(mode).save(path)
    finally:
        conf.unset(_BATCH) if before is None else conf.set(_BATCH, before)
    return committed(rows.sparkSession, path)


def committed(spark: SparkSession, path: str) -> dict[str, int]:
    """The counts (files, bytes, tasks) of the last commit to a folder."""
    store, root = opened(path.rstrip("/"))
    with store.open_input_stream(f"{root}/{COUNTS}") as f:
        return json.loads(f.read())
