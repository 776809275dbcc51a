"""Documents as a source that builds only the columns asked for.

    spark.dataSource.register(PageSource)
    spark.read.format("statement_pages").option("decoder", "package.module:function").schema("doc_id string, page_no int, text string").load(folder)

The decoder takes a file's bytes and gives (text, tables) of page after page; as an iterator it is asked for no more pages
than are needed, and tables may be a function without arguments that makes them. The schema names the columns wanted, any of
doc_id, page_no, text and cells: without cells no tables are made. With the schema doc_id, has_text the source tells whether
a file has min_chars characters of text, and decodes no page after the one that reaches them. A file that cannot be decoded
is one row with page_no 0 and the reason as text (has_text null).

Partitions are whole files, of about partition_bytes together. Files are listed and read by pyarrow; for a store that only
Spark reaches use files.documents(), which gives the same rows.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from quillframe.sources.stores import listed, opened

PAGES = "doc_id string, page_no int, text string, cells array<struct<table_no:int,row_no:int,col_no:int,value:string>>"
Decoder = Callable[[bytes], object]


def decoded(name: str, content: bytes, decoder: Decoder, with_cells: bool = True) -> Iterator[tuple]:
    """(doc_id, page_no, text, cells) of each page, cells being null if they are not wanted; a page_no of 0 carries the reason why the file, as a whole or after its first pages, cannot be read."""
    first, rows = 0, []
    try:
        for n, (text, tables) in enumerate(decoder(content), 1):
            cells = None
            if with_cells:
                tables = (tables() if callable(tables) else tables) or []
                cells = [(first + t, r, c, v) for t, table in enumerate(tables) for r, row in enumerate(table) for c, v in enumerate(row)]
                first += len(tables)
            rows.append((name, n, text or "", cells))
    except Exception as e:  # noqa: BLE001
        rows = [(name, 0, f"{type(e).__name__}: {e}", [])]
    yield from rows


def enough_text(content: bytes, decoder: Decoder, min_chars: int) -> bool | None:
    """Whether the stripped texts of the first pages have so many characters together; null if the file cannot be read so far."""
    total = 0
    try:
        for text, _ in decoder(content):
            total += len((text or "").strip())
            if total >= min_chars:
                return True
    except Exception:  # noqa: BLE001
        return None
    return total >= min_chars


def named(decoder: str) -> Decoder:
    """The function that module:function names."""
    module, _, function = decoder.partition(":")
    return getattr(importlib.import_module(module), function)


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "statement_pages"

    def schema(self) -> str:
        return PAGES

    def reader(self, schema: StructType) -> PageReader:
        return PageReader(dict(self.options), schema.fieldNames())


class PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str], columns: list[str]):
        known = ["doc_id", "page_no", "text", "cells"] if "has_text" not in columns else ["doc_id", "has_text"]
        if set(columns) - set(known):
            raise ValueError(f"the source has the columns {', '.join(known)}")
        self.path, self.columns, self.at = options["path"], columns, [known.index(c) for c in columns]
        self.decoder, self.min_chars = options["decoder"], int(options.get("min_chars", 20))
        self.suffixes = tuple(s.strip().lower() for s in options.get("suffixes", ".pdf").split(","))
        self.partition_bytes = int(options.get("partition_bytes", 64 << 20))

    def partitions(self) -> list[Files]:
        out, held = [], self.partition_bytes
        for f in listed(self.path, self.suffixes):
            if held + f.size > self.partition_bytes:
                out.append(Files([]))
                held = 0
            out[-1].value.append(f.path)
            held += f.size
        return out

    def read(self, partition: Files) -> Iterator[tuple]:
        if partition is None:  # there are no files
            return
        store, _ = opened(self.path)
        decoder = named(self.decoder)
        prefix = "file:" if store.type_name == "local" else f"{self.path.partition('://')[0]}://"
        for path in partition.value:
            with store.open_input_stream(path) as f:
                content = f.read()
            name = prefix + path
            rows = [(name, enough_text(content, decoder, self.min_chars))] if "has_text" in self.columns else decoded(name, content, decoder, "cells" in self.columns)
            for row in rows:
                yield tuple(row[i] for i in self.at)
