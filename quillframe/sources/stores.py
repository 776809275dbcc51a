"""Paths of any store that pyarrow reaches, for sources and sinks that work on whole files."""

from __future__ import annotations

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it) of a path or URI as Spark writes them: file:/a, file:///a, /a, hdfs://..., s3://..."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def listed(path: str, suffixes: tuple[str, ...]) -> list[fs.FileInfo]:
    """The files below a folder, or the file itself, with one of the suffixes (lower case; any if there are none), by path."""
    store, root = opened(path)
    info = store.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
    kept = (f for f in found if f.type == fs.FileType.File and (not suffixes or f.base_name.lower().endswith(suffixes)) and not any(p.startswith((".", "_")) for p in f.path[len(root) :].split("/")))
    return sorted(kept, key=lambda f: f.path)
