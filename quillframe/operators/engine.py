"""The seam for models: an engine turns images and a template into completions. Models themselves are not part of this library."""

from __future__ import annotations

import math
import struct
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pandas as pd
from pyspark import Accumulator
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quillframe.operators import score, semistructured
from quillframe.sources import tables

# The template that completions follow.
TEMPLATE = '{"pharmacy": {"name": "verbatim-string", "id": "verbatim-string"}, "supplier": "verbatim-string", "report_date": "date-time", "products": [{"code_produit": "verbatim-string", "designation": "verbatim-string", "sales": [{"month": "date-time", "quantity": "integer"}]}]}'


class Engine(Protocol):
    """X1. An engine may also have extract_many(images, template), a completion or an exception for each of a batch of (image, size), size being what the image is to be scaled to, or None."""

    def extract(self, image: bytes, template: str) -> str: ...


class MissingDependency(RuntimeError):
    """Raised on the driver, before a job starts, with how to install what an engine needs."""


def require(module: str, hint: str) -> None:
    import importlib.util

    if importlib.util.find_spec(module) is None:
        raise MissingDependency(f"{module} is not installed; {hint}")


def device(wanted: str | None, accelerated: bool) -> str:
    """the device for an engine: the one asked for, else cuda if there is one, else cpu."""
    return wanted or ("cuda" if accelerated else "cpu")


#: Of a worker process: the engines that factories have made, so that a worker loads each once, however many tasks it runs.
_LOADED: dict[str, Engine] = {}


def image_size(content: bytes) -> tuple[int, int] | None:
    """(width, height) by the header of a PNG, JPEG or TIFF image, or None."""
    if content[:8] == b"\x89PNG\r\n\x1a\n" and len(content) >= 24:
        return struct.unpack(">II", content[16:24])
    if content[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(content) and content[at] == 0xFF:
            kind, length = content[at + 1], int.from_bytes(content[at + 2 : at + 4], "big")
            if kind == 0xFF:  # fill
                at += 1
            elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):  # a frame's header
                height, width = struct.unpack(">HH", content[at + 5 : at + 9])
                return width, height
            else:
                at += 2 + length
    if content[:4] in (b"II*\0", b"MM\0*"):
        order = "little" if content[:1] == b"I" else "big"
        number = lambda at, n: int.from_bytes(content[at : at + n], order)
        first, found = number(4, 4), {}
        for i in range(number(first, 2) if first + 2 <= len(content) else 0):
            at = first + 2 + 12 * i
            found[number(at, 2)] = number(at + 8, 2 if number(at + 2, 2) == 3 else 4)
        if 256 in found and 257 in found:
            return found[256], found[257]
    return None


def scaled(size: tuple[int, int] | None, max_pixels: int | None) -> tuple[int, int] | None:
    """F22 of one image: what it is to be scaled to, or None if it fits; as exprs.target_size()."""
    if size is None or not max_pixels or size[0] * size[1] <= max_pixels:
        return None
    scale = math.sqrt(max_pixels / (size[0] * size[1]))
    return max(1, int(size[0] * scale)), max(1, int(size[1] * scale))


def packed(images: Iterable[tuple[object, bytes]], max_pixels: int | None, budget: int) -> Iterator[list[tuple[object, bytes, tuple[int, int] | None]]]:
    """Batches of (key, content, size to scale to), in order, of at most budget pixels after scaling; an image beyond the budget, or of unknown size, makes a batch of its own."""
    batch, held = [], 0
    for key, content in images:
        size = image_size(content)
        to = scaled(size, max_pixels)
        pixels = budget if size is None else math.prod(to or size)
        if batch and held + pixels > budget:
            yield batch
            batch, held = [], 0
        batch.append((key, content, to))
        held += pixels
    if batch:
        yield batch


def _loaded(factory: Callable[[], Engine], name: str) -> Engine:
    if name not in _LOADED:
        _LOADED[name] = factory()
    return _LOADED[name]


def _answers(engine: Engine, batch: list, template: str) -> list[tuple[str | None, str | None]]:
    """(completion, reason) of each image of a batch. If a batch fails as a whole, its images are tried one by one."""
    many = getattr(engine, "extract_many", None)
    if many is not None:
        try:
            found = list(many([(c, to) for _, c, to in batch], template))
            if len(found) == len(batch):
                return [(None, f"{type(x).__name__}: {x}") if isinstance(x, Exception) else (x, None) for x in found]
        except Exception:  # noqa: BLE001, S110
            pass
    out = []
    for _, content, to in batch:
        try:
            found = many([(content, to)], template)[0] if many is not None else engine.extract(content, template)
            out.append((None, f"{type(found).__name__}: {found}") if isinstance(found, Exception) else (found, None))
        except Exception as e:  # noqa: BLE001
            out.append((None, f"{type(e).__name__}: {e}"))
    return out


def completions(
    images: DataFrame, factory: Callable[[], Engine], template: str = TEMPLATE, progress: Accumulator | None = None, max_pixels: int | None = None, budget: int = 16_000_000, profile: ResourceProfile | None = None, counts: Observation | None = None
) -> DataFrame:
    """(doc_id, completion, reason) of images(doc_id, content); reason tells why a completion is null, an engine's failure on one image being that image's alone.

    The factory runs once in a worker process, on its first batch. Images go to an engine with extract_many() in batches of at
    most budget pixels, each with the size to scale it to if it has more than max_pixels; batches change no result. profile:
    the resources of the tasks, such as a GPU each, where the cluster gives resources by stage. The result is not kept: write
    it once if several plans read it.

    X4: progress is an accumulator that counts images as they are begun, again in tasks that run again. counts is an
    Observation, which has images and failed once a plan of the result has been written: of the rows that were written, so
    each counts once whatever ran again.
    """
    name = uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            engine, out = _loaded(factory, name), []
            for batch in packed(zip(rows["doc_id"], map(bytes, rows["content"]), strict=True), max_pixels, budget):
                if progress is not None:
                    progress.add(len(batch))
                out += [(key, *answer) for (key, _, _), answer in zip(batch, _answers(engine, batch, template), strict=True)]
            yield pd.DataFrame(out, columns=["doc_id", "completion", "reason"])

    kind = dict(images.dtypes)["doc_id"]
    found = images.select("doc_id", "content").mapInPandas(run, f"doc_id {kind}, completion string, reason string", profile=profile)
    return found if counts is None else found.observe(counts, F.count(F.lit(1)).alias("images"), F.count("reason").alias("failed"))


def evaluate(images: DataFrame, factory: Callable[[], Engine], gold_lines: DataFrame, gold_cells: DataFrame | None = None) -> DataFrame:
    """Scores by document of an engine against gold: completions, their lines and cells, and the cell-level comparison. images has a row a doc_id; without gold_cells, gold_lines have their quantities by month in a map own."""
    raw = tables.once(completions(images, factory))
    parsed = raw.select("doc_id", semistructured.completion(raw["completion"]).alias("v"))
    return score.by_document(images.select("doc_id"), score.matched_cells(gold_lines, gold_cells, semistructured.completion_own(parsed), None))


def messages(demos: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """One row with the few-shot demonstrations of demos(no, image, output), in order, as chat messages: a user turn with image and template, then the answer. Demonstrations are the few of one prompt (dataset.demonstrations gives so many at most); they meet in one row."""
    turn = F.struct("no", F.array(F.struct(F.lit("user").alias("role"), F.col("image").alias("image"), F.lit(template).alias("text")), F.struct(F.lit("assistant").alias("role"), F.lit(None).cast("string").alias("image"), F.col("output").alias("text"))).alias("turns"))
    return demos.agg(F.flatten(F.transform(F.array_sort(F.collect_list(turn)), lambda t: t.turns)).alias("messages"))
