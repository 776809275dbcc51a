"""Decoders of test files: a JSON list of pages; each page that is decoded leaves a file in the folder that the bytes name."""

import json
import uuid
from pathlib import Path


def counting(content: bytes):
    told = json.loads(content)
    for text, tables in told["pages"]:
        (Path(told["seen"]) / f"page-{uuid.uuid4().hex}").touch()

        def build(tables=tables):
            (Path(told["seen"]) / f"table-{uuid.uuid4().hex}").touch()
            return tables

        yield text, build
