"""From files to chunks, as a DataFrame operator."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

from ..schema import CHUNKS
from .braces import parse_dart, parse_script
from .common import MAX_LINES
from .python import parse as parse_python


def parse(path: str, source: str | None, language: str, limit: int = MAX_LINES) -> list[dict]:
    """Chunks of one file; blank files and unknown languages have none."""
    if not source or not source.strip():
        return []
    if language == "python":
        return parse_python(path, source, limit)
    if language == "dart":
        return parse_dart(path, source, limit)
    return parse_script(path, source, language, limit) if language in ("typescript", "javascript") else []


def chunk_files(files: DataFrame, limit: int = MAX_LINES) -> DataFrame:
    """Chunks of (file_path, content, file_hash, language) rows; no shuffle, each file on its own."""
    names = [f.name for f in CHUNKS.fields]

    def run(batches):
        for pdf in batches:
            rows = []
            for f in pdf.itertuples(index=False):
                rows += [c | {"file_hash": f.file_hash} for c in parse(f.file_path, f.content, f.language or "", limit)]
            yield pd.DataFrame(rows, columns=names)

    return files.select("file_path", "content", "file_hash", "language").mapInPandas(run, CHUNKS)
