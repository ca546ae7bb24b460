"""Point lookups and listings over the chunks table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import type_order

METADATA = ("file_path", "name", "chunk_type", "language")


def by_name(chunks: DataFrame, name: str) -> DataFrame:
    """The first chunk of a name, in file order."""
    return chunks.filter(F.col("name") == name).orderBy("file_path", "line_start").limit(1)


def by_directory(chunks: DataFrame, directory: str, cap: int = 50) -> DataFrame:
    """Chunks below a directory at any depth, in file order; the cap is the operator's own."""
    return chunks.filter(F.col("file_path").startswith(directory.rstrip("/") + "/")).orderBy("file_path", "line_start").limit(cap)


def by_file(chunks: DataFrame, file_path: str) -> DataFrame:
    """Chunks of a file: classes, methods, functions, others, each by line."""
    return chunks.filter(F.col("file_path") == file_path).orderBy(type_order(F.col("chunk_type")), "line_start")


def metadata(chunks: DataFrame) -> DataFrame:
    return chunks.select(*METADATA)


def with_calls(chunks: DataFrame) -> DataFrame:
    return chunks.select("name", "calls")


def callers_of(callers: DataFrame, name: str) -> DataFrame:
    return callers.filter(F.col("callee") == name).orderBy("caller")


def file_hashes(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("file_path").agg(F.min("file_hash").alias("file_hash"))


def staleness(stored: DataFrame, live: DataFrame) -> DataFrame:
    """file_path, stale of each live file: its hash differs from the stored one, or there is none."""
    a = stored.select("file_path", F.col("file_hash").alias("_stored"))
    both = live.join(a, "file_path", "left")
    return both.select("file_path", F.coalesce(F.col("_stored") != F.col("file_hash"), F.lit(True)).alias("stale"))


def calls_from_json(column: str = "calls_json"):
    """Called names out of JSON text; anything that isn't a list of strings is an empty list."""
    return F.coalesce(F.from_json(F.col(column), "array<string>"), F.array().cast("array<string>"))
