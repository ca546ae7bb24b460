"""A repository's source files as a Spark data source.

Spark's own binary reader hides names that begin with _ or . and so would miss __init__.py;
this one lists the tree by the engine's rules and reads files in the tasks.
"""

from __future__ import annotations

import fnmatch
import hashlib
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.words import IGNORED, LANGUAGES

#: Files that one task reads.
FILES_A_TASK = 200
SCHEMA = "file_path string, language string, size_bytes long, file_hash string, content string"


def find_root(start: str | Path) -> Path:
    """The nearest folder upwards that holds .git, or start itself."""
    start = Path(start).resolve()
    return next((p for p in (start, *start.parents) if (p / ".git").exists()), start)


def patterns(root: Path, extra: tuple[str, ...] = ()) -> list[str]:
    """What a scan leaves out: the fixed names, extra ones, and the lines of the root's .gitignore (no negation, no anchors)."""
    own = root / ".gitignore"
    lines = own.read_text(errors="replace").splitlines() if own.exists() else []
    return [*IGNORED, *extra, *(x.rstrip("/") for x in map(str.strip, lines) if x and not x.startswith("#"))]


def ignored(relative: str, globs: list[str]) -> bool:
    """Whether the path, or any of its parts, matches a pattern."""
    return any(fnmatch.fnmatch(x, g) for g in globs for x in (relative, *relative.split("/")))


def language_of(name: str) -> str | None:
    return LANGUAGES.get(os.path.splitext(name)[1].lower())


def listing(root: str | Path, extra: tuple[str, ...] = ()) -> list[str]:
    """Relative paths of the supported files below root, sorted; ignored folders aren't entered."""
    root = Path(root).resolve()
    globs, found = patterns(root, extra), []
    for folder, below, names in os.walk(root):
        at = os.path.relpath(folder, root)
        at = "" if at == "." else at + "/"
        below[:] = [d for d in below if not ignored(at + d, globs)]
        found += [at + n for n in names if language_of(n) and not ignored(at + n, globs)]
    return sorted(found)


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, root: str, extra: tuple[str, ...]):
        self.root, self.extra = root, extra

    def partitions(self):
        found = listing(self.root, self.extra)
        return [_Files(found[at : at + FILES_A_TASK]) for at in range(0, len(found), FILES_A_TASK)] or [_Files([])]

    def read(self, partition):
        for path in partition.paths:
            data = (Path(self.root) / path).read_bytes()
            yield path, language_of(path), len(data), hashlib.sha256(data).hexdigest(), data.decode("utf-8", "replace")


class RepositorySource(DataSource):
    """spark.read.format("repository").option("extra_ignore", "a,b").load(root)"""

    @classmethod
    def name(cls) -> str:
        return "repository"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        extra = tuple(x for x in self.options.get("extra_ignore", "").split(",") if x)
        return _Reader(str(Path(self.options["path"]).resolve()), extra)


def read_repository(spark: SparkSession, root: str | Path, extra: tuple[str, ...] = ()) -> DataFrame:
    """file_path (relative), language, size_bytes, file_hash, content of a repository's source files."""
    spark.dataSource.register(RepositorySource)
    return spark.read.format("repository").option("extra_ignore", ",".join(extra)).load(str(root))
