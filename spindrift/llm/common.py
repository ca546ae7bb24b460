"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..shared import drop_written, shared_folder, written
from ..sources.tables import load

__all__ = ["REMEMBERED", "WordMemory", "drop_written", "held_out", "let_go", "load", "map_texts", "shared_folder", "slices", "written"]

#: Words that a worker remembers, at most, unless told otherwise: some 100 MB.
REMEMBERED = 500_000
#: Rows of an Arrow batch, on its way to a worker and back, unless the session sets another number.
BATCH = 1000
#: Bytes of text, about, that a worker takes at a time; as words they take ten times as much.
SLICE = 2_000_000
#: Marks of words that came before (one byte each, shared by words of equal hash).
MARKS = 1 << 22


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int]:
    """malloc_trim of the C library, or nothing where it has none."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return lambda pad: 0


def let_go() -> None:
    """Give memory that is free back to the system: a worker lives on beside its executor's heap when its task is done."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH rows in this session: the usual 10,000 texts are held by the JVM, outside its heap, and by the worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if name not in spark.conf.getAll:
        spark.conf.set(name, BATCH)


class WordMemory(dict):
    """Values of words over batches, within bounds: a word stays from the second batch on that holds it.

    Most distinct words of a corpus come once; they live in `fresh` for their batch and leave only a mark.
    """

    def __init__(self, limit: int = REMEMBERED) -> None:
        super().__init__()
        self.limit = limit
        self.fresh: dict = {}
        self.marks = bytearray(MARKS)

    def __missing__(self, word):
        return self.fresh[word]

    def begin(self) -> None:
        """Before a batch: let go of what came once, and of the older half when full (what is frequent comes back at once)."""
        self.fresh = {}
        if len(self) > self.limit:
            for word in list(self)[: len(self) // 2]:
                del self[word]

    def learn(self, words: set, values: Callable[[list], list]) -> None:
        """Make sure that every word has a value until the next begin()."""
        new = list(words.difference(self))
        marks = self.marks
        for word, value in zip(new, values(new), strict=True):
            at = hash(word) & (MARKS - 1)
            if marks[at]:
                self[word] = value
            else:
                marks[at] = 1
                self.fresh[word] = value


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fifth of the documents whose labels no model may see."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def map_texts(
    docs: DataFrame,
    make: Callable[[], Callable[[list, list[str]], dict[str, object]]],
    schema: StructType | str,
    *keep: str,
    most: int = SLICE,
) -> DataFrame:
    """Run a batch function over (doc_id, whole text) of docs; null texts arrive as "".

    make() runs once in each task and returns the batch function; that gets the
    ids and texts of a batch and returns columns.  Columns named in keep follow as
    they are when the function returns them under their own name.  A batch has about `most` bytes.
    """
    frame = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *keep)
    spark = docs.sparkSession
    small_batches(spark)
    fields = schema if isinstance(schema, StructType) else spark.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(fields)

    def run(batches):
        work = make()
        for part in portions(batches, most):
            ids = part.column(0).to_pylist()
            texts = [t or "" for t in part.column(1).to_pylist()]
            rest = [part.column(i).to_pylist() for i in range(2, part.num_columns)]
            out = work(ids, texts, *rest)
            yield pa.RecordBatch.from_arrays(
                [v if isinstance(v := out[f.name], pa.Array) else pa.array(v, f.type) for f in arrow], schema=arrow
            )
            # the worker lives on with other tasks: what this batch took goes back
            del part, ids, texts, rest, out, v
            let_go()

    return frame.mapInArrow(run, fields)


def slices(batch: pa.RecordBatch, most: int = SLICE):
    """Parts of a batch of about `most` bytes each (one row at least)."""
    rows = max(1, min(batch.num_rows, int(batch.num_rows * most / max(1, batch.nbytes))))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def portions(batches, most: int = SLICE):
    """Batches joined and cut to about `most` bytes each (one row at least): memory follows bytes and not rows."""
    held, size = [], 0
    for batch in batches:
        for part in slices(batch, most):
            if held and size + part.nbytes > most:
                yield pa.concat_batches(held)
                held, size = [], 0
            if part.num_rows:
                held.append(part)
                size += part.nbytes
    if held:
        yield pa.concat_batches(held)
