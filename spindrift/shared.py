"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .errors import StoreError


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of this machine, which only a local session may use."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise StoreError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spindrift-shared-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


_written: list[tuple[SparkSession, str]] = []
_kept: dict[tuple[str, str, str], object] = {}


def kept(spark: SparkSession, name: str, folder: str, make: Callable[[], object]) -> object:
    """What make() gives, made once for a session and a folder of tables: an index that many queries read."""
    key = (spark.sparkContext.applicationId, name, folder)
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def own_folder(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, cleared with what written() leaves."""
    path = f"{shared_folder(spark)}/spindrift-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def drop_written() -> None:
    """Delete every table that written() has left; for when no result reads them any more."""
    _kept.clear()
    while _written:
        spark, path = _written.pop()
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the session is gone already; the folder's owner clears it
            return


atexit.register(drop_written)


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """Cut the lineage: write df as a Parquet table in the shared folder and read it back.

    The files survive lost executors, and unlike checkpoint() they are columnar and compressed.
    """
    spark = df.sparkSession
    path = own_folder(spark, "table")
    df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
