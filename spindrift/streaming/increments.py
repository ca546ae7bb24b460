"""Streaming counterparts: files that arrive in micro-batches, and savings over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.snapshots import Snapshots, upserted


def latest(batch: DataFrame, key: str = "file_path", order: str = "version") -> DataFrame:
    """The last version of each key in a batch."""
    return batch.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))).filter("_n = 1").drop("_n")


def upsert_stream(files: DataFrame, store: Snapshots, table: str, schema, checkpoint: str):
    """A query that keeps the last version of each file: what is older than the stored one is left out.

    files: file_path, version, and the table's other columns.  A batch that runs twice changes nothing the second
    time, so the sink is exactly-once; there is no state to bound and so no watermark.
    """

    def apply(batch: DataFrame, _: int) -> None:
        with store.lock():
            stored = store.table(table, schema)
            newest = latest(batch.unionByName(stored.join(batch.select("file_path").distinct(), "file_path", "left_semi").select(*batch.columns)))
            store.commit(**{table: upserted(stored, newest, newest)})

    return files.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def savings_by_window(events: DataFrame, length: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """window_start, saved, queries of a stream of (queried_at, saved); entries later than `late` are dropped with the state they need."""
    per = events.withWatermark("queried_at", late).groupBy(F.window("queried_at", length).alias("w"))
    return per.agg(F.sum("saved").alias("saved"), F.count("*").alias("queries")).select(F.col("w.start").alias("window_start"), "saved", "queries")
