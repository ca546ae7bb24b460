"""The engine's inputs derived from a folder of plain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import directory_of, filled_lines, normalized_name, terms


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks: source is the directory, the language the extension, the first term the name."""
    d = load(spark, sf_dir, "documents")
    kind = F.when(F.col("n_chars") > 4000, "class").when(F.col("n_chars") > 1000, "function").otherwise("method")
    df = d.select(
        F.col("doc_id").alias("chunk_id"),
        F.concat_ws("", "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang").alias("file_path"),
        F.coalesce("lang", F.lit("")).alias("language"),
        F.coalesce(F.try_element_at(terms(F.col("text")), F.lit(1)), F.lit("")).alias("name"),
        kind.alias("chunk_type"),
        F.lit(1).alias("line_start"),
        F.col("text").alias("content"),
        filled_lines(F.col("text")).alias("filled"),
        F.octet_length("text").cast("long").alias("size_bytes"),
    )
    return df.withColumn("dir", directory_of(F.col("file_path"))).withColumn("norm", normalized_name(F.col("name")))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id, caller, at, callee: every term of a document behind the first, which is its name; each once, at its first place."""
    found = terms(F.col("text"))
    d = load(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_id"),
        F.coalesce(F.try_element_at(found, F.lit(1)), F.lit("")).alias("caller"),
        F.array_distinct(F.slice(found, F.lit(2), F.size(found))).alias("some"),
    )
    return d.select("chunk_id", "caller", F.posexplode("some").alias("at", "callee"))


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
