"""Differences, counts, coverage and savings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

AUDIT_KEYS = ("file_path", "name")


def reindex_diff(stored: DataFrame, live: DataFrame) -> DataFrame:
    """file_path, state: new, modified, deleted or unchanged, by content hash."""
    a = stored.select("file_path", F.col("file_hash").alias("_old"))
    b = live.select("file_path", F.col("file_hash").alias("_new"))
    state = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "deleted").when(F.col("_old") == F.col("_new"), "unchanged").otherwise("modified")
    return a.join(b, "file_path", "full_outer").select("file_path", state.alias("state"))


def audit(semantic: DataFrame, exact: DataFrame) -> DataFrame:
    """qid, file_path, name, category: found by both searches, or by one alone."""
    sides = semantic.select("qid", *AUDIT_KEYS, F.lit(1).alias("s"), F.lit(0).alias("e")).unionByName(exact.select("qid", *AUDIT_KEYS, F.lit(0).alias("s"), F.lit(1).alias("e")))
    both = sides.groupBy("qid", *AUDIT_KEYS).agg(F.max("s").alias("s"), F.max("e").alias("e"))
    category = F.when((F.col("s") == 1) & (F.col("e") == 1), "both").when(F.col("s") == 1, "semantic_only").otherwise("exact_only")
    return both.select("qid", *AUDIT_KEYS, category.alias("category"))


def inspect_global(chunks: DataFrame) -> DataFrame:
    """language (null: all), chunks, files."""
    return chunks.groupingSets([[], ["language"]], "language").agg(F.count("*").alias("chunks"), F.countDistinct("file_path").alias("files"), F.grouping("language").alias("is_total"))


def languages(files: DataFrame) -> DataFrame:
    return files.groupBy("language").agg(F.count("*").alias("files"))


def savings(results: DataFrame, files: DataFrame) -> DataFrame:
    """qid, without, with_engine, saved, reduction_pct: tokens of whole files against tokens of the results.

    results: qid, file_path, payload (what is sent for it, as JSON text); files: file_path, size_bytes.  A token is four
    bytes or characters; a list of results adds its brackets and separators.
    """
    whole = results.select("qid", "file_path").distinct().join(files.select("file_path", "size_bytes"), "file_path", "left")
    whole = whole.groupBy("qid").agg(F.sum(F.ceil(F.coalesce("size_bytes", F.lit(0)) / F.lit(4.0)).cast("long")).alias("without"))
    sent = results.groupBy("qid").agg(F.ceil((F.sum(F.length("payload")) + 2 * F.count("*")) / F.lit(4.0)).cast("long").alias("with_engine"))
    saved = F.greatest(F.lit(0).cast("long"), F.col("without") - F.col("with_engine"))
    pct = F.when(F.col("without") > 0, F.round(saved / F.col("without") * 100, 1)).otherwise(F.lit(0.0))
    return whole.join(sent, "qid").select("qid", "without", "with_engine", saved.alias("saved"), pct.alias("reduction_pct"))


def cumulative(log: DataFrame) -> DataFrame:
    """total_saved, total_queries, last_updated of a query log; zeros and null for an empty one."""
    return log.agg(F.coalesce(F.sum("saved"), F.lit(0)).alias("total_saved"), F.count("*").alias("total_queries"), F.max("queried_at").alias("last_updated"))


def running(log: DataFrame, order: list) -> DataFrame:
    """The log with what had been saved and asked up to each entry, a user's entries apart."""
    w = Window.partitionBy("user_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumn("saved_so_far", F.sum("saved").over(w)).withColumn("queries_so_far", F.count("*").over(w))


def coverage(results: DataFrame, chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """qid, languages_indexed, languages_found, missing (sorted, comma-joined), ratio, mean_score, confidence, suggest.

    results: qid, language, score; queries: qid, query.  confidence is high from four fifths of the languages with a mean
    above 0.7, partial from half of them or a mean from 0.5 to 0.7, else low.
    """
    indexed = chunks.filter("language <> ''").agg(F.array_sort(F.collect_set("language")).alias("indexed"))
    found = results.groupBy("qid").agg(F.array_sort(F.collect_set(F.when(F.col("language") != "", F.col("language")))).alias("found"), F.avg("score").alias("mean"))
    # one row of a few language names
    both = queries.select("qid", "query").join(found, "qid", "left").join(F.broadcast(indexed))
    got = F.coalesce("found", F.array().cast("array<string>"))
    ratio = F.when(F.size("indexed") > 0, F.size(F.array_intersect(got, "indexed")) / F.size("indexed")).otherwise(0.0)
    mean = F.coalesce("mean", F.lit(0.0))
    level = F.when((ratio >= 0.8) & (mean > 0.7), "high").when((ratio >= 0.5) | mean.between(0.5, 0.7), "partial").otherwise("low")
    return both.select(
        "qid",
        F.array_join("indexed", ",").alias("languages_indexed"),
        F.array_join(got, ",").alias("languages_found"),
        F.array_join(F.array_sort(F.array_except("indexed", got)), ",").alias("missing"),
        F.round(ratio, 4).alias("ratio"),
        F.round(mean, 4).alias("mean_score"),
        level.alias("confidence"),
        ((level != "high") & (F.size(F.split(F.trim("query"), r"\s+")) > 1)).alias("suggest"),
    )
