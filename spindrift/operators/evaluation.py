"""Retrieval quality of ranked results against graded expectations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens that an explorer without the engine is taken to read for a query.
EXPLORER_TOKENS = 5000
#: Grade from which a result is relevant.
RELEVANT = 2


def measures(results: DataFrame, expected: DataFrame, k: int = 10) -> DataFrame:
    """qid, method, precision, recall, f1, mrr, ndcg: one row for each query and method that returned something.

    results: qid, method, rank (from 1), item; expected: qid, item, grade.  Precision divides by what was returned
    within k; a relevant item counts as often as it is returned.
    """
    graded = results.join(expected, ["qid", "item"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    hit, top = F.col("grade") >= RELEVANT, F.col("rank") <= k
    gain = (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("rank") + 1.0)
    per = graded.groupBy("qid", "method").agg(
        F.sum(F.when(top, 1).otherwise(0)).alias("returned"),
        F.sum(F.when(top & hit, 1).otherwise(0)).alias("hits"),
        F.min(F.when(hit, F.col("rank"))).alias("first"),
        F.sum(F.when(top, gain).otherwise(0.0)).alias("dcg"),
    )
    by_grade = F.expr("row_number() over (partition by qid order by grade desc, item)")
    best = expected.withColumn("i", by_grade).groupBy("qid").agg(
        F.sum(F.when(F.col("grade") >= RELEVANT, 1).otherwise(0)).alias("relevant"),
        F.sum(F.when(F.col("i") <= k, (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("i") + 1.0)).otherwise(0.0)).alias("ideal"),
    )
    p = F.when(F.col("returned") > 0, F.col("hits") / F.col("returned")).otherwise(0.0)
    r = F.when(F.col("relevant") > 0, F.col("hits") / F.col("relevant")).otherwise(0.0)
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return per.join(best, "qid").select(
        "qid",
        "method",
        F.round(p, 4).alias("precision"),
        F.round(r, 4).alias("recall"),
        F.round(f1, 4).alias("f1"),
        F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 4).alias("mrr"),
        F.round(F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0), 4).alias("ndcg"),
    )


def directory_coverage(results: DataFrame, required: DataFrame) -> DataFrame:
    """qid, method, coverage: share of the required directories whose name some result's path contains; 1 where none is required.

    results: qid, method, file_path; required: qid, directory.
    """
    asked = results.select("qid", "method").distinct()
    met = results.join(required, "qid").filter(F.contains("file_path", F.col("directory"))).groupBy("qid", "method").agg(F.countDistinct("directory").alias("met"))
    need = required.groupBy("qid").agg(F.countDistinct("directory").alias("need"))
    share = F.when(F.col("need").isNull(), 1.0).otherwise(F.round(F.coalesce("met", F.lit(0)) / F.col("need"), 4))
    return asked.join(need, "qid", "left").join(met, ["qid", "method"], "left").select("qid", "method", share.alias("coverage"))


def token_efficiency(quality: DataFrame, sent: DataFrame) -> DataFrame:
    """qid, method, ter: f1 for each part of the explorer's tokens that was sent.  sent: qid, method, characters."""
    tokens = F.greatest(F.lit(1), F.floor(F.col("characters") / 4))
    return quality.join(sent, ["qid", "method"]).select("qid", "method", F.round(F.col("f1") / (tokens / F.lit(float(EXPLORER_TOKENS))), 4).alias("ter"))


def report(quality: DataFrame, queries: DataFrame) -> DataFrame:
    """Mean measures by method, by category and method, and by difficulty and method, in one pass; halves of the last digit go up."""
    names = [c for c in ("precision", "recall", "f1", "mrr", "ndcg") if c in quality.columns]
    df = quality.join(queries.select("qid", "category", "difficulty"), "qid")
    sets = [["method"], ["category", "method"], ["difficulty", "method"]]
    return df.groupingSets(sets, "method", "category", "difficulty").agg(F.count("*").alias("queries"), *[F.round(F.avg(c) + 1e-9, 4).alias(c) for c in names])


def regressions(current: DataFrame, baseline: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """method, metric, value, base, drop, failed: relative drop of each metric below its baseline.  Both: method, metric, value."""
    both = current.join(baseline.select("method", "metric", F.col("value").alias("base")), ["method", "metric"])
    drop = F.when(F.col("base") > 0, (F.col("base") - F.col("value")) / F.col("base")).otherwise(0.0)
    return both.select("method", "metric", "value", "base", F.round(drop, 4).alias("drop"), (drop > tolerance).alias("failed"))


def meets_floors(current: DataFrame, f1: float = 0.5, precision: float = 0.7) -> DataFrame:
    """method, metric, value, passed against the release floors."""
    floor = F.when(F.col("metric") == "f1", f1).when(F.col("metric") == "precision", precision)
    return current.filter(floor.isNotNull()).select("method", "metric", "value", (F.col("value") >= floor).alias("passed"))
