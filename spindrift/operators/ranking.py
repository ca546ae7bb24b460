"""Score adjustments and orders of ranked results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Scores of the semantic search are multiplied by these.
BOOST = {"class": 1.15, "function": 1.00, "method": 0.95}
#: Least score that a semantic search returns.
THRESHOLD = 0.45


def type_order(kind: Column) -> Column:
    return F.when(kind == "class", 0).when(kind == "method", 1).when(kind == "function", 2).otherwise(3)


def boosted(results: DataFrame) -> DataFrame:
    """score times the factor of the chunk's type, 4 digits."""
    factor = F.lit(1.0)
    for kind, value in BOOST.items():
        factor = F.when(F.col("chunk_type") == kind, value).otherwise(factor)
    # ties as in the SQL: what is rounded is the product's ten-thousandths
    return results.withColumn("score", F.round(F.col("score") * factor * 1e4, 0) / 1e4)


def rerank(results: DataFrame) -> DataFrame:
    """qid results in the order: short ones halved, neighbours in a directory lifted, two a file, best first.

    results: qid, pos, file_path, dir, filled (lines that aren't blank), score.  Adds rank; equal scores keep pos.
    """
    halved = F.when(F.col("filled") < 3, F.round(F.col("score") * 0.5, 6)).otherwise(F.col("score"))
    mates = F.count("*").over(Window.partitionBy("qid", "dir"))
    df = results.withColumn("score", halved).withColumn("score", F.when(mates >= 2, F.round(F.col("score") * 1.05, 6)).otherwise(F.col("score")))
    in_file = Window.partitionBy("qid", "file_path").orderBy(F.col("score").desc(), "pos")
    df = df.withColumn("_n", F.row_number().over(in_file)).filter("_n <= 2").drop("_n")
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "pos")))


def by_type(results: DataFrame) -> DataFrame:
    """Class, method, function, other; within a type as ranked before."""
    own = Window.partitionBy("qid").orderBy(type_order(F.col("chunk_type")), "rank")
    return results.withColumn("rank", F.row_number().over(own))
