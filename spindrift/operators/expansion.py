"""Results that others lead to: callees, callers, siblings, counterparts in other languages, tests.

results: qid, pos (order), chunk_id, file_path, dir, name, chunk_type, language, score.  Every operator
returns rows of the same kind with provenance, numbered by pos within the query, and leaves out
what the results already have.  chunks: chunk_id, file_path, dir, name, chunk_type, language, line_start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import stem_of

CALLEE, CALLER, SIBLING, LAYER, TEST = 0.8, 0.75, 0.7, 0.7, 0.6
GENERIC, CALLER_CAP, SIBLING_FILES, DIRECTORY_CHUNKS, PREFIX = 50, 10, 5, 50, 5
COLUMNS = ("chunk_id", "file_path", "dir", "name", "chunk_type", "language")


def first(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def first_by_name(chunks: DataFrame) -> DataFrame:
    return first(chunks.filter("name <> ''"), ["name"], ["file_path", "line_start", "chunk_id"])


def _capped(df: DataFrame, order: list, cap: int | None) -> DataFrame:
    df = df.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy(*order)))
    return df if cap is None else df.filter(F.col("pos") <= cap)


def via_calls(results: DataFrame, calls: DataFrame, chunks: DataFrame, top_k: int) -> DataFrame:
    """What the results call (calls: chunk_id, at, callee), at 0.8 of the caller's score; half of top_k at most, in order of caller and call."""
    named = results.join(calls, "chunk_id").select("qid", F.col("pos").alias("by"), "at", F.col("callee").alias("name"), F.col("score").alias("given"))
    fresh = named.filter("name <> ''").join(results.select("qid", "name").distinct(), ["qid", "name"], "left_anti")
    found = first(fresh, ["qid", "name"], ["by", "at"]).join(first_by_name(chunks).select(*COLUMNS), "name")
    out = _capped(found, ["by", "at", "name"], int(top_k * 0.5))
    return out.select("qid", "pos", *COLUMNS, F.round(F.col("given") * CALLEE, 6).alias("score"), F.lit(True).alias("expanded"))


def callers_index(calls: DataFrame, chunks: DataFrame) -> DataFrame:
    """callee, caller, count: how often chunks of a name call a name; unnamed ends are left out. Calls that carry their caller aren't joined."""
    named = calls if "caller" in calls.columns else calls.join(chunks.select("chunk_id", F.col("name").alias("caller")), "chunk_id")
    return named.filter("callee <> '' and caller <> ''").groupBy("callee", "caller").agg(F.count("*").alias("times"))


def via_callers(results: DataFrame, callers: DataFrame, chunks: DataFrame) -> DataFrame:
    """Who calls the results, at 0.75; names with 50 callers or more are too general; 10 at most."""
    # counted by an aggregate and for the results' names alone: a name that most chunks call is no partition of its own
    asked = callers.join(results.select(F.col("name").alias("callee")).distinct(), "callee", "left_semi")
    own = asked.join(asked.groupBy("callee").agg(F.sum("times").alias("_all")).filter(F.col("_all") < GENERIC), "callee", "left_semi").drop("times")
    named = results.join(own, results["name"] == own["callee"]).select("qid", F.col("pos").alias("by"), F.col("caller").alias("name"), F.col("score").alias("given"), F.col("callee").alias("caller_of"))
    fresh = named.join(results.select("qid", "name").distinct(), ["qid", "name"], "left_anti")
    found = first(fresh, ["qid", "name"], ["by", "name"]).join(first_by_name(chunks).select(*COLUMNS), "name")
    out = _capped(found, ["by", "name"], CALLER_CAP)
    return out.select("qid", "pos", *COLUMNS, F.round(F.col("given") * CALLER, 6).alias("score"), "caller_of")


def siblings(results: DataFrame, chunks: DataFrame, extension: str | None = None) -> DataFrame:
    """Files below directories with two results or more: one chunk a file, classes first, five files, at 0.7 of the best score.

    A directory holds what lies below it at any depth; its ancestors are derived from the chunk's path, so this is an
    equal join and no search over prefixes.
    """
    dirs = results.groupBy("qid", "dir").agg(F.count("*").alias("n"), F.max("score").alias("best")).filter("n >= 2 and dir <> '.'")
    parts = F.split("file_path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    below = chunks.filter(F.contains("file_path", F.lit("/"))) if extension is None else chunks.filter(F.contains("file_path", F.lit("/")) & F.col("file_path").endswith("." + extension.lstrip("*.")))
    below = below.select(*(c for c in COLUMNS if c != "dir"), "line_start", F.explode(above).alias("dir"))
    # a cap on a directory's chunks is a part of the operator: the first in file order
    below = below.join(dirs.select("dir").distinct(), "dir", "left_semi")
    below = below.withColumn("_n", F.row_number().over(Window.partitionBy("dir").orderBy("file_path", "line_start", "chunk_id"))).filter(F.col("_n") <= DIRECTORY_CHUNKS)
    near = dirs.join(below, "dir").join(results.select("qid", "file_path").distinct(), ["qid", "file_path"], "left_anti")
    is_class = F.when(F.col("chunk_type") == "class", 0).otherwise(1)
    # a file below two such directories counts for the deeper one
    one = first(near, ["qid", "file_path"], [is_class, F.length("dir").desc(), "line_start", "chunk_id"])
    best = results.groupBy("qid").agg(F.max("score").alias("_top"))
    out = _capped(one.join(best, "qid"), [is_class, "file_path"], SIBLING_FILES)
    return out.select("qid", "pos", *COLUMNS, F.round(F.col("_top") * SIBLING, 6).alias("score"), F.lit(True).alias("module_match"))


def cross_layer(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks of other languages whose normalised name (norm) equals a result's, or one is the beginning of the other from five letters on.

    Equal beginnings of five letters are the join key and the rest is a condition on the pair; names
    shorter than that meet by their whole.
    """
    head = lambda c: F.substring(c, 1, PREFIX)
    left = results.select("qid", F.col("pos").alias("by"), F.col("norm").alias("norm_a"), F.col("language").alias("lang_a"), F.col("score").alias("given"), head("norm").alias("head"))
    right = chunks.select(*COLUMNS, "norm", "line_start", head("norm").alias("head"))
    alike = (F.col("norm_a") == F.col("norm")) | (F.length("norm_a") >= PREFIX) & F.col("norm").startswith(F.col("norm_a")) | (F.length("norm") >= PREFIX) & F.col("norm_a").startswith(F.col("norm"))
    met = left.filter("norm_a <> ''").join(right.filter("norm <> ''"), "head").filter((F.col("lang_a") != F.col("language")) & alike)
    fresh = met.join(results.select("qid", "file_path", "name").distinct(), ["qid", "file_path", "name"], "left_anti")
    one = first(fresh, ["qid", "file_path", "name"], ["by", "line_start", "chunk_id"])
    out = _capped(one, ["by", "file_path", "name"], None)
    return out.select("qid", "pos", *COLUMNS, F.round(F.col("given") * LAYER, 6).alias("score"), F.lit(True).alias("cross_layer"))


def is_test_stem(stem: Column) -> Column:
    return stem.rlike(r"^test_|_test$|\.test$|\.spec$")


def test_files(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """One chunk of each test file of a result's file (x_test, test_x, x.test, x.spec), at 0.6."""
    stem = stem_of(F.col("file_path"))
    names = F.array(F.concat(stem, F.lit("_test")), F.concat(F.lit("test_"), stem), F.concat(stem, F.lit(".test")), F.concat(stem, F.lit(".spec")))
    asked = results.select("qid", F.col("pos").alias("by"), F.col("file_path").alias("test_for"), F.col("score").alias("given"), F.posexplode(names).alias("form", "stem"))
    tests = first(chunks.withColumn("stem", stem).filter(is_test_stem(F.col("stem"))), ["file_path"], ["line_start", "chunk_id"])
    met = asked.join(tests.select("stem", *COLUMNS), "stem").join(results.select("qid", "file_path").distinct(), ["qid", "file_path"], "left_anti")
    one = first(met, ["qid", "file_path"], ["by", "form"])
    out = _capped(one, ["by", "form", "file_path"], None)
    return out.select("qid", "pos", *COLUMNS, F.round(F.col("given") * TEST, 6).alias("score"), "test_for")


def appended(*stages: DataFrame) -> DataFrame:
    """Stages one after the other, pos numbered through; columns that a stage lacks are null."""
    out = None
    for n, df in enumerate(stages):
        df = df.withColumn("stage", F.lit(n))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy("stage", "pos", "chunk_id")))
