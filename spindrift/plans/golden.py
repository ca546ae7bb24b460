"""Retrieval quality of an engine over a golden set of queries.

A golden set is YAML or a dict: queries with id, category, difficulty, query, expected_results (file, name, relevance 0
to 3) and coverage_dirs.  All queries of a method run as one batch.
"""

from __future__ import annotations

import json
import time
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..operators import evaluation
from ..shared import written
from .engine import Engine

METHODS = ("semantic", "exact", "hybrid")
METRICS = ("precision", "recall", "f1", "mrr", "ndcg", "coverage", "ter")
DIFFICULTIES = ("easy", "medium", "hard")


def load_golden(source: str | Path | dict) -> dict:
    """A golden set, checked; ConfigError names the first fault."""
    if not isinstance(source, dict):
        import yaml

        source = yaml.safe_load(Path(source).read_text())
    if not isinstance(source, dict) or not isinstance(source.get("queries"), list):
        raise ConfigError("a golden set has a list of queries")
    seen = set()
    for q in source["queries"]:
        lacking = [k for k in ("id", "category", "query", "difficulty", "expected_results") if k not in q]
        if lacking:
            raise ConfigError(f"query {q.get('id')}: {', '.join(lacking)} is missing")
        if q["difficulty"] not in DIFFICULTIES or q["id"] in seen:
            raise ConfigError(f"query {q['id']}: unknown difficulty or repeated id")
        if any(r.get("relevance") not in (0, 1, 2, 3) or "file" not in r or "name" not in r for r in q["expected_results"]):
            raise ConfigError(f"query {q['id']}: a result needs a file, a name and a relevance from 0 to 3")
        seen.add(q["id"])
    return source


def run_golden(engine: Engine, golden: dict, k: int = 10, methods: tuple[str, ...] = METHODS) -> tuple[DataFrame, DataFrame, dict[str, float]]:
    """(measures of each query and method, report by grouping sets, mean milliseconds a query of each method)."""
    spark, queries = engine.spark, golden["queries"]
    asked = spark.createDataFrame([(i, q["id"], q["category"], q["difficulty"]) for i, q in enumerate(queries)], "qid long, id string, category string, difficulty string")
    item = lambda file, name: F.concat_ws("#", file, name)
    expected = spark.createDataFrame([(i, r["file"], r["name"], r["relevance"]) for i, q in enumerate(queries) for r in q["expected_results"]], "qid long, file string, name string, grade int")
    expected = expected.groupBy("qid", item(F.col("file"), F.col("name")).alias("item")).agg(F.max("grade").alias("grade"))
    required = spark.createDataFrame([(i, d) for i, q in enumerate(queries) for d in q.get("coverage_dirs") or ()], "qid long, directory string")
    found, took = None, {}
    for method in methods:
        began = time.time()
        part = written(getattr(engine, f"search_{method}")([q["query"] for q in queries], top_k=k).select("qid", F.lit(method).alias("method"), "rank", "file_path", "name", "score"))
        took[method] = round(1000 * (time.time() - began) / max(1, len(queries)), 2)
        found = part if found is None else found.unionByName(part)
    base = evaluation.measures(found.select("qid", "method", "rank", item(F.col("file_path"), F.col("name")).alias("item")), expected, k)
    sent = found.groupBy("qid", "method").agg(F.sum(F.length(F.to_json(F.struct("file_path", "name", "score")))).alias("characters"))
    each = base.join(evaluation.directory_coverage(found, required), ["qid", "method"]).join(evaluation.token_efficiency(base, sent), ["qid", "method"])
    each = written(each.join(asked, "qid"))
    report = evaluation.report(each.drop("category", "difficulty"), asked)
    return each, report, took


def by_metric(each: DataFrame) -> DataFrame:
    """method, metric, value: means over queries, as the gates read them."""
    means = each.groupBy("method").agg(*[F.round(F.avg(m) + 1e-9, 4).alias(m) for m in METRICS])
    return means.unpivot("method", list(METRICS), "metric", "value")


def save_baseline(each: DataFrame, folder: str | Path, stamp: str) -> Path:
    """Write the means as latest.json; what was there before goes to archive/ under its own stamp."""
    folder = Path(folder)
    (folder / "archive").mkdir(parents=True, exist_ok=True)
    latest = folder / "latest.json"
    if latest.exists():
        old = json.loads(latest.read_text())
        latest.rename(folder / "archive" / f"{old['stamp']}.json")
    values: dict[str, dict[str, float]] = {}
    for r in by_metric(each).collect():
        values.setdefault(r["method"], {})[r["metric"]] = r["value"]
    latest.write_text(json.dumps({"stamp": stamp, "methods": values}, indent=1, sort_keys=True))
    return latest


def load_baseline(spark, folder: str | Path) -> DataFrame:
    """method, metric, value of latest.json; empty where there is none."""
    latest = Path(folder) / "latest.json"
    rows = [(m, k, v) for m, own in json.loads(latest.read_text())["methods"].items() for k, v in own.items()] if latest.exists() else []
    return spark.createDataFrame(rows, "method string, metric string, value double")
