"""Mixing sources to target weights by iterative proportional fitting, with DataFrame functions alone.

Documents fall into cells of (source, language, topic).  Token weights of the cells are
raked in turn to the target marginals of each dimension until all hold, and documents
are sampled by probabilities calibrated so that the expected tokens meet a budget.
Documents are aggregated to cells before anything else moves, so one source with a third of all
rows costs no more than any other; all later steps but the last join work on cells.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

DIMENSIONS = ("source", "lang", "topic")
#: Rakings over all dimensions in one table, and the deviation of a marginal that ends them.
SWEEPS, TOLERANCE = 4, 1e-6
#: Tables in a row that lower the least deviation by less than this part of it: it has stopped falling.
IDLE, FALL = 3, 1e-3

log = logging.getLogger(__name__)


def topic(text: Column) -> Column:
    """A coarse topic by marks in the whole text."""
    return (
        F.when(F.contains(text, F.lit(" | ")), "table")
        .when(F.lower(text).rlike("licen[sc]e|all rights reserved|copyright"), "legal")
        .when(F.contains(text, F.lit("@")) | text.rlike(r"\+[0-9]"), "contact")
        .when(text.rlike("[0-9]"), "figures")
        .when(F.contains(text, F.lit("!!")) | F.contains(text, F.lit("###")), "noise")
        .otherwise("prose")
    )


def weighed(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the dimensions and n_tokens (runs of non-blanks) of each row; null text counts as empty, null source or lang as their own value ''."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *keep,
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"mix_{c}") for c in ("source", "lang")),
        topic(text).alias("mix_topic"),
        F.regexp_count(text, F.lit(r"\S+")).cast("long").alias("mix_tokens"),
    )


def _targets(cells: DataFrame, targets: dict[str, dict[str, float] | None], alpha: float) -> DataFrame:
    """t_<dimension>: the target share of each cell's value; a stated map (values absent from it get 0), or the share to the power alpha."""
    for d in DIMENSIONS:
        by = Window.partitionBy(f"mix_{d}")
        share = F.sum("w0").over(by)
        stated = targets.get(d)
        if stated:
            total = sum(stated.values())
            raw = F.element_at(F.create_map(*[F.lit(x) for k, v in stated.items() for x in (k, v / total)]), F.col(f"mix_{d}"))
            raw = F.coalesce(raw, F.lit(0.0))
        else:
            raw = F.pow(share, F.lit(alpha))
        cells = cells.withColumn("_raw", raw).withColumn("_own", F.sum("w0").over(by))
        # a value's raw target, spread over its cells by weight, sums over cells to the sum over values
        cells = cells.withColumn(f"t_{d}", F.col("_raw")).withColumn(f"_s_{d}", F.col("_raw") * F.col("w0") / F.col("_own")).drop("_raw", "_own")
    cells = written(cells)
    totals = cells.agg(*(F.sum(f"_s_{d}") for d in DIMENSIONS)).first()
    return cells.withColumns({f"t_{d}": F.col(f"t_{d}") / F.lit(t) for d, t in zip(DIMENSIONS, totals, strict=True)}).drop(*(f"_s_{d}" for d in DIMENSIONS))


def rake(docs: DataFrame, targets: dict[str, dict[str, float] | None] | None = None, alpha: float = 0.7) -> DataFrame:
    """Cells with w0 (share of tokens), w (raked share) and t_<dimension>; cells without tokens have no part.

    Sweeps go on until every marginal is within TOLERANCE of its target.  Where targets can't all hold (a value occurs in
    too few cells), they end once the largest deviation has stopped falling, with the last
    dimension exact; that deviation stands in the column off, and is logged as a warning.
    """
    cells = docs.groupBy(*(f"mix_{d}" for d in DIMENSIONS)).agg(F.sum("mix_tokens").cast("double").alias("n")).filter("n > 0")
    cells = written(cells)
    total = cells.agg(F.sum("n")).first()[0]
    cells = _targets(cells.withColumn("w0", F.col("n") / F.lit(total)), targets or {}, alpha).withColumn("w", F.col("w0"))
    least, idle, sweeps = float("inf"), 0, 0
    while True:
        for _ in range(SWEEPS):
            for d in DIMENSIONS:
                now = F.sum("w").over(Window.partitionBy(f"mix_{d}"))
                cells = cells.withColumn("w", F.when(now > 0, F.col("w") * F.col(f"t_{d}") / now).otherwise(0.0))
        off = [F.abs(F.sum("w").over(Window.partitionBy(f"mix_{d}")) - F.col(f"t_{d}")) for d in DIMENSIONS]
        cells = written(cells.withColumn("off", F.greatest(*off)))
        left = cells.agg(F.max("off")).first()[0] or 0.0
        cells, sweeps = cells.withColumn("off", F.lit(float(left))), sweeps + SWEEPS
        if left < TOLERANCE:
            log.info("raked in %d sweeps to a deviation of %.3g", sweeps, left)
            return cells
        idle = 0 if left < least * (1 - FALL) else idle + 1
        least = min(least, left)
        if idle == IDLE:
            log.warning("the targets can't all hold: a share is still %.3g off its target after %d sweeps", left, sweeps)
            return cells


def calibrated(cells: DataFrame, rate: float) -> DataFrame:
    """Cells with f = w / w0 and probability p = min(1, c * f), c such that the expected tokens are rate of all.

    c rises from the rate: what cells at 1 can't take goes to the others, until no more cells reach 1.  Each step adds up
    the cells once.
    """
    cells = cells.withColumn("f", F.col("w") / F.col("w0"))
    c, over = float(rate), F.col("f") * F.lit(float(rate)) >= 1.0
    while True:
        capped, left = cells.agg(F.sum(F.when(over, F.col("w0")).otherwise(0.0)), F.sum(F.when(~over, F.col("w")).otherwise(0.0))).first()
        if capped is None or left <= 1e-12:  # no cells, or all with any weight at 1
            c = 1e300
            break
        higher = (rate - capped) / left
        if higher <= c * (1 + 1e-12):
            break
        c, over = higher, F.col("f") * F.lit(higher) >= 1.0
    return cells.withColumn("p", F.least(F.lit(1.0), F.col("f") * F.lit(c)))


def unit(seed: int) -> Column:
    """A number in [0, 1) from the document's id: the same on every run and in every layout."""
    return F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(seed)), 11) / F.lit(float(1 << 53))


def mix(
    docs: DataFrame, *keep: str, rate: float = 0.5, alpha: float = 0.7, targets: dict[str, dict[str, float] | None] | None = None, seed: int = 17
) -> DataFrame:
    """Each row of docs with its cell, weight (raked over own share), probability, kept, and how far the targets are missed at most.

    rate is the part of all tokens to keep in expectation; alpha flattens shares where no target is stated.
    Columns named in keep follow as they are.  Documents without tokens are kept with probability rate, rows without a doc_id share one draw; repeated rows share
    their draw; an empty table gives an empty result.
    """
    # texts are read once: what cells are made of is what is drawn from
    documents = written(weighed(docs, *keep))
    cells = calibrated(rake(documents, targets, alpha), rate)
    keys = [f"mix_{d}" for d in DIMENSIONS]
    # cells are few: Spark sends them to every task if their measured size allows, and else splits what is skewed
    joined = documents.join(cells.select(*keys, "f", "p", "off"), keys, "left")
    p = F.coalesce(F.col("p"), F.lit(float(rate)))
    return joined.select(
        "doc_id",
        *keep,
        *(F.col(f"mix_{d}") for d in DIMENSIONS),
        F.col("mix_tokens"),
        F.coalesce(F.col("f"), F.lit(1.0)).alias("mix_weight"),
        p.alias("mix_probability"),
        (unit(seed) < p).alias("mix_kept"),
        F.col("off").alias("mix_deviation"),
    )
