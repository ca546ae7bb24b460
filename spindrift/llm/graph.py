"""Connected components of an edge table, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: A node with more edges than HUB, and than the SHAREth part of all, is a hub: its edges are dealt to several tasks. There are under SHARE hubs.
HUB, SHARE = 200, 1000


def _hubs(degrees: DataFrame, total: int) -> DataFrame:
    """(u, parts) for those of the (u, n) nodes and their numbers of edges that are too many for one task."""
    most = max(HUB, total // SHARE)
    return degrees.filter(F.col("n") > most).select("u", F.ceil(F.col("n") / most).cast("int").alias("parts"))


def _dealt(least: DataFrame, hubs: DataFrame) -> DataFrame:
    """(u, part, m): a row a node, and one for each part of a hub."""
    return least.select("u", "m").join(F.broadcast(hubs), "u", "left").select("u", "m", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))


def _with(edges: DataFrame, least: DataFrame, hubs: DataFrame, how: str = "inner") -> DataFrame:
    """Edges with m, the least node that their u hangs on; a hub's are dealt by their other end."""
    part = F.pmod(F.xxhash64("v"), F.coalesce("parts", F.lit(1))).cast("int")
    return edges.join(F.broadcast(hubs), "u", "left").select("u", "v", part.alias("part")).join(_dealt(least, hubs), ["u", "part"], how)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of (a, b) edges that aren't the smallest of theirs; component is the smallest node reachable.

    Alternating large-star and small-star steps: every node hangs its larger, then its smaller
    neighbours on the smallest one, until all hang on one that hangs on none.  Each step aggregates by key before it
    joins, and every round is a table in the shared folder.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v")
    now = written(pairs.distinct())
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lower = F.sum((F.col("v") < F.col("u")).cast("long")).alias("lower")
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"), lower))
        total, loose = least.agg(F.sum("n"), F.count(F.when(F.expr("lower > 0 and n > 1"), 1))).first()
        if not loose:
            return least.filter("m < u").select(F.col("u").alias("node"), F.col("m").alias("component"))
        hubs = _hubs(least, total)
        large = _with(both, least, hubs).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.distinct())
        # a node has no more edges here than before, so the hubs are among the same
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = _with(large, least, hubs).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        now = written(hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct())


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels, as components() gives them, after more links (a, b): what it gives for all edges, in rounds over the tied components alone."""
    of = lambda x: labels.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}"))
    tied = links.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left")
    # ends are smallest nodes of components, which labels don't list
    moved = components(tied.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")))
    rows = labels.select(F.col("component").alias("u"), F.col("node").alias("v"))
    hubs = _hubs(rows.groupBy("u").agg(F.count("*").alias("n")), rows.count())
    placed = _with(rows, moved.select(F.col("node").alias("u"), F.col("component").alias("m")), hubs, "left")
    return written(placed.select(F.col("v").alias("node"), F.coalesce("m", "u").alias("component")).unionByName(moved))
