"""Connected components of a link table, by joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.sources.storage import written


def _hang(edges: DataFrame, larger: bool) -> DataFrame:
    """Hang the neighbours of each node on the smallest among them and itself.

    ``larger``: only the neighbours above the node move (both directions of an edge count);
    else the node's smaller neighbours and the node itself do.
    """
    both = edges.unionByName(edges.select(F.col("high").alias("low"), F.col("low").alias("high"))) if larger else edges
    node, other = ("low", "high") if larger else ("high", "low")
    least = both.groupBy(F.col(node).alias("node")).agg(F.min(other).alias("least"))
    least = least.select("node", F.least("node", "least").alias("least"))
    moved = both.select(F.col(node).alias("node"), F.col(other).alias("other")).join(least.hint("merge"), "node")
    if larger:
        pairs = moved.filter(F.col("other") > F.col("node")).select("other", "least")
    else:
        pairs = moved.select("other", "least").unionByName(least.select(F.col("node").alias("other"), "least"))
    return pairs.filter(F.col("other") != F.col("least")).select(F.col("least").alias("low"), F.col("other").alias("high")).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (smallest node of its component) for every node of ``links`` (x, y).

    Alternates the two star operations until each component is one star around its smallest
    node; every round is written, so a lost executor costs one round at most. Rounds grow with
    the logarithm of the longest path. No row holds more than one link.
    """
    edges = links.select(F.least("x", "y").alias("low"), F.greatest("x", "y").alias("high")).filter("low != high").distinct()
    edges = written(edges, "links")
    while True:
        edges = written(_hang(_hang(edges, True), False), "links")
        # settled when every node hangs on one node that itself hangs on nothing
        hangs = edges.select(F.col("high").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
        holds = edges.select(F.col("low").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
        seen = hangs.unionByName(holds).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if seen.filter("up > 1 OR (up = 1 AND down = 1)").isEmpty():
            break
    stars = edges.select(F.col("high").alias("node"), F.col("low").alias("component"))
    roots = edges.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct()
    return stars.unionByName(roots)
