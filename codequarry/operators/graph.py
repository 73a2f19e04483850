"""The file / class / method graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codequarry.plans.skew import latest


def node_key(path: str | Column, name: str | Column) -> Column:
    return F.concat_ws("::", path, name)


def nodes_last_wins(snips: DataFrame) -> DataFrame:
    """One node per key: the declaration latest in the file replaces the earlier ones.

    Grouping by path and name keeps to the placement by path.
    """
    kept = latest(snips, ["path", "name"], F.col("start"), [F.col("kind").alias("type"), "content", "start"])
    return kept.select(node_key("path", "name").alias("node_id"), "type", "content", "path", "start")


def nodes(files: DataFrame, snips: DataFrame) -> DataFrame:
    """File nodes and declaration nodes; ``path`` and ``start`` order neighbours."""
    file_nodes = files.filter(F.length("content") > 0).select(
        F.col("path").alias("node_id"), F.lit("file").alias("type"), "content",
        "path", F.lit(-1).alias("start"),
    )
    return file_nodes.unionByName(nodes_last_wins(snips))


def edges(snips: DataFrame) -> DataFrame:
    """Containment edges, each once, smaller key first."""
    key = node_key("path", "name")
    return snips.select("path", "name").dropDuplicates().select(
        F.least("path", key).alias("src"), F.greatest("path", key).alias("dst")
    )


def graph_counts(node_table: DataFrame, edge_table: DataFrame) -> DataFrame:
    """One row: number of nodes and number of edges."""
    parts = node_table.select(F.lit(1).alias("n"), F.lit(0).alias("e")).unionByName(
        edge_table.select(F.lit(0).alias("n"), F.lit(1).alias("e"))
    )
    return parts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("nodes"), F.coalesce(F.sum("e"), F.lit(0)).alias("edges")
    )


def node_neighbours(edge_table: DataFrame) -> DataFrame:
    """Every edge seen from both ends: ``node_id, neighbour``."""
    return edge_table.select(F.col("src").alias("node_id"), F.col("dst").alias("neighbour")).union(
        edge_table.select("dst", "src")
    )


def graph_context(best: DataFrame, node_table: DataFrame, edge_table: DataFrame) -> DataFrame:
    """Per query the best node (rank 0), then its neighbours in source order.

    ``best`` holds ``query_id, node_id``, one row per query.
    """
    around = best.join(node_neighbours(edge_table), "node_id").select(
        "query_id", F.col("neighbour").alias("node_id"), F.lit(1).alias("hop")
    )
    wanted = best.select("query_id", "node_id", F.lit(0).alias("hop")).unionByName(around)
    order = W.partitionBy("query_id").orderBy("hop", "path", "start", "node_id")
    return wanted.join(node_table, "node_id").select(
        "query_id", (F.row_number().over(order) - 1).alias("rank"), "node_id", "type", "content"
    )
