"""Explicit placement of rows before work that expands them."""

from __future__ import annotations

from pyspark.sql import DataFrame


def place(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by ``keys`` into ``spark.sql.shuffle.partitions`` partitions.

    The count is given on purpose: texts are small on the wire and grow many times over
    once split into words or pieces, so coalescing by shuffled bytes would leave too few
    tasks. Size the setting for the input, about 64 MB of text per partition.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
