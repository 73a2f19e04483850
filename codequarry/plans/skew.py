"""Joins and rankings that hold when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key below this many rows is no burden for one task.
HOT_ROWS = 2_000_000
SALTS = 64


def salted_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    spread_by: Sequence[str],
    hot: DataFrame,
    how: str = "inner",
    salts: int = SALTS,
) -> DataFrame:
    """Join ``left`` to ``right`` (one row per key), spreading hot keys over ``salts`` tasks.

    ``hot`` lists the hot keys. It is broadcast: a key gets in only with ``HOT_ROWS`` rows
    or more, so 10^12 rows give at most 500,000 keys. Only hot rows of ``right`` are
    replicated; all others travel once. ``spread_by`` are ``left`` columns that differ
    between rows of the same key.
    """
    flag = F.broadcast(hot.select(F.col(key), F.lit(True).alias("_hot")))
    spread = F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")
    l = left.join(flag, key, "left").withColumn(
        "_salt", F.when(F.col("_hot"), spread).otherwise(F.lit(0))
    ).drop("_hot")
    r = right.join(flag, key, "left").withColumn(
        "_salt",
        F.explode(
            F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(
                F.array(F.lit(0))
            )
        ),
    ).drop("_hot")
    return l.join(r, [key, "_salt"], how).drop("_salt")


def hot_keys(df: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with at least ``hot_rows`` rows; counted with partial aggregation."""
    return df.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") >= hot_rows).select(key)


def latest(
    df: DataFrame, keys: Sequence[str], order: Column, columns: Sequence[str | Column]
) -> DataFrame:
    """Per key the row with the greatest ``order``, combined on the map side first."""
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*columns), order).alias("_row"))
        .select(*keys, "_row.*")
    )
