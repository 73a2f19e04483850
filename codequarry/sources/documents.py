"""Tables of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def read_documents(
    spark: SparkSession, folder: str, name: str = "documents", key: str = "doc_id"
) -> DataFrame:
    """``doc_id, text`` of a stored table; only these two columns are read."""
    return read_table(spark, folder, name).select(F.col(key).alias("doc_id"), "text")
