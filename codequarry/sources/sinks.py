"""Diagrams and other rows as files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.sources.storage import located


def write_diagram(lines: DataFrame, path: str, group: str, order: Sequence[str]) -> None:
    """One folder per ``group`` value; its part files in name order are the text.

    Range partitioning on (group, order) keeps lines sorted across files and splits a
    large group over several tasks.
    """
    (
        lines.repartitionByRange(group, *order)
        .sortWithinPartitions(group, *order)
        .select(group, "line")
        .write.partitionBy(group)
        .text(path)
    )


def read_diagram(spark, path: str, group: str) -> DataFrame:
    """The lines back, with their group; the empty group has Spark's folder for missing values."""
    name = F.coalesce(F.col(group).cast("string"), F.lit(""))
    return spark.read.text(path).select(name.alias(group), F.col("value").alias("line"))


def write_files(rows: DataFrame, root: str) -> None:
    """Write ``name, bytes`` as one file per row below ``root``, by the tasks that hold them.

    A task that runs again writes the same files again.
    """
    base = root if "://" in root or root.startswith("file:") else f"file://{root}"

    def write(part) -> None:
        for row in part:
            system, path = located(f"{base}/{row['name']}")
            system.create_dir(path.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(path) as f:
                f.write(bytes(row["bytes"]))

    rows.foreachPartition(write)
