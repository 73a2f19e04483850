"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Largest table, in rows, that an operator broadcasts after counting it.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(column: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null ids fall in part 0."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % parts, F.lit(0))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores as it takes to clash with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a table for broadcast when it has at most ``limit`` rows; else a shuffle join follows.

    Counts the table, so hand in a written or otherwise cheap one.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches in slices, so that Python objects exist for a part of a batch only."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def map_batches(
    df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str, finish: Callable[[], None] | None = None, rows: int = 1000
) -> DataFrame:
    """Apply ``fn`` to slices of Arrow batches, of ``rows`` rows, as plain columns; ``finish`` ends each task.

    The batches are bounded by ``spark.sql.execution.arrow.maxBytesPerBatch``; columns that
    ``fn`` leaves out of its result are dropped.
    """
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    names = arrow.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows):
            got = fn({n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)})
            arrays = [pa.array(got[n], type=arrow.field(n).type) for n in names]
            yield pa.RecordBatch.from_arrays(arrays, names=names)
        if finish is not None:
            finish()

    return df.mapInArrow(run, schema)
