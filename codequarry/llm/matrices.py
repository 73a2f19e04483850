"""Sums of small matrices over all tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def columns_of(batch: pa.RecordBatch, name: str, width: int, kind: type = np.int64) -> np.ndarray:
    """A list column whose lists all have ``width`` entries, as a matrix."""
    flat = batch.column(batch.schema.get_field_index(name)).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(batch.num_rows, width)


def summed(df: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray], rows: int, columns: int) -> np.ndarray:
    """Sum of ``part(batch)``, a matrix of ``rows`` x ``columns`` doubles, over all batches of ``df``.

    Each task adds up its own batches and hands on one matrix; Spark adds the tasks' matrices row
    by row. Only the sum comes to the driver. No rows: zeros.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                total = part(batch) if total is None else total + part(batch)
        if total is not None:
            values = pa.ListArray.from_arrays(np.arange(0, rows * columns + 1, columns, dtype=np.int32), np.ascontiguousarray(total, dtype=np.float64).ravel())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(rows, dtype=np.int32)), values], names=["row", "value"])

    sums = [F.sum(F.col("value")[j]).alias(f"c{j}") for j in range(columns)]
    got = df.mapInArrow(run, "row int, value array<double>").groupBy("row").agg(*sums).toArrow()
    result = np.zeros((rows, columns))
    if got.num_rows:
        result[got.column("row").to_numpy()] = np.stack([got.column(f"c{j}").to_numpy() for j in range(columns)], axis=1)
    return result
