"""Arrow functions over batches of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def map_batches(df: DataFrame, schema: T.StructType | str, fn: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """``mapInArrow`` with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield fn(b)

    return df.mapInArrow(run, schema)


def keep_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], list[bool]]) -> DataFrame:
    """The rows for which ``fn`` says so."""
    return map_batches(df, df.schema, lambda b: b.filter(pa.array(fn(b), pa.bool_())))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A matrix from a column of lists of equal length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64, copy=False)


def lists(m: np.ndarray) -> pa.ListArray:
    """A column of lists from a matrix."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(np.ascontiguousarray(m).ravel()))
