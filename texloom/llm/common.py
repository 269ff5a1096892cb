"""Helpers of the training-data operators."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def latest(df: DataFrame, key: str, at: str = "loaded_at") -> DataFrame:
    """One row per ``key``: the one loaded last. Rows without a key are dropped.

    A hash aggregate with map-side combining, so that a key with many rows costs no sort.
    """
    rest = [c for c in df.columns if c != key]
    kept = (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.max_by(F.struct(*rest), F.coalesce(F.col(at), F.lit("1970-01-01").cast("timestamp"))).alias("_kept"))
    )
    return kept.select(key, *[F.col("_kept")[c].alias(c) for c in rest])


def clean_name(c: Column) -> Column:
    """A source's or dataset's name as it should have been spelled: lower case, joined by ``_``."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s\-]+", "_")


def arrow_map(df: DataFrame, schema: T.StructType | str, fn: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """``mapInArrow`` with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield fn(b)

    return df.mapInArrow(run, schema)
