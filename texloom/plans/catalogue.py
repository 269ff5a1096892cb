"""The catalogue of registered queries and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import classify_queries, corpus_queries, source_queries, stream_queries, text_queries, vector_queries

MODULES = (text_queries, corpus_queries, vector_queries, classify_queries, source_queries, stream_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for m in MODULES for q in m.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
