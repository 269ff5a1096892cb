"""Every query with an SQL equivalent, on the smallest tables."""

import importlib
import math

import duckdb
import pytest

from texloom.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings combined_pairs sent_pairs doc_vectors model_confs batch_confs mix_targets".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_sql(spark, sf, con, name):
    df = catalogue.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    rows = con.execute(catalogue.oracle_sql()[name])
    names = [x[0] for x in rows.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rows.fetchall()), key=str)


def test_every_query_has_rows_or_sql(spark, sf):
    for name in sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())):
        assert catalogue.queries()[name](spark, sf).count() > 0, name


def test_entry(spark):
    entry = importlib.import_module("__spark_entry__")
    df = entry.entry(spark)
    assert set(df.columns) == {"k", "queries", "rec", "map"} and df.count() == 4
    assert set(entry.oracle_sql()) <= set(entry.queries())
