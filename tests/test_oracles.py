"""Every query of the library against its SQL in DuckDB, on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from gridloom.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def rows(columns, data):
    return sorted((tuple(repr(plain(x)) for x in r) for r in data))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    found = duck.sql(catalog.ORACLES[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert rows(columns, [[r[c] for c in columns] for r in df.collect()]) == rows(columns, [[r[k] for k in at] for r in found.fetchall()])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, DIR).count() > 0


def test_entry(spark):
    import __spark_entry__ as E

    assert E.entry(spark).count() == 11
    assert set(E.oracle_sql()) <= set(E.queries())
