"""Every query against its SQL, on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from barwright.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if isinstance(v, pd.Timestamp):
        return str(v).removesuffix(" 00:00:00")
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return str([plain(x) for x in v])
    if hasattr(v, "item"):
        return plain(v.item())
    return v if isinstance(v, (bool, int)) else str(v)


def rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(v) for v in r) for r in df[names].itertuples(index=False)), key=str)


SQL = entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    names, got = rows(entry.queries()[name](spark, DIR).toPandas())
    wanted_names, wanted = rows(duck.execute(SQL[name]).df())
    assert names == wanted_names
    assert got == wanted


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert entry.queries()[name](spark, DIR).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
