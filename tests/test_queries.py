"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tessera import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set TimeZone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and v != v):
        return ""
    return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def canonical(df):
    cols = sorted(df.columns)
    return cols, df[cols].map(plain).sort_values(cols).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_sql(spark, duck, name):
    (a_cols, a), (b_cols, b) = canonical(catalogue.QUERIES[name](spark, SF).toPandas()), canonical(duck.sql(catalogue.ORACLES[name]).df())
    assert a_cols == b_cols and a.equals(b)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_other_queries_run(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_the_entry_works(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
