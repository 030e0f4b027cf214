"""Every query with a SQL twin gives the same rows in both engines."""

import pytest
from harness import compare, duckdb_connection

import __spark_entry__ as entry_point
import catalogue


@pytest.fixture(scope="module")
def duck(folder):
    return duckdb_connection(folder)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_rows_as_sql(spark, folder, duck, name):
    difference = compare(catalogue.QUERIES[name](spark, folder), duck, catalogue.SQL[name])
    assert difference is None, difference


def test_every_sql_has_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.count() == 3
    assert df.columns == ["column", "count", "mean", "std", "min", "p25", "p50", "p75", "max"]
