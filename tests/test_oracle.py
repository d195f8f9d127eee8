"""Every registered query with SQL gives the rows DuckDB gives."""

import pytest

import __spark_entry__ as entry
from check_oracle import compare, connect

WITH_SQL = sorted(entry.oracle_sql())
NO_SQL = sorted(set(entry.queries()) - set(WITH_SQL))


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", WITH_SQL)
def test_matches_sql(spark, con, sf, name):
    ok, note = compare(spark, con, name, sf)
    assert ok, note


@pytest.mark.parametrize("name", NO_SQL)
def test_runs(spark, sf, name):
    assert entry.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["instrument", "datetime", "close", "rel_ma", "back_ret"]
