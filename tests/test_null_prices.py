"""Prices of events without a user: no row is lost when they are adjusted or rebased."""

import os

import duckdb
import pytest
from check_oracle import compare, connect


@pytest.fixture(scope="module")
def nameless(sf, tmp_path_factory):
    folder = tmp_path_factory.mktemp("nameless")
    for f in os.listdir(sf):
        if f != "events.parquet":
            os.symlink(f"{sf}/{f}", folder / f)
    duckdb.connect().execute(f"""COPY (SELECT * REPLACE (CASE WHEN user_id % 9 > 0 THEN user_id END AS user_id) FROM '{sf}/events.parquet' ORDER BY event_id)
        TO '{folder}/events.parquet' (FORMAT parquet)""")
    return str(folder)


@pytest.mark.parametrize("name", ["adjust_prices", "rebase_first_close"])
def test_rows_without_a_user_stay(spark, nameless, name):
    ok, note = compare(spark, connect(nameless), name, nameless)
    assert ok, note
