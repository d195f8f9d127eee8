"""Events without a user: they are an instrument of their own, as in SQL."""

import os

import duckdb
import pytest
from check_oracle import compare, connect

from strataline.operators.signals import join_label


@pytest.fixture(scope="module")
def nameless(sf, tmp_path_factory):
    folder = tmp_path_factory.mktemp("nameless")
    for f in os.listdir(sf):
        if f != "events.parquet":
            os.symlink(f"{sf}/{f}", folder / f)
    duckdb.connect().execute(f"""COPY (SELECT * REPLACE (CASE WHEN user_id % 9 > 0 THEN user_id END AS user_id) FROM '{sf}/events.parquet' ORDER BY event_id)
        TO '{folder}/events.parquet' (FORMAT parquet)""")
    return str(folder)


@pytest.mark.parametrize("name", ["score_label_join", "drop_missing_label"])
def test_rows_without_a_user_stay(spark, nameless, name):
    ok, note = compare(spark, connect(nameless), name, nameless)
    assert ok, note


@pytest.mark.parametrize("how,rows", [("inner", 2), ("left", 3), ("full", 4)])
def test_join_label_keeps_keys(spark, how, rows):
    pred = spark.createDataFrame([("a", 1, 0.1), (None, 1, 0.2), ("b", None, 0.3)], "instrument string, datetime int, score double")
    label = spark.createDataFrame([("a", 1, 1.0), (None, 1, 2.0), ("c", 1, 3.0)], "instrument string, datetime int, label double")
    out = join_label(pred, label, how)
    assert out.columns == ["instrument", "datetime", "score", "label"]
    got = {tuple(r) for r in out.collect()}
    assert len(got) == rows and (None, 1, 0.2, 2.0) in got
    assert how != "full" or ("c", 1, None, 3.0) in got
