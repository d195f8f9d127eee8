"""Prices of zero, and sums whose last bit decides: the queries give what their SQL gives."""

import os

import duckdb
import pytest
from check_oracle import compare, connect
from pyspark.sql import functions as F

from strataline.sources.panels import bars_from_ticks


@pytest.fixture(scope="module")
def zeros(sf, tmp_path_factory):
    """The tables with many events of value zero, all of one user's first days among them."""
    folder = tmp_path_factory.mktemp("zeros")
    for f in os.listdir(sf):
        if f != "events.parquet":
            os.symlink(f"{sf}/{f}", folder / f)
    duckdb.connect().execute(f"""COPY (SELECT * REPLACE (CASE WHEN event_id % 11 IN (0, 3) OR (user_id = 7 AND ts < TIMESTAMP '2024-01-06') THEN 0.0 ELSE value END AS value)
        FROM '{sf}/events.parquet' ORDER BY event_id) TO '{folder}/events.parquet' (FORMAT parquet)""")
    return str(folder)


@pytest.mark.parametrize("name", ["align_blank_change", "compare_panels", "drop_missing_label", "score_label_join", "five_minute_bars", "rebase_first_close",
                                  "linear_model_scores", "ridge_scores", "processor_views", "section_norm"])
def test_prices_of_zero(spark, zeros, name):
    ok, note = compare(spark, connect(zeros), name, zeros)
    assert ok, note


def test_volumes_in_order_do_not_depend_on_partitions(spark):
    values = [0.1, 0.7, 1e16, 3.3, -1e16, 0.2, 0.3]
    ticks = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "instrument string, i int, value double")
    ticks = ticks.withColumn("datetime", F.expr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, i)"))
    want = 0.0
    for v in values:
        want += v
    for parts in (1, 3, 7):
        rows = ticks.repartition(parts, F.col("i") % 4).orderBy(F.col("i").desc())
        assert bars_from_ticks(rows, "day", in_order=True).first()["volume"] == want
