"""Row windows in arrays give what sliding frames give, in one pass over a panel and without a further exchange."""

import datetime as dt
import io
from contextlib import redirect_stdout

import numpy as np
from pyspark.sql import functions as F

from strataline.plans import featuresets as FS
from strataline.plans.evaluate import Panel, features


def test_arrays_equal_frames(spark):
    rng = np.random.default_rng(3)
    rows = []
    for name, n in (("a", 150), ("b", 3), ("c", 1), ("flat", 40)):
        for k in range(n):
            p = [None if rng.random() < 0.1 else 5.0 if name == "flat" else float(rng.integers(1, 60)) / 4 for _ in range(6)]
            rows.append((name, dt.datetime(2024, 1, 1) + dt.timedelta(days=k), *p))
    df = spark.createDataFrame(rows, "instrument string, datetime timestamp_ntz, open double, high double, low double, close double, volume double, vwap double").repartition(3)
    e = FS.factors158(windows=(5, 60))
    fast, plain = features(Panel(df, False, arrays=True), e), features(Panel(df, False), e)
    text = io.StringIO()
    with redirect_stdout(text):
        fast.explain()
    assert text.getvalue().count("FlatMapGroupsInArrow") == 1 and text.getvalue().count("Exchange hashpartitioning(instrument") == 1
    key = F.col("instrument"), F.col("datetime")
    got, want = fast.orderBy(*key).collect(), plain.orderBy(*key).collect()
    assert len(got) == len(want) == len(rows)
    for g, w in zip(got, want):
        for k in e:
            x, y = g[k], w[k]
            assert (x is None) == (y is None) and (x is None or np.isclose(x, y, rtol=1e-8, atol=1e-9)), (g.instrument, g.datetime, k, x, y)
