"""No caps on history, one answer in both plan forms, no jobs while a query is built."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from strataline.operators import pit as PT
from strataline.operators import portfolio as PF
from strataline.plans import expr as E
from strataline.plans.evaluate import Panel, features


def series(spark, values, step="1s"):
    pdf = pd.DataFrame({"instrument": "a", "datetime": pd.date_range("2024-01-01", periods=len(values), freq=step), "v": values})
    return spark.createDataFrame(pdf).withColumn("datetime", F.col("datetime").cast("timestamp_ntz"))


def test_long_ema(spark):
    x = np.random.default_rng(1).normal(100, 5, 70_000)
    got = features(Panel(series(spark, x)), {"e": E.ema(E.field("v"), 5000)}).orderBy("datetime").toPandas()["e"]
    np.testing.assert_allclose(got, pd.Series(x).ewm(span=5000).mean(), rtol=1e-9)


def test_all_periods(spark):
    facts = spark.createDataFrame([("a", f"{1990 + i // 12}-{i % 12 + 1:02d}-01", i, 1.0) for i in range(440)], "instrument string, date string, period int, value double")
    facts = facts.withColumn("date", F.to_date("date"))
    last = PT.evaluate_at_publications(facts, E.sum_(E.field("value"), 0), quarterly=False).agg(F.max("value")).first()[0]
    assert last == 440.0


@pytest.mark.parametrize("make", [
    lambda v: E.sum_(E.sum_(E.sum_(E.sum_(v, "20s"), "20s"), "20s"), "20s"),
    lambda v: E.ema(E.mean(v, "15s"), 30),
    lambda v: E.corr(v, E.ref(v, 3), 40),
    lambda v: E.mean(v, 150),
    lambda v: E.day_cumsum(v, 0, 3),
    lambda v: E.day_last(v),
    lambda v: E.std(v, 37) + E.kurt(v, 50),
    lambda v: E.slope(v, 130),
    lambda v: E.resi(v, 20) + E.rsquare(v, 300),
], ids=["nested spans", "ema", "corr", "long window", "day sum", "day last", "std", "slope", "line"])
def test_forms_agree(spark, make, monkeypatch):
    monkeypatch.setattr(E, "LADDER", 10)
    df = series(spark, np.random.default_rng(2).normal(0, 1, 600), "3s")
    e = {"x": make(E.field("v"))}
    plain = features(Panel(df, blocked=False), e).orderBy("datetime").toPandas()["x"]
    spark.conf.set("strataline.maxRowsPerTask", "60")
    try:
        blocked = features(Panel(df, blocked=True), e).orderBy("datetime").toPandas()["x"]
    finally:
        spark.conf.unset("strataline.maxRowsPerTask")
    pd.testing.assert_series_equal(blocked, plain, rtol=1e-9)


@pytest.mark.parametrize("n", [10, 13, 64, 77, 250, 700])
def test_merged_moments(spark, n, monkeypatch):
    """Windows made of parts against whole windows, with missing values, a flat stretch and a far level."""
    monkeypatch.setattr(E, "LADDER", 10)
    rng = np.random.default_rng(n)
    x, y = 1e6 + rng.normal(0, 1, 1500).cumsum(), rng.normal(0, 1, 1500)
    x[rng.random(1500) < 0.1] = np.nan
    x[900:1000], y[rng.random(1500) < 0.05] = 1e6, np.nan
    df = series(spark, x).withColumnRenamed("v", "x").join(series(spark, y).select("datetime", F.col("v").alias("y")), "datetime")
    df = df.select("instrument", "datetime", *[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in "xy"])
    a, b = E.field("x"), E.field("y")
    got = features(Panel(df), {"std": E.std(a, n), "skew": E.skew(b, n), "kurt": E.kurt(b, n), "cov": E.cov(a, b, n), "slope": E.slope(a, n),
                               "rsq": E.rsquare(a, n), "resi": E.resi(a, n)}).orderBy("datetime").toPandas()
    sx, sy = pd.Series(x), pd.Series(y)
    roll = lambda s: s.rolling(n, min_periods=1)
    np.testing.assert_allclose(got["std"], roll(sx).std(), rtol=1e-6, atol=2e-4)     # the other side drifts after a level of 1e6
    np.testing.assert_allclose(got["skew"].iloc[3:], roll(sy).skew().iloc[3:], rtol=1e-7, atol=1e-9)
    np.testing.assert_allclose(got["kurt"].iloc[8:], roll(sy).kurt().iloc[8:], rtol=1e-7, atol=1e-9)
    for i in (5, 40, 300, 899, 950, 1200, 1499):
        w, v = x[max(0, i - n + 1):i + 1], y[max(0, i - n + 1):i + 1]
        t, ok, both = np.arange(len(w)), ~np.isnan(w), ~np.isnan(w) & ~np.isnan(v)
        if both.sum() > 1:
            assert got["cov"][i] == pytest.approx(np.cov(w[both], v[both])[0, 1], rel=1e-7, abs=1e-7)
        if ok.sum() > 2:
            k, c = np.polyfit(t[ok], w[ok] - 1e6, 1)
            assert got["slope"][i] == pytest.approx(k, rel=1e-6, abs=1e-8)
            if ok[-1]:
                assert got["resi"][i] == pytest.approx(w[-1] - 1e6 - (k * t[-1] + c), rel=1e-6, abs=1e-6)
            if w[ok].std(ddof=1) > 1e-3:
                assert got["rsq"][i] == pytest.approx(np.corrcoef(t[ok], w[ok])[0, 1] ** 2, rel=1e-6, abs=1e-9)


def test_infinite_start(spark):
    df = series(spark, [1.0, 2.0, 3.0, 4.0]).withColumn("v", F.when(F.col("v") == 1, F.lit(float("inf"))).otherwise(F.col("v")))
    got = [r.x for r in features(Panel(df), {"x": E.var(E.field("v"), 0)}).collect()]
    assert all(v is None for v in got)


def test_total_loss(spark):
    out = PF.risk_analysis(series(spark, [0.1, -1.0, 0.2, 0.1], "1D").withColumnRenamed("v", "ret"), mode="product").first()
    assert out["mean"] == -1 and out["annualized_return"] == -1 and out["std"] is None and out["max_drawdown"] == -1


@pytest.mark.parametrize("name", ["turnover", "signal_report", "brinson", "section_norm", "factors14_daily_suppliers"])
def test_no_jobs_while_building(spark, sf, name):
    sc = spark.sparkContext
    entry.queries()[name](spark, sf)   # tables are known from here on
    sc.setJobGroup("build", name)
    try:
        entry.queries()[name](spark, sf)
        jobs = sc.statusTracker().getJobIdsForGroup("build")
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    names = {sc.statusTracker().getStageInfo(i).name for j in jobs for i in sc.statusTracker().getJobInfo(j).stageIds}
    assert all(n.startswith("parquet at") for n in names)   # the schemas of the tables, and nothing else
