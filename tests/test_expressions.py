"""Expressions against pandas, in the plain and in the blocked form."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strataline.plans import expr as E
from strataline.plans.evaluate import Panel, features

X, Y = E.field("x"), E.field("y")


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(0)
    parts = []
    for k, n in enumerate((300, 40, 3, 900)):
        x = np.round(rng.normal(10, 2, n).cumsum() * 0.1 + 50, 3)
        x[rng.random(n) < 0.1] = np.nan
        parts.append(pd.DataFrame({"instrument": f"i{k}", "datetime": pd.date_range("2024-01-01", periods=n, freq="7s"),
                                   "x": x, "y": np.round(rng.normal(0, 1, n), 3)}))
    return pd.concat(parts, ignore_index=True)


@pytest.fixture(scope="module")
def frame(spark, data):
    df = spark.createDataFrame(data)
    return df.select("instrument", F.col("datetime").cast("timestamp_ntz").alias("datetime"),
                     *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in "xy"]).cache()


def expressions():
    ex = {}
    for n in (0, 5, 20):
        for f in ("mean", "sum_", "std", "var", "skew", "kurt", "max_", "min_", "count", "med", "mad", "rank", "slope", "rsquare",
                  "resi", "idxmax", "idxmin", "wma"):
            ex[f"{f}{n}"] = getattr(E, f)(X, n)
        ex |= {f"corr{n}": E.corr(X, Y, n), f"cov{n}": E.cov(X, Y, n), f"ref{n}": E.ref(X, n), f"delta{n}": E.delta(X, n),
               f"ema{n}": E.ema(X, n), f"q{n}": E.quantile(X, n, 0.8)}
    return ex | {"lead": E.ref(X, -2), "ff": E.ffill(X), "bf": E.bfill(X), "sr": E.series_rank(X), "ema_na": E.ema(Y, 12, adjust=False),
                 "ema_p3": E.mean(X, 0.3), "t": E.sum_(X, "21s"), "nest": E.std(E.mean(E.delta(X, 1), 5), 10), "exp_nest": E.sum_(E.mean(X, 5), 0),
                 "long_mean": E.mean(X, 120), "long_max": E.max_(X, 120), "long_sum": E.sum_(Y, 150), "long_count": E.count(X, 150)}


def collect(df):
    return df.toPandas().sort_values(["instrument", "datetime"]).reset_index(drop=True)


@pytest.fixture(scope="module")
def plain(frame):
    return collect(features(Panel(frame, blocked=False), expressions()))


def test_blocked_form_gives_the_same_rows(spark, frame, plain):
    spark.conf.set("strataline.maxRowsPerTask", "200")
    try:
        blocked = collect(features(Panel(frame, blocked=True), expressions()))
    finally:
        spark.conf.unset("strataline.maxRowsPerTask")
    assert len(blocked) == len(plain)
    for c in expressions():
        np.testing.assert_allclose(plain[c].astype(float), blocked[c].astype(float), rtol=1e-8, atol=1e-8, err_msg=c)


def by_series(data, fn):
    return pd.concat([fn(g) for _, g in data.groupby("instrument")]).to_numpy(dtype=float)


def window(s, n):
    return s.expanding(1) if n == 0 else s.rolling(n, min_periods=1)


@pytest.mark.parametrize("n", [0, 5, 20])
def test_windows_match_pandas(data, plain, n):
    cases = {f"{f}{n}": (lambda g, m=m: getattr(window(g.x, n), m)()) for f, m in
             dict(mean="mean", sum_="sum", std="std", var="var", max_="max", min_="min", count="count", med="median").items()}
    cases |= {f"cov{n}": lambda g: window(g.x, n).cov(g.y), f"corr{n}": lambda g: window(g.x, n).corr(g.y),
              f"q{n}": lambda g: window(g.x, n).quantile(0.8), f"rank{n}": lambda g: window(g.x, n).rank(pct=True),
              f"mad{n}": lambda g: window(g.x, n).apply(lambda v: np.nanmean(np.abs(v - np.nanmean(v))), raw=True)}
    for name, fn in cases.items():
        np.testing.assert_allclose(plain[name].astype(float), by_series(data, fn), rtol=1e-7, atol=1e-7, err_msg=name)
    # pandas' running higher moments are themselves only good to a few digits
    for name, m in (("skew", "skew"), ("kurt", "kurt")):
        np.testing.assert_allclose(plain[f"{name}{n}"].astype(float), by_series(data, lambda g: getattr(window(g.x, n), m)()), rtol=1e-2, atol=1e-2)


@pytest.mark.parametrize("n", [0, 5, 20])
def test_regression_matches_polyfit(data, plain, n):
    def line(v, residual):
        k, ok = np.arange(len(v), dtype=float), ~np.isnan(v)
        if ok.sum() < 2:
            return np.nan
        b, a = np.polyfit(k[ok], v[ok], 1)
        return v[-1] - (b * k[-1] + a) if residual else b
    for name, res in (("slope", False), ("resi", True)):
        np.testing.assert_allclose(plain[f"{name}{n}"].astype(float), by_series(data, lambda g: window(g.x, n).apply(lambda v: line(v, res), raw=True)),
                                   rtol=1e-6, atol=1e-6)


def test_exponential_means_match_pandas(data, plain):
    for name, fn in {"ema5": lambda g: g.x.ewm(span=5, min_periods=1).mean(), "ema20": lambda g: g.x.ewm(span=20, min_periods=1).mean(),
                     "ema_p3": lambda g: g.x.ewm(alpha=0.3).mean(), "ema_na": lambda g: g.y.ewm(span=12, adjust=False).mean()}.items():
        np.testing.assert_allclose(plain[name].astype(float), by_series(data, fn), rtol=1e-9, atol=1e-9, err_msg=name)


def test_fills_spans_and_long_windows(data, plain):
    for name, fn in {"ff": lambda g: g.x.ffill(), "bf": lambda g: g.x.bfill(), "sr": lambda g: g.x.rank(pct=True),
                     "t": lambda g: g.set_index("datetime").x.rolling("21s").sum(), "long_mean": lambda g: g.x.rolling(120, min_periods=1).mean(),
                     "long_max": lambda g: g.x.rolling(120, min_periods=1).max(), "long_sum": lambda g: g.y.rolling(150, min_periods=1).sum(),
                     "long_count": lambda g: g.x.rolling(150, min_periods=1).count(),
                     "nest": lambda g: g.x.diff().rolling(5, min_periods=1).mean().rolling(10, min_periods=1).std()}.items():
        np.testing.assert_allclose(plain[name].astype(float), by_series(data, fn), rtol=1e-8, atol=1e-8, err_msg=name)


def small(spark, values, name="a"):
    rows = [(name, dt.datetime(2024, 1, 1) + dt.timedelta(days=i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "instrument string, datetime timestamp_ntz, x double")


def column(df, e):
    return [r["v"] for r in features(Panel(df, blocked=False), {"v": e}).orderBy("datetime").collect()]


def test_null_tie_and_argmax(spark):
    df = small(spark, [3.0, 1.0, None, 4.0, 4.0, 5.0, 9.0, 2.0])
    assert column(df, E.idxmax(X, 3)) == [1.0, 1.0, 1.0, 3.0, 2.0, 3.0, 3.0, 2.0]
    assert column(df, E.count(X, 3)) == [1.0, 2.0, 2.0, 2.0, 2.0, 3.0, 3.0, 3.0]
    assert column(df, E.rank(X, 3))[4] == 0.75
    assert column(df, E.gt(X, 3))[2] is False and column(df, E.ne(X, 3))[2] is True


def test_safe_arithmetic(spark):
    df = small(spark, [1.0, -1.0, 0.0])
    inf = float("inf")
    assert column(df, X / (X * 0)) == [inf, -inf, None]
    assert column(df, E.log(X)) == [0.0, None, -inf]
    assert column(df, E.power(X, 0.5)) == [1.0, None, 0.0]
    assert column(df, E.is_inf(1 / X)) == [False, False, True]


def test_flat_windows_have_no_correlation(spark):
    df = small(spark, [7.0] * 5 + [8.0])
    assert column(df, E.rsquare(X, 4))[:5] == [None] * 5
    assert column(df, E.corr(X, E.POS, 4))[:5] == [None] * 5
    assert column(df, E.std(X, 4))[4] == 0.0


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_short_series(spark, n):
    df = small(spark, [float(i * i) for i in range(n)])
    assert (column(df, E.std(X, 5))[-1] is None) == (n < 2)
    assert (column(df, E.skew(X, 5))[-1] is None) == (n < 3)
    assert (column(df, E.kurt(X, 5))[-1] is None) == (n < 4)
    assert (column(df, E.slope(X, 5))[-1] is None) == (n < 2)


def test_range_and_universe_do_not_cut_windows(spark, frame):
    e = {"m": E.mean(X, 5), "e": E.ema(X, 5)}
    full = collect(features(Panel(frame), e))
    part = collect(features(Panel(frame), e, start="2024-01-01 00:01:00", end="2024-01-01 00:03:00"))
    want = full[(full.datetime >= "2024-01-01 00:01:00") & (full.datetime <= "2024-01-01 00:03:00")].reset_index(drop=True)
    pd.testing.assert_frame_equal(part, want)
    spans = spark.createDataFrame([("i0", dt.datetime(2024, 1, 1, 0, 1), dt.datetime(2024, 1, 1, 0, 2)),
                                   ("i0", dt.datetime(2024, 1, 1, 0, 5), dt.datetime(2024, 1, 1, 0, 6))],
                                  "instrument string, start timestamp_ntz, end timestamp_ntz")
    got = collect(features(Panel(frame), e, universe=spans))
    t = full.datetime
    inside = (full.instrument == "i0") & (t.between("2024-01-01 00:01:00", "2024-01-01 00:02:00") | t.between("2024-01-01 00:05:00", "2024-01-01 00:06:00"))
    pd.testing.assert_frame_equal(got, full[inside].reset_index(drop=True))


def test_calendar_pushdown_reads_fewer_rows(spark):
    df = small(spark, [float(i) for i in range(200)])
    cal = df.select("datetime")
    out = features(Panel(df, blocked=False), {"m": E.mean(X, 5), "l": E.ref(X, -2)}, start="2024-04-01", end="2024-04-03", calendar=cal)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "2024-03-28" in plan and "2024-04-05" in plan
    assert [r["m"] for r in out.orderBy("datetime").collect()] == [89.0, 90.0, 91.0]
