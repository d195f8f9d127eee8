"""Windows in arrays are merged from each other: few steps, the values of each window taken for itself, and of frames where a value is infinite."""

import datetime as dt

import numpy as np
import pytest

from strataline.plans import arrays as A
from strataline.plans import expr as E
from strataline.plans.evaluate import Panel, features


def test_windows_share_their_parts():
    m = A._Merged([5, 10, 20, 30, 60], np.arange(100.0)[None])
    k, mean, _ = m.of("moments", 60)
    assert sorted(n for _, n in m.made) == [1, 2, 3, 5, 10, 20, 30, 60]
    assert k[0, -1] == 60 and mean[0, -1] == 69.5


@pytest.mark.parametrize("lo", [0, 37])
def test_merged_windows_equal_windows_taken_whole(lo):
    rng = np.random.default_rng(5)
    x = {c: np.where(rng.random(90) < 0.2, np.nan, rng.integers(1, 9, 90).astype(float)) for c in "ab"}
    ops = ["count", "sum", "mean", "std", "max", "min", "idxmax", "idxmin", "slope", "rsq", "resi", "rank"]
    calls = [(f"{op}{n}", op, ["a"], (n,)) for op in ops for n in (1, 7, 13)] + [("cov7", "cov", ["a", "b"], (7,)), ("q13", "quantile", ["a"], (13, 0.3))]
    with np.errstate(all="ignore"):
        got = A._values(x, lo, 90, calls)
    for name, op, cs, p in calls:
        for i in range(lo, 90):
            first = max(0, i - p[0] + 1)
            v, w = x["a"][first:i + 1], x["b"][first:i + 1]
            ok = ~np.isnan(v)
            y, t, own = v[ok], np.flatnonzero(ok), x["a"][i]
            fit = np.polyfit(t, y, 1) if len(y) > 1 and op in ("slope", "resi", "rsq") else None
            both = ok & ~np.isnan(w)
            some, more = len(y) > 0, len(y) > 1
            want = {"count": lambda: len(y), "sum": lambda: y.sum() if some else np.nan, "mean": lambda: y.mean() if some else np.nan,
                    "std": lambda: y.std(ddof=1) if more else np.nan, "max": lambda: y.max() if some else np.nan, "min": lambda: y.min() if some else np.nan,
                    "idxmax": lambda: np.nanargmax(v) + 1 if some else np.nan, "idxmin": lambda: np.nanargmin(v) + 1 if some else np.nan,
                    "slope": lambda: fit[0] if more else np.nan, "resi": lambda: own - np.polyval(fit, i - first) if more else np.nan,
                    "rsq": lambda: (1.0 if y.std() == 0 else np.corrcoef(t, y)[0, 1] ** 2) if more else np.nan,
                    "rank": lambda: np.nan if np.isnan(own) else ((y < own).sum() + ((y == own).sum() + 1) / 2) / len(y),
                    "cov": lambda: np.cov(v[both], w[both])[0, 1] if both.sum() > 1 else np.nan,
                    "quantile": lambda: np.quantile(y, 0.3) if some else np.nan}[op]()
            assert np.isclose(got[name][i - lo], want, rtol=1e-9, atol=1e-9, equal_nan=True), (name, i, got[name][i - lo], want)


def test_infinite_values_as_in_frames(spark):
    rows = [("a", dt.datetime(2024, 1, 1) + dt.timedelta(days=k), float("inf") if k == 11 else float(k * k % 7)) for k in range(30)]
    df = spark.createDataFrame(rows, "instrument string, datetime timestamp_ntz, close double")
    c = E.field("close")
    e = {"rsq": E.rsquare(c, 5), "slope": E.slope(c, 5), "resi": E.resi(c, 5)}
    got, want = [features(Panel(df, False, arrays=on), e).orderBy("datetime").collect() for on in (True, False)]
    for g, w in zip(got, want):
        for k in e:
            assert (g[k] is None) == (w[k] is None) and (w[k] is None or np.isclose(g[k], w[k])), (g.datetime, k, g[k], w[k])
    assert [g.rsq is None for g in got][11:16] == [True] * 5
