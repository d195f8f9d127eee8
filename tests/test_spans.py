"""Windows over spans of time, intervals of orders and streamed state cost the same a row, however many rows a series has."""

import datetime as dt
import io
from contextlib import redirect_stdout
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest

from strataline.operators import orders as O
from strataline.plans import expr as E
from strataline.plans.evaluate import Panel, features
from strataline.streaming import jobs as J

START = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("blocked", [False, True])
def test_span_sums_equal_brute_force(spark, blocked):
    rng = np.random.default_rng(5)
    rows = []
    for name in ("a", "b"):
        for m in sorted(rng.integers(0, 5000, 400).tolist()):        # equal times among them
            v = [None, float("inf"), -float("inf"), float(m % 97) / 8][min(int(rng.integers(0, 60)), 3)]
            rows.append((name, START + dt.timedelta(minutes=m), len(rows), v))
    df = spark.createDataFrame(rows, "instrument string, datetime timestamp_ntz, i long, x double").repartition(3)
    x = E.field("x")
    e = {"s": E.sum_(x, "90min"), "n": E.count(x, "2h"), "m": E.mean(x, "90min"), "i2": E.field("i") + 0}
    out = features(Panel(df, blocked), e)
    text = io.StringIO()
    with redirect_stdout(text):
        out.explain()
    assert "RangeFrame" not in text.getvalue()      # a sliding frame, which reads its window again for every row
    got = {int(r.i2): r for r in out.collect()}
    assert len(got) == len(rows)
    for name, t, i, _ in rows:
        near = lambda span: [v for k, u, _, v in rows if k == name and t - dt.timedelta(minutes=span) < u <= t and v is not None]
        want = near(90)
        with np.errstate(all="ignore"):
            for k, w in (("s", np.sum(want) if want else None), ("m", np.mean(want) if want else None), ("n", float(len(near(120))))):
                v = getattr(got[i], k)
                assert (v is None) == (w is None) and (v is None or np.isclose(v, w, rtol=1e-12, equal_nan=True)), (i, k, v, w)


def test_carried_state_is_given_back_in_pieces():
    n = 2 * J.PIECE + 7
    rng = np.random.default_rng(1)
    rows = pd.DataFrame({"instrument": "a", "datetime": pd.Timestamp(START) + pd.to_timedelta(rng.permutation(n), unit="s"), "value": rng.integers(0, 4, n).astype(float)})
    kept = []
    state = SimpleNamespace(exists=True, get=(3.0,), update=kept.append)
    pieces = list(J._carry(("a",), iter([rows[:1000], rows[1000:]]), state))
    assert len(pieces) == 3 and max(map(len, pieces)) <= J.PIECE
    got, want = pd.concat(pieces, ignore_index=True), rows.sort_values("datetime", ignore_index=True)
    prev = want["value"].shift(1)
    prev.iloc[0] = 3.0
    assert (got["value"] == want["value"]).all() and (got["previous"] == prev).all() and kept == [(want["value"].iloc[-1],)]
    assert got["change"].equals((want["value"] / prev - 1).where(prev != 0))


def test_equal_intervals_are_looked_up_once(spark):
    day = lambda k: START + dt.timedelta(days=k)
    orders = spark.createDataFrame([(i, "a", day(0), day(2 + i % 2)) for i in range(10)], "order_id long, instrument string, start timestamp_ntz, end timestamp_ntz")
    quotes = spark.createDataFrame([("a", day(k), float(k + 1), 1.0 + k) for k in range(5)], "instrument string, datetime timestamp_ntz, price double, volume double")
    assert {(r.end, r.base_price) for r in O.interval_prices(orders, quotes).collect()} == {(day(2), 2.0), (day(3), 2.5)}
    assert sorted((r.order_id, r.base_price) for r in O.base_prices(orders, quotes).collect()) == [(i, 2.0 + i % 2 / 2) for i in range(10)]
