"""Models, stores and streams against brute force."""

import datetime as dt
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strataline.functions import registry as REG
from strataline.operators import calendars as C
from strataline.operators import orders as O
from strataline.operators import pit as PIT
from strataline.operators import processors as P
from strataline.operators import quality as Q
from strataline.operators import risk as K
from strataline.operators import splits as SP
from strataline.operators.setops import membership_changes, spans_from_changes
from strataline.plans import expr as E
from strataline.plans import featuresets as FS
from strataline.plans.evaluate import Panel, features
from strataline.sources import store as ST
from strataline.streaming import jobs as J


def panel(spark, pdf):
    return spark.createDataFrame(pdf).withColumn("datetime", F.col("datetime").cast("timestamp_ntz"))


@pytest.fixture(scope="module")
def returns(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (80, 6)) @ rng.normal(0, 1, (6, 6))
    names = [f"n{i}" for i in range(6)]
    pdf = pd.DataFrame(x, columns=names, index=pd.date_range("2024-01-01", periods=80, name="datetime"))
    long = pdf.reset_index().melt("datetime", var_name="instrument", value_name="ret")
    return x, names, panel(spark, long)


def matrix(df, names):
    return df.toPandas().pivot(index="a", columns="b", values="value").loc[names, names].to_numpy()


def test_structured_covariance(returns):
    x, names, df = returns
    c = x - x.mean(axis=0)
    _, s, vt = np.linalg.svd(c, full_matrices=False)
    f = vt[:3].T
    b = c @ f
    want = f @ np.cov(b.T) @ f.T + np.diag((c - b @ f.T).var(axis=0))
    np.testing.assert_allclose(matrix(K.structured_covariance(df, 3)["covariance"], names), want, rtol=1e-6, atol=1e-8)


def test_masked_covariance_is_pairwise(spark, returns):
    x, names, df = returns
    holes = df.where(~((F.col("instrument") == "n1") & (F.dayofmonth("datetime") % 5 == 0)))
    got = matrix(K.sample_covariance(holes, nan="mask"), names)
    day = pd.date_range("2024-01-01", periods=80).day
    y = x.copy()
    y[day % 5 == 0, 1] = np.nan
    m = np.ma.masked_invalid(y - np.nanmean(y, axis=0)).filled(0)
    here = (~np.isnan(y)).astype(float)
    np.testing.assert_allclose(got, m.T @ m / (here.T @ here), rtol=1e-9)


def test_oas_compat_formula(returns):
    x, names, df = returns
    c = x - x.mean(axis=0)
    s, n, p = c.T @ c / 80, 80, 6
    a = (1 - 2 / p) * ((s ** 2).sum() + np.trace(s) ** 2) / ((n + 1 - 2 / p) * ((s ** 2).sum() + np.trace(s) ** 2 / p))
    got = K.shrunk_covariance(df, "const_var", "oas", compat=True).select("intensity").first()[0]
    assert got == pytest.approx(a)


def test_rolling_risk(returns):
    x, names, df = returns
    members = df.select("instrument", "datetime")
    out = K.rolling_risk(df, members, C.calendar_of(df), 40, 2).toPandas()
    last = out[out.date == out.date.max()].set_index("instrument").loc[names]
    w = pd.DataFrame(x[-40:])
    w = w.clip(w.quantile(0.025), w.quantile(0.975), axis=1)
    c = (w - w.mean()).to_numpy()
    _, s, vt = np.linalg.svd(c, full_matrices=False)
    rest = c - c @ vt[:2].T @ vt[:2]
    np.testing.assert_allclose(last["specific_risk"], rest.std(axis=0), rtol=1e-8)
    assert out.date.nunique() == 41


@pytest.mark.parametrize("nan", ["fill", "mask"])
def test_small_tiles_give_the_same_covariance(returns, nan):
    """Several tiles and chunks, with holes: products over pairs of tiles, added up over chunks."""
    _, names, df = returns
    holes = df.where(~((F.col("instrument") == "n1") & (F.dayofmonth("datetime") % 5 == 0)))
    for make in (lambda **k: K.sample_covariance(holes, nan, **k), lambda **k: K.sample_covariance(holes, nan, correlation=True, **k)):
        np.testing.assert_allclose(matrix(make(tile=2, span=17), names), matrix(make(), names), rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("target", ["const_corr", "single_factor"])
def test_small_tiles_give_the_same_shrinkage(returns, target):
    _, names, df = returns
    got, want = (K.shrunk_covariance(df, target, **k) for k in ({"tile": 2, "span": 17}, {}))
    np.testing.assert_allclose(matrix(got, names), matrix(want, names), rtol=1e-9, atol=1e-12)
    assert got.first()["intensity"] == pytest.approx(want.first()["intensity"], rel=1e-9)


@pytest.mark.parametrize("target,alpha", [("const_var", "oas"), ("const_var", "lw"), ("const_corr", "lw"), ("single_factor", "lw")])
def test_shrinkage_never_stores_the_cells(returns, monkeypatch, target, alpha):
    """What is checkpointed grows with names and dates, not with names x names."""
    _, names, df = returns
    stored, settle = [], K.settle
    monkeypatch.setattr(K, "settle", lambda d: (stored.append(d.count()), settle(d))[1])
    few = df.where("datetime < '2024-01-05'")
    assert K.shrunk_covariance(few, target, alpha, tile=2).count() == 36
    assert max(stored) <= few.count() < 36


def test_more_factors_than_dates(spark, monkeypatch):
    """The random space is no wider than the rank of the returns, and the model with all factors is the sample covariance."""
    x = np.random.default_rng(7).normal(0, 1, (9, 50))
    names = [f"n{i:02d}" for i in range(50)]
    long = pd.DataFrame(x, columns=names, index=pd.date_range("2024-01-01", periods=9, name="datetime")).reset_index().melt("datetime", var_name="instrument", value_name="ret")
    widths, narrow = [], K._orthonormal
    monkeypatch.setattr(K, "_orthonormal", lambda z, width, *a: (widths.append(width), narrow(z, width, *a))[1])
    got = matrix(K.structured_covariance(panel(spark, long), 10_000, tile=20)["covariance"], names)
    assert max(widths) <= 9
    np.testing.assert_allclose(got, np.cov(x.T), rtol=1e-7, atol=1e-9)


def test_factors_by_subspace_iteration(spark):
    """More instruments than the random space is wide, in several tiles and chunks."""
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (90, 4)) @ rng.normal(0, 3, (4, 60)) + rng.normal(0, 1, (90, 60))
    names = [f"n{i:02d}" for i in range(60)]
    long = pd.DataFrame(x, columns=names, index=pd.date_range("2024-01-01", periods=90, name="datetime")).reset_index().melt("datetime", var_name="instrument", value_name="ret")
    model = K.structured_covariance(panel(spark, long), 2, tile=9, span=40)
    c = x - x.mean(axis=0)
    _, s, vt = np.linalg.svd(c, full_matrices=False)
    f = vt[:2].T
    b = c @ f
    want = f @ np.diag((b * b).sum(axis=0) / 89) @ f.T + np.diag((c - b @ f.T).var(axis=0))
    np.testing.assert_allclose(matrix(model["covariance"], names), want, rtol=1e-6, atol=1e-7)
    e = model["exposure"].toPandas().pivot(index="instrument", columns="factor", values="exposure").loc[names].to_numpy()
    np.testing.assert_allclose(e, f * np.where(f.sum(axis=0) < 0, -1, 1), atol=1e-6)
    np.testing.assert_allclose(model["factor"].orderBy("factor").toPandas()["variance"], s[:2] ** 2 / 89)


def test_rolling_risk_in_tiles(returns):
    _, names, df = returns
    members = df.where(~((F.col("instrument") == "n3") & (F.dayofmonth("datetime") > 20)))
    one, two = (K.rolling_risk(df, members.select("instrument", "datetime"), C.calendar_of(df), 30, 3, **k).toPandas().sort_values(["date", "instrument"])
                for k in ({}, {"tile": 2}))
    assert len(one) == len(two) and (one[["date", "instrument"]].to_numpy() == two[["date", "instrument"]].to_numpy()).all()
    for c in ("exposure", "factor_variance"):
        np.testing.assert_allclose(np.stack(one[c]), np.stack(two[c]), atol=1e-8)
    np.testing.assert_allclose(one["specific_risk"], two["specific_risk"], rtol=1e-8)


def test_alphas_match_pandas(spark):
    rng = np.random.default_rng(2)
    n = 120
    c = 50 + rng.normal(0, 1, n).cumsum() * 0.3
    g = pd.DataFrame({"instrument": "a", "datetime": pd.date_range("2024-01-01", periods=n), "open": c + 0.1, "high": c + 1, "low": c - 1, "close": c,
                      "volume": rng.integers(50, 90, n).astype(float)})
    got = features(Panel(panel(spark, g), blocked=False), FS.crypto_alphas()).toPandas().sort_values("datetime")
    rk = lambda s: s.rank(pct=True)
    ret = g.close.pct_change()
    inner = pd.Series(np.where(ret < 0, ret.rolling(20).std(), g.close)) ** 2
    d7 = g.close.diff(7)
    want = {
        "alpha001": rk(inner.rolling(5).apply(lambda v: np.argmax(v.values))) - 0.5,
        "alpha002": -rk(np.log(g.volume).diff(2)).rolling(6).corr(rk((g.close - g.open) / g.open)),
        "alpha003": -rk(g.high).rolling(5).corr(rk(g.volume)),
        "alpha004": -rk(g.low).rolling(9).rank(pct=True),
        "alpha102": pd.Series(np.where(g.volume.rolling(20).mean() < g.volume, -d7.abs().rolling(10).rank(pct=True) * np.sign(d7), -1)),
        "alpha104": g.volume.pct_change(5).rolling(10).corr(g.close.pct_change(5)),
        "alpha202": rk(g.close.ewm(span=12, adjust=False).mean() - g.close.ewm(span=26, adjust=False).mean()),
        "alpha304": g.close.rolling(20).std().rolling(10).rank(pct=True),
    }
    for k, v in want.items():
        if k == "alpha002":  # the price factor is constant up to rounding noise here
            continue
        np.testing.assert_allclose(got[k].astype(float), v.to_numpy(dtype=float), rtol=1e-6, atol=1e-6, err_msg=k)


def test_boosted_trees_learn(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"instrument": "a", "datetime": pd.date_range("2024-01-01", periods=300), "f": rng.normal(0, 1, 300)})
    pdf["label"] = (pdf.f > 0) * 2.0
    df = panel(spark, pdf)
    m = SP.fit_boosted_trees(df, ["f"], rounds=5, depth=2)
    out = SP.predict(m, df, ["f"]).toPandas()
    assert np.corrcoef(out.score, out.label)[0, 1] > 0.95


def test_lasso_shrinks_to_zero(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"instrument": "a", "datetime": pd.date_range("2024-01-01", periods=200), "f": rng.normal(0, 1, 200), "g": rng.normal(0, 1, 200)})
    pdf["label"] = 3 * pdf.f
    m = SP.fit_linear(panel(spark, pdf), ["f", "g"], kind="lasso", alpha=0.5)
    assert m.coefficients[1] == pytest.approx(0, abs=1e-6) and 2 < m.coefficients[0] < 3


def test_rolling_splits_follow_the_calendar():
    cal = [dt.datetime(2024, 1, d) for d in range(1, 21)]
    segs = {"train": (cal[0], cal[5]), "valid": (cal[6], cal[8]), "test": (cal[9], None)}
    out = SP.rolling_splits(cal, segs, 4, expanding=False)
    assert [s["test"] for s in out] == [(cal[9], cal[12]), (cal[13], cal[16]), (cal[17], cal[19])]
    assert out[1]["train"] == (cal[4], cal[9])
    cut = SP.rolling_splits(cal, segs, 4, trunc_days=3)
    assert cut[0]["valid"][1] == cal[6] and cut[0]["train"][0] == cal[0]


def test_publications_known_later_only(spark):
    facts = [("a", dt.date(2024, 1, 10), 202301, 1.0), ("a", dt.date(2024, 2, 10), 202303, 3.0), ("a", dt.date(2024, 3, 1), 202301, 1.5),
             ("a", dt.date(2024, 3, 5), 202303, 3.5)]
    f = spark.createDataFrame(facts, "instrument string, date date, period int, value double")
    days = [dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 10), dt.datetime(2024, 2, 20), dt.datetime(2024, 3, 2), dt.datetime(2024, 4, 1)]
    grid = spark.createDataFrame([("a", d) for d in days], "instrument string, datetime timestamp_ntz")
    get = lambda df: [r["value"] for r in df.orderBy("datetime").collect()]
    v = E.field("value")
    assert get(PIT.point_in_time(f, grid)) == [None, 1.0, 3.0, 3.0, 3.5]
    assert get(PIT.period_value(f, grid, 202301)) == [None, 1.0, 1.0, 1.5, 1.5]
    assert get(PIT.point_in_time(f, grid, E.ref(v, 1))) == [None] * 5  # the second quarter was never published
    assert get(PIT.point_in_time(f, grid, E.sum_(v, 0))) == [None, 1.0, 4.0, 4.5, 5.0]
    with pytest.raises(ValueError):
        PIT.evaluate_at_publications(f, E.ref(v, -1))


def test_membership_round_trip(spark):
    d = [dt.datetime(2024, 1, x) for x in range(1, 7)]
    member = {"a": [0, 1, 2, 3, 4, 5], "b": [0, 1, 4, 5], "c": [2, 3]}
    snap = spark.createDataFrame([(k, d[i]) for k, v in member.items() for i in v], "instrument string, datetime timestamp_ntz")
    ch = membership_changes(snap, C.calendar_of(snap))
    got = {(r[0], r[1], r[2]) for r in ch.select("instrument", "datetime", "type").collect()}
    assert got == {("b", d[1], "remove"), ("b", d[4], "add"), ("c", d[2], "add"), ("c", d[3], "remove")}
    spans = spans_from_changes(ch, snap.where("datetime = timestamp_ntz'2024-01-06'").select("instrument"), "2024-01-01", "2024-01-06")
    assert {tuple(r) for r in spans.select("instrument", "start", "end").collect()} == {
        ("a", d[0], d[5]), ("b", d[0], d[1]), ("b", d[4], d[5]), ("c", d[2], d[3])}


def test_repair_follows_long_runs(spark):
    close = [1.0, 100.0, 101.0, 99.0, 1.0, 1.02]
    df = panel(spark, pd.DataFrame({"instrument": "a", "datetime": pd.date_range("2024-01-01", periods=6), "close": close}))
    got = [r["close"] for r in Q.repair_units(Panel(df)).orderBy("datetime").collect()]
    assert got == pytest.approx([1.0, 1.0, 1.01, 0.99, 1.0, 1.02])


@pytest.mark.parametrize("seed", range(4))
def test_repair_is_the_repeated_repair(spark, seed):
    """Against one division per pass, with runs in runs, missing rows, zeros and jumps that are no unit errors."""
    rng = np.random.default_rng(seed)
    close = 10 * np.exp(rng.normal(0, 0.01, 400).cumsum()) * 100.0 ** np.clip(rng.integers(-1, 2, 400).cumsum() * (rng.random(400) < 0.7), 0, 3)
    close[rng.random(400) < 0.1] = np.nan
    close[rng.random(400) < 0.02] = 0.0
    close[rng.random(400) < 0.05] *= 7
    df = panel(spark, pd.DataFrame({"instrument": "a", "datetime": pd.date_range("2024-01-01", periods=400), "close": close}))
    got = Q.repair_units(Panel(df.withColumn("close", F.nanvl("close", F.lit(None).cast("double"))))).orderBy("datetime").toPandas()["close"]
    want = pd.Series(close)
    while True:
        full = want.ffill()
        with np.errstate(all="ignore"):
            bad = want.notna() & (full / full.shift() - 1).between(89, 111)
        if not bad.any():
            break
        want[bad] /= 100
    np.testing.assert_allclose(got, want, rtol=1e-9)


def test_sums_of_all_periods_by_changes(spark):
    """Revisions, missing values and late periods: running changes against all periods of every day."""
    rng = np.random.default_rng(5)
    rows = [("ab"[k % 2], dt.date(2020, 1, 1) + dt.timedelta(int(rng.integers(0, 90))), 202001 + int(rng.integers(0, 4)) + 100 * int(rng.integers(0, 3)),
             None if rng.random() < 0.2 else float(rng.integers(1, 50))) for k in range(200)]
    facts = spark.createDataFrame([(i, d, p, v) for (i, d, p), v in {r[:3]: r[3] for r in rows}.items()], "instrument string, date date, period int, value double")
    v = E.field("value")
    sums = {"sum": E.sum_(v, 0), "mixed": E.sum_(v * 2 + 1, 0) / E.count(v, 0) - v}
    for name, e in sums.items():
        got = {(r.instrument, r.day): r.value for r in PIT.evaluate_at_publications(facts, e).collect()}
        s = PIT.series_at_publications(facts, None).toPandas()
        for key, g in s.groupby(["instrument", "day"]):
            x = g.sort_values("period_idx")["value"]
            total = x.sum() if x.notna().any() else None
            want = total if name == "sum" else None if total is None or np.isnan(x.iloc[-1]) else (2 * x + 1).sum() / x.notna().sum() - x.iloc[-1]
            assert got[key] == (None if want is None else pytest.approx(want)), (name, key)


def test_missing_gate_raises(spark):
    df = panel(spark, pd.DataFrame({"instrument": "a", "datetime": pd.date_range("2024-01-01", periods=4), "x": [1.0, np.nan, np.nan, 1.0]}))
    df = df.withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    with pytest.raises(ValueError):
        Q.require_present(df, ["x"], 0.3)
    assert Q.missing_columns(df, ["x", "volume"]) == ["volume"]


def test_pipeline_rejects_training_only_steps():
    with pytest.raises(ValueError):
        P.Pipeline(infer=[P.DropMissingLabel(["label"])])


def test_twap_rounding_and_remainder(spark):
    o = spark.createDataFrame([(1, 35.0), (2, 3.0)], "order_id long, amount double")
    got = [(r.order_id, r.step, r.child_amount) for r in O.twap_schedule(o, F.lit(4), F.lit(10.0)).orderBy("order_id", "step").collect()]
    assert got == [(1, 0, 10.0), (1, 1, 10.0), (1, 2, 10.0), (1, 3, 5.0), (2, 3, 3.0)]


def test_sampled_orders_repeat(spark, sf):
    import __spark_entry__ as entry
    q = entry.queries()["sampled_orders"]
    assert sorted(map(tuple, q(spark, sf).collect())) == sorted(map(tuple, q(spark, sf).collect()))


def test_custom_operator_warns():
    REG.register_operator("half", lambda a: a / 2)
    with pytest.warns(UserWarning):
        REG.register_operator("half", lambda a: a / 2)
    assert REG.operator("half")(E.field("x")).key == (E.field("x") / 2).key


def test_binary_series(spark, tmp_path):
    os.makedirs(tmp_path / "abc")
    np.array([2, 1.5, np.nan, 3.0], dtype="<f4").tofile(tmp_path / "abc" / "close.day.bin")
    cal = C.calendar_of(panel(spark, pd.DataFrame({"datetime": pd.date_range("2024-01-01", periods=10)})))
    rows = ST.read_series_files(spark, str(tmp_path), cal).orderBy("datetime").collect()
    assert [(r.instrument, r.field, r.datetime.day, r.value) for r in rows] == [("ABC", "close", 3, 1.5), ("ABC", "close", 4, None), ("ABC", "close", 5, 3.0)]


def test_partitioned_sink_and_replacement(spark, tmp_path):
    df = panel(spark, pd.DataFrame({"instrument": ["a/b"] * 3, "datetime": pd.date_range("2024-01-01", periods=3), "close": [1.0, 2.0, 3.0]}))
    man = ST.save_partitioned(df, str(tmp_path / "p"), "1d").first()
    assert man["symbol"] == "a-b" and man["row_count"] == 3
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3
    ST.replace_dates(df, str(tmp_path / "f"))
    ST.replace_dates(df.where("close = 2").withColumn("close", F.lit(9.0)), str(tmp_path / "f"))
    assert sorted(r.close for r in spark.read.parquet(str(tmp_path / "f")).collect()) == [1.0, 3.0, 9.0]


def test_late_ticks_are_dropped_and_counted(spark, tmp_path):
    src = str(tmp_path / "in")

    def add(minutes, name):
        rows = [("a", dt.datetime(2024, 1, 1, 10) + dt.timedelta(minutes=m), float(m)) for m in minutes]
        spark.createDataFrame(rows, "instrument string, datetime timestamp, value double").coalesce(1).write.mode("append").parquet(src)

    stream = lambda: spark.readStream.schema("instrument string, datetime timestamp, value double").parquet(src)
    add([0, 20, 90], 1)
    first = J.run_once(J.stream_bars(stream()), str(tmp_path / "out"), str(tmp_path / "state"))
    assert first["rows"] == 3
    add([5, 200], 2)  # 10:05 is beyond the watermark of 11:20
    second = J.run_once(J.stream_bars(stream()), str(tmp_path / "out"), str(tmp_path / "state"))
    assert second["late"] == 1
    bars = {r.datetime.hour: (r.open, r.close, r.volume) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert bars[10] == (0.0, 20.0, 20.0) and bars[11] == (90.0, 90.0, 90.0)


def test_state_survives_between_batches(spark, tmp_path):
    src = str(tmp_path / "in")
    run = lambda: J.run_once(J.stream_changes(spark.readStream.schema("instrument string, datetime timestamp, value double").parquet(src)),
                             str(tmp_path / "out"), str(tmp_path / "state"))
    for i, v in enumerate([10.0, 12.0]):
        spark.createDataFrame([("a", dt.datetime(2024, 1, 1 + i), v)], "instrument string, datetime timestamp, value double").write.mode("append").parquet(src)
        run()
    got = {r.value: r.previous for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {10.0: None, 12.0: 10.0}
