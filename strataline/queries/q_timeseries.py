"""Per-instrument window operators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from strataline.operators import resample as R
from strataline.plans import expr as E
from strataline.plans.evaluate import Panel, features, with_columns
from strataline.queries.common import bars_d, bars_h, query, r, rounded, rq, sql, table, ticks

O, H, L, CL, V = (E.field(n) for n in ("open", "high", "low", "close", "volume"))

W = """WINDOW w AS (PARTITION BY instrument ORDER BY datetime),
    w5 AS (PARTITION BY instrument ORDER BY datetime ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
    w10 AS (PARTITION BY instrument ORDER BY datetime ROWS BETWEEN 9 PRECEDING AND CURRENT ROW),
    w20 AS (PARTITION BY instrument ORDER BY datetime ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
    x AS (PARTITION BY instrument ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


def ts_sql(cols: dict[str, str], n: int = 6, src: str = "bars_h", window: str = W) -> str:
    body = ", ".join(f"{rq(v, n)} AS {k}" for k, v in cols.items())
    return sql(f"SELECT instrument, datetime, {body} FROM {src} {window}", "bars_h")


def ts(s, d, exprs, n=6):
    return rounded(features(bars_h(s, d), exprs), n=n)


@query("ts_mean_sum_std_var", ts_sql({
    "mean5": "avg(close) OVER w5", "sum5": "sum(close) OVER w5", "std5": "stddev_samp(close) OVER w5",
    "var5": "var_samp(close) OVER w5", "mean0": "avg(close) OVER x", "sum0": "sum(close) OVER x",
    "std0": "stddev_samp(close) OVER x", "var0": "var_samp(close) OVER x"}))
def _(s, d):
    return ts(s, d, {f"{n}{k}": f(CL, k) for k in (5, 0) for n, f in
                     (("mean", E.mean), ("sum", E.sum_), ("std", E.std), ("var", E.var))})


@query("ts_skew_kurt", ts_sql({
    "skew10": "CASE WHEN count(close) OVER w10 >= 3 THEN skewness(close) OVER w10 END",
    "kurt10": "CASE WHEN count(close) OVER w10 >= 4 THEN kurtosis(close) OVER w10 END"}, 5))
def _(s, d):
    return ts(s, d, {"skew10": E.skew(CL, 10), "kurt10": E.kurt(CL, 10)}, 5)


@query("ts_max_min", ts_sql({"max10": "max(close) OVER w10", "min10": "min(close) OVER w10",
                             "max0": "max(close) OVER x", "min0": "min(close) OVER x"}))
def _(s, d):
    return ts(s, d, {"max10": E.max_(CL, 10), "min10": E.min_(CL, 10), "max0": E.max_(CL, 0), "min0": E.min_(CL, 0)})


@query("ts_idxmax_idxmin", ts_sql({
    "imax": "list_position(l, list_max(l))", "imin": "list_position(l, list_min(l))"},
    src="(SELECT *, list(close) OVER w10 AS l FROM bars_h WINDOW w10 AS "
        "(PARTITION BY instrument ORDER BY datetime ROWS 9 PRECEDING))", window=""))
def _(s, d):
    return ts(s, d, {"imax": E.idxmax(CL, 10), "imin": E.idxmin(CL, 10)})


@query("ts_quantile_median", ts_sql({"q80": "quantile_cont(close, 0.8) OVER w10", "med": "quantile_cont(close, 0.5) OVER w10",
                                     "med0": "quantile_cont(close, 0.5) OVER x"}))
def _(s, d):
    return ts(s, d, {"q80": E.quantile(CL, 10, 0.8), "med": E.med(CL, 10), "med0": E.med(CL, 0)})


LIST10 = "(SELECT *, list(close) OVER w10 AS l FROM bars_h WINDOW w10 AS (PARTITION BY instrument ORDER BY datetime ROWS 9 PRECEDING))"


@query("ts_mad", ts_sql({"mad": "list_avg(list_transform(l, lambda v: abs(v - list_avg(l))))"}, src=LIST10, window=""))
def _(s, d):
    return ts(s, d, {"mad": E.mad(CL, 10)})


@query("ts_rank", ts_sql({"pct_rank": "(len(list_filter(l, lambda v: v < close)) + (len(list_filter(l, lambda v: v = close)) + 1) / 2.0) / len(l)"},
                         src=LIST10, window=""))
def _(s, d):
    return ts(s, d, {"pct_rank": E.rank(CL, 10)})


@query("ts_ref_delta_count", ts_sql({
    "ref3": "lag(close, 3) OVER w", "lead2": "lead(close, 2) OVER w", "ref0": "first_value(close) OVER x",
    "delta3": "close - lag(close, 3) OVER w", "delta0": "close - first_value(close) OVER x",
    "cnt10": "count(close) OVER w10", "cnt0": "count(close) OVER x"}))
def _(s, d):
    return ts(s, d, {"ref3": E.ref(CL, 3), "lead2": E.ref(CL, -2), "ref0": E.ref(CL, 0), "delta3": E.delta(CL, 3),
                     "delta0": E.delta(CL, 0), "cnt10": E.count(CL, 10), "cnt0": E.count(CL, 0)})


POSED = "(SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY datetime) AS pos FROM bars_h)"


@query("ts_regression", ts_sql({
    "slope10": "CASE WHEN count(close) OVER w10 > 1 THEN regr_slope(close, pos) OVER w10 END",
    "rsq10": "CASE WHEN count(close) OVER w10 > 1 AND stddev_samp(close) OVER w10 > 2e-5 THEN regr_r2(close, pos) OVER w10 END",
    "resi10": "CASE WHEN count(close) OVER w10 > 1 THEN close - (avg(close) OVER w10 + (regr_slope(close, pos) OVER w10) * (pos - avg(pos) OVER w10)) END",
    "slope0": "CASE WHEN pos > 1 THEN regr_slope(close, pos) OVER x END"}, 5, src=POSED))
def _(s, d):
    return ts(s, d, {"slope10": E.slope(CL, 10), "rsq10": E.rsquare(CL, 10), "resi10": E.resi(CL, 10),
                     "slope0": E.slope(CL, 0)}, 5)


@query("ts_wma", ts_sql({
    "wma": "list_sum(list_transform(l, lambda v, i: v * i)) / (len(l) * (len(l) + 1) / 2.0) / len(l)",
    "true_wma": "list_sum(list_transform(l, lambda v, i: v * i)) / (len(l) * (len(l) + 1) / 2.0)"}, src=LIST10, window=""))
def _(s, d):
    return ts(s, d, {"wma": E.wma(CL, 10), "true_wma": E.wma(CL, 10, normalize=True)})


def _ema_sql(decay):
    return f"(SELECT sum(b.close * pow({decay}, p.pos - b.pos)) / sum(pow({decay}, p.pos - b.pos)) FROM posed b WHERE b.instrument = p.instrument AND b.pos <= p.pos)"


@query("ts_ema", sql(f"SELECT instrument, datetime, {rq(_ema_sql('(1 - 2.0 / 13)'))} AS ema12, {rq(_ema_sql('0.7'))} AS ema_a3 FROM posed p",
                     "bars_h", "posed AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY datetime) AS pos FROM bars_h)"))
def _(s, d):
    return ts(s, d, {"ema12": E.ema(CL, 12), "ema_a3": E.mean(CL, 0.3)})


# one position at a time is enough for the closed form: weights are powers of the decay, far from overflow here
@query("ts_ema_long", sql(f"""SELECT instrument, datetime, {rq('sum(value / pow(1 - 2.0 / 5001, pos)) OVER x / sum(1 / pow(1 - 2.0 / 5001, pos)) OVER x')} AS ema5000
    FROM (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY datetime) AS pos FROM ticks) WINDOW x AS (PARTITION BY instrument ORDER BY datetime)""", "ticks"))
def _(s, d):
    return rounded(features(Panel(ticks(s, d)), {"ema5000": E.ema(E.field("value"), 5000)}))


@query("ts_nested_spans", sql(f"""SELECT instrument, datetime, {rq('sum(s) OVER w', 4)} AS s2 FROM (SELECT *, sum(value) OVER w AS s FROM ticks
    WINDOW w AS (PARTITION BY instrument ORDER BY epoch_us(datetime) RANGE BETWEEN 1799999999 PRECEDING AND CURRENT ROW))
    WINDOW w AS (PARTITION BY instrument ORDER BY epoch_us(datetime) RANGE BETWEEN 1799999999 PRECEDING AND CURRENT ROW)""", "ticks"))
def _(s, d):
    return rounded(features(Panel(ticks(s, d)), {"s2": E.sum_(E.sum_(E.field("value"), "30min"), "30min")}), n=4)


@query("ts_corr_cov", ts_sql({
    "cov20": "covar_samp(close, volume) OVER w20",
    "corr20": "CASE WHEN count(close) OVER w20 > 1 AND stddev_samp(close) OVER w20 > 2e-5 AND stddev_samp(volume) OVER w20 > 2e-5 THEN corr(close, volume) OVER w20 END",
    "cov0": "covar_samp(close, volume) OVER x"}, 5))
def _(s, d):
    return ts(s, d, {"cov20": E.cov(CL, V, 20), "corr20": E.corr(CL, V, 20), "cov0": E.cov(CL, V, 0)}, 5)


@query("ts_generic_rolling", ts_sql({"a": "avg(close) OVER w10", "b": "stddev_samp(close) OVER w10", "c": "max(close) OVER w10"}))
def _(s, d):
    return ts(s, d, {k: E.rolling(CL, 10, f) for k, f in (("a", "mean"), ("b", "std"), ("c", "max"))})


@query("ts_resample", sql(f"""SELECT g.instrument, g.datetime, {rq('last_value(c IGNORE NULLS) OVER w')} AS "last", {rq('last_value(v IGNORE NULLS) OVER w')} AS total
    FROM (SELECT instrument, unnest(generate_series(min(b), max(b), INTERVAL 15 MINUTE)) AS datetime FROM buckets GROUP BY 1) g
    LEFT JOIN buckets k ON k.instrument = g.instrument AND k.b = g.datetime
    WINDOW w AS (PARTITION BY g.instrument ORDER BY g.datetime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""", "ticks",
    """buckets AS (SELECT instrument, time_bucket(INTERVAL 15 MINUTE, datetime) AS b, arg_max(value, datetime) AS c, sum(value) AS v
       FROM ticks GROUP BY 1, 2)"""))
def _(s, d):
    t = ticks(s, d)
    return rounded(R.resample(t, "15 minutes", {"last": ("value", "last"), "total": ("value", "sum")}, forward_fill=True))


@query("ts_day_last_cumsum", sql(f"""SELECT instrument, datetime,
    {rq("last_value(close) OVER (PARTITION BY instrument, CAST(datetime AS DATE) ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")} AS day_last,
    {rq("CASE WHEN hour(datetime) BETWEEN 9 AND 14 THEN sum(CASE WHEN hour(datetime) BETWEEN 9 AND 14 THEN volume END) OVER (PARTITION BY instrument, CAST(datetime AS DATE) ORDER BY datetime) ELSE 0 END")} AS day_sum
    FROM bars_h""", "bars_h"))
def _(s, d):
    return ts(s, d, {"day_last": E.day_last(CL), "day_sum": E.day_cumsum(V, 9 * 60, 14 * 60 + 59)})


@query("ts_fill", ts_sql({"ff": "last_value(v IGNORE NULLS) OVER x",
    "bf": "first_value(v IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY datetime ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"},
    src="(SELECT *, CASE WHEN close > 20 THEN close END AS v FROM bars_h)"))
def _(s, d):
    v = E.where(CL > 20, CL)
    return ts(s, d, {"ff": E.ffill(v), "bf": E.bfill(v)})


@query("ts_time_span", sql(f"""SELECT instrument, datetime, {rq('sum(value) OVER w', 4)} AS s, CAST(count(value) OVER w AS DOUBLE) AS n FROM ticks
    WINDOW w AS (PARTITION BY instrument ORDER BY epoch_us(datetime) RANGE BETWEEN 1799999999 PRECEDING AND CURRENT ROW)""", "ticks"))
def _(s, d):
    v = E.field("value")
    t = ticks(s, d)
    return rounded(features(Panel(t), {"s": E.sum_(v, "30min"), "n": E.count(v, "30min")}), n=4)


A, B = "TIMESTAMP '2024-01-05'", "TIMESTAMP '2024-01-06 12:00:00'"


@query("slice_aggregate", sql(f"""SELECT instrument, {rq('arg_max(value, datetime)')} AS "last", {rq('arg_min(value, datetime)')} AS "first",
    {rq('avg(value)')} AS mean FROM ticks WHERE datetime BETWEEN {A} AND {B} GROUP BY 1""", "ticks"))
def _(s, d):
    return rounded(R.slice_aggregate(ticks(s, d), "2024-01-05", "2024-01-06 12:00:00",
                                     {"last": ("value", "last"), "first": ("value", "first"), "mean": ("value", "mean")}))


@query("slice_callable", sql(f"""SELECT instrument, {rq('max(value) - min(value)')} AS spread FROM ticks
    WHERE datetime BETWEEN {A} AND {B} GROUP BY 1""", "ticks"))
def _(s, d):
    def spread(v: pd.Series) -> float:
        return float(v.max() - v.min())

    return rounded(R.slice_apply(ticks(s, d), "2024-01-05", "2024-01-06 12:00:00", "value",
                                 F.pandas_udf(spread, "double"), "spread"))


@query("session_resample", sql(f"""SELECT instrument, b AS datetime, {rq('arg_max(value, datetime)')} AS "last", count(*) AS n FROM
    (SELECT *, date_trunc('day', datetime) + to_minutes(CAST(CASE WHEN m < 780 THEN 570 + 30 * ((m - 570) // 30) ELSE 780 + 30 * ((m - 780) // 30) END AS INTEGER)) AS b
     FROM (SELECT *, hour(datetime) * 60 + minute(datetime) AS m FROM ticks) WHERE (m >= 570 AND m < 690) OR (m >= 780 AND m < 900)) GROUP BY 1, 2""", "ticks"))
def _(s, d):
    return rounded(R.session_resample(ticks(s, d), 30, {"last": ("value", "last"), "n": ("value", "count")}))


@query("fill_limited", sql(f"""SELECT instrument, datetime, {rq('CASE WHEN pos - last_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER x <= 2 THEN last_value(v IGNORE NULLS) OVER x END')} AS close
    FROM (SELECT *, CASE WHEN close > 25 THEN close END AS v, row_number() OVER (PARTITION BY instrument ORDER BY datetime) AS pos FROM bars_h) {W}""", "bars_h"))
def _(s, d):
    p = bars_h(s, d)
    holes = p.df.select("instrument", "datetime", F.when(F.col("close") > 25, F.col("close")).alias("close"))
    return rounded(R.fill_limit(Panel(holes), ["close"], 2))


@query("gap_counts", sql("""SELECT instrument, CAST(sum(CASE WHEN g > 3600000000 THEN g // 3600000000 - 1 ELSE 0 END) AS BIGINT) AS gaps FROM
    (SELECT instrument, epoch_us(datetime) - lag(epoch_us(datetime)) OVER (PARTITION BY instrument ORDER BY datetime) AS g FROM bars_h) GROUP BY 1""", "bars_h"))
def _(s, d):
    return R.gap_counts(bars_h(s, d), "1h")


@query("outlier_flags", sql("""SELECT instrument, datetime, coalesce(abs(close / p - 1) > 5, false) OR coalesce(n = 96 AND volume > m * 3, false) AS is_outlier FROM
    (SELECT *, lag(close) OVER (PARTITION BY instrument ORDER BY datetime) AS p, count(*) OVER w AS n, avg(volume) OVER w AS m FROM bars_h
     WINDOW w AS (PARTITION BY instrument ORDER BY datetime ROWS 95 PRECEDING))""", "bars_h"))
def _(s, d):
    return R.outlier_flags(bars_h(s, d), 5.0, 3.0).select("instrument", "datetime", "is_outlier")


@query("minute_sample", sql("""SELECT instrument, CAST(date_trunc('day', datetime) AS TIMESTAMP) AS datetime, close FROM bars_h
    WHERE strftime(datetime, '%H:%M') IN ('10:00', '14:00')""", "bars_h"))
def _(s, d):
    return R.sample_minutes(bars_h(s, d).df, ["10:00", "14:00"]).select("instrument", "datetime", "close")


@query("features_universe", sql(f"""SELECT f.* FROM (SELECT instrument, datetime, close, {rq('avg(close) OVER w5 / close')} AS rel_ma, {rq('lag(close) OVER w / close - 1')} AS back_ret
    FROM bars_d {W}) f SEMI JOIN universe u ON u.instrument = f.instrument AND f.datetime BETWEEN u."start" AND u."end"
    WHERE f.datetime BETWEEN TIMESTAMP '2024-01-04' AND TIMESTAMP '2024-01-25'""", "bars_d", "universe"))
def _(s, d):
    from strataline.queries.common import universe
    return rounded(features(bars_d(s, d), {"close": CL, "rel_ma": E.mean(CL, 5) / CL, "back_ret": E.ref(CL, 1) / CL - 1},
                            start="2024-01-04", end="2024-01-25", universe=universe(s, d)))
