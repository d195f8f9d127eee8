"""Universe spans, filters, segments and calendar alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataline.operators import calendars as C
from strataline.operators import filters as FL
from strataline.plans import expr as E
from strataline.plans.evaluate import Panel, features, in_spans
from strataline.queries.common import bars_d, bars_h, query, r, rounded, rq, scores, sql, ticks, universe

CL = E.field("close")
A, B = "2024-01-08", "2024-01-22"
TA, TB = f"TIMESTAMP '{A}'", f"TIMESTAMP '{B}'"


@query("universe_clip", sql(f"""SELECT instrument, greatest("start", {TA}) AS "start", least("end", {TB}) AS "end" FROM universe
    WHERE greatest("start", {TA}) <= least("end", {TB})""", "universe"))
def _(s, d):
    return FL.clip_spans(universe(s, d), A, B)


@query("universe_mask", sql("""SELECT b.instrument, b.datetime, b.close FROM bars_d b JOIN universe u
    ON u.instrument = b.instrument AND b.datetime BETWEEN u."start" AND u."end" """, "bars_d", "universe"))
def _(s, d):
    return in_spans(bars_d(s, d).df.select("instrument", "datetime", "close"), universe(s, d))


@query("time_range", sql(f"""SELECT instrument, datetime, {rq('m')} AS m FROM (SELECT *, avg(close) OVER (PARTITION BY instrument ORDER BY datetime ROWS 4 PRECEDING) AS m
    FROM bars_d) WHERE datetime BETWEEN {TA} AND {TB}""", "bars_d"))
def _(s, d):
    return rounded(features(bars_d(s, d), {"m": E.mean(CL, 5)}, start=A, end=B))


DAYCAL = "cal AS (SELECT datetime, row_number() OVER (ORDER BY datetime) - 1 AS idx FROM (SELECT DISTINCT datetime FROM bars_d))"
GRID = """grid AS (SELECT u.instrument, c.datetime, c.idx FROM universe u JOIN cal c ON c.datetime BETWEEN u."start" AND u."end")"""


def islands(flag):
    return f"""SELECT instrument, min(datetime) AS "start", max(datetime) AS "end" FROM (SELECT *, idx - row_number() OVER
        (PARTITION BY instrument ORDER BY idx) AS run FROM ({flag}) WHERE flag) GROUP BY instrument, run"""


@query("filter_name", sql(islands(f"""SELECT *, regexp_matches(instrument, '^(?:1[0-4])') OR datetime < {TA} AS flag FROM grid"""),
                          "bars_d", "universe", DAYCAL, GRID))
def _(s, d):
    return FL.filter_by_name(universe(s, d), C.calendar_of(bars_d(s, d).df), "1[0-4]", fstart=A)


RULE = """rules AS (SELECT instrument, datetime, coalesce(close > lag(close) OVER (PARTITION BY instrument ORDER BY datetime), false) AS rule FROM bars_d)"""


@query("filter_rule", sql(islands(f"""SELECT g.*, coalesce(rule, false) OR g.datetime > {TB} AS flag FROM grid g LEFT JOIN rules r
    ON r.instrument = g.instrument AND r.datetime = g.datetime"""), "bars_d", "universe", DAYCAL, GRID, RULE))
def _(s, d):
    b = bars_d(s, d)
    return FL.filter_by_rule(universe(s, d), C.calendar_of(b.df), b, CL > E.ref(CL, 1), fend=B)


@query("filter_chain", sql(islands(f"""SELECT x.*, coalesce(rule, false) AS flag FROM (SELECT *, idx AS i2 FROM grid WHERE regexp_matches(instrument, '^(?:[1-5])')) x
    LEFT JOIN rules r ON r.instrument = x.instrument AND r.datetime = x.datetime"""), "bars_d", "universe", DAYCAL, GRID, RULE))
def _(s, d):
    b = bars_d(s, d)
    cal = C.calendar_of(b.df)
    return FL.filter_chain(universe(s, d), [lambda u: FL.filter_by_name(u, cal, "[1-5]"),
                                            lambda u: FL.filter_by_rule(u, cal, b, CL > E.ref(CL, 1))])


@query("spans_from_flags", sql(islands("SELECT b.instrument, b.datetime, c.idx, close > 20 AS flag FROM bars_d b JOIN cal c ON c.datetime = b.datetime"),
                               "bars_d", DAYCAL))
def _(s, d):
    b = bars_d(s, d).df
    return FL.spans_from_flags(b.join(C.calendar_of(b), "datetime").withColumn("flag", F.col("close") > 20), "flag")


@query("full_history_only", sql(f"""SELECT instrument, datetime, close FROM bars_d WHERE instrument IN
    (SELECT instrument FROM bars_d GROUP BY 1 HAVING min(datetime) <= TIMESTAMP '2024-01-02' AND max(datetime) >= TIMESTAMP '2024-01-29')""", "bars_d"))
def _(s, d):
    return FL.full_history(bars_d(s, d).df, "2024-01-02", "2024-01-29").select("instrument", "datetime", "close")


@query("drop_missing_label", sql(f"SELECT instrument, datetime, {rq('score')} AS score, {rq('label', 5)} AS label FROM scores WHERE label IS NOT NULL",
                                 "bars_d", "lagged_d", "scores"))
def _(s, d):
    df = FL.drop_missing(scores(s, d), ["label"])
    return df.select("instrument", "datetime", r("score").alias("score"), r("label", 5).alias("label"))


@query("column_filters", sql('SELECT instrument, datetime, "open", "close" FROM bars_d', "bars_d"))
def _(s, d):
    df = FL.drop_columns(bars_d(s, d).df, ["volume", "vwap"])
    return FL.keep_columns(df, ["open", "high", "low", "close"], ["open", "close"])


@query("index_selection", sql(f"""SELECT instrument, datetime, close FROM bars_d WHERE instrument IN ('1', '17', '42')
    AND datetime BETWEEN {TA} AND {TB}""", "bars_d"))
def _(s, d):
    return FL.select_time(bars_d(s, d).df, start=A, end=B, instruments=["1", "17", "42"]).select("instrument", "datetime", "close")


@query("trailing_dates", sql(f"""SELECT instrument, datetime, close FROM bars_d WHERE datetime IN
    (SELECT DISTINCT datetime FROM bars_d WHERE datetime <= {TB} ORDER BY datetime DESC LIMIT 5)""", "bars_d"))
def _(s, d):
    return FL.trailing_dates(bars_d(s, d).df, B, 5).select("instrument", "datetime", "close")


@query("segments", sql(f"""SELECT instrument, datetime, close, CASE WHEN datetime <= TIMESTAMP '2024-01-15' THEN 'train'
    WHEN datetime <= {TB} THEN 'valid' ELSE 'test' END AS segment FROM bars_d WHERE datetime <= TIMESTAMP '2024-01-28'""", "bars_d"))
def _(s, d):
    return FL.with_segment(bars_d(s, d).df, {"train": (None, "2024-01-15"), "valid": ("2024-01-16", B), "test": ("2024-01-23", "2024-01-28")}) \
        .select("instrument", "datetime", "close", "segment")


@query("split_predictions", sql("""SELECT instrument, datetime, close, datetime <= TIMESTAMP '2024-01-10' AS by_date,
    dense_rank() OVER (ORDER BY datetime) <= 7 AS by_count FROM bars_d""", "bars_d"))
def _(s, d):
    b = bars_d(s, d).df.select("instrument", "datetime", "close")
    left, right = FL.split_by_date(b, "2024-01-10")
    a = left.withColumn("by_date", F.lit(True)).unionByName(right.withColumn("by_date", F.lit(False)))
    first, rest = FL.split_by_count(a, 7)
    return first.withColumn("by_count", F.lit(True)).unionByName(rest.withColumn("by_count", F.lit(False)))


def _with_change(s, d):
    b = bars_h(s, d)
    hole = F.col("volume") % 7 < 1
    return Panel(features(b, {"close": CL, "volume": E.field("volume"), "change": CL / E.ref(CL, 1) - 1})
                 .withColumn("close", F.when(~hole, F.col("close"))))


CHG = """chg AS (SELECT instrument, datetime, CASE WHEN volume % 7 >= 1 THEN close END AS close,
    close / lag(close) OVER (PARTITION BY instrument ORDER BY datetime) - 1 AS change FROM bars_h)"""
LIMITS = "lim AS (SELECT instrument, datetime, close IS NULL OR coalesce(change >= 0.5, false) AS limit_buy, close IS NULL OR coalesce(change <= -0.5, false) AS limit_sell FROM chg)"


@query("tradability", sql("SELECT * FROM lim", "bars_h", CHG, LIMITS))
def _(s, d):
    return FL.tradability(_with_change(s, d), threshold=0.5).select("instrument", "datetime", "limit_buy", "limit_sell")


@query("tradability_coarse", sql("""SELECT instrument, time_bucket(INTERVAL 4 HOUR, datetime) AS datetime, bool_and(limit_buy) AS limit_buy,
    bool_and(limit_sell) AS limit_sell FROM lim GROUP BY 1, 2""", "bars_h", CHG, LIMITS))
def _(s, d):
    return FL.tradability_over(FL.tradability(_with_change(s, d), threshold=0.5), "4 hours")


@query("select_rows", sql(f"""SELECT instrument, datetime, {rq('m')} AS m FROM (SELECT *, avg(close) OVER
    (PARTITION BY instrument ORDER BY datetime ROWS 4 PRECEDING) AS m FROM bars_h) WHERE close > 20""", "bars_h"))
def _(s, d):
    return rounded(features(bars_h(s, d), {"m": E.mean(CL, 5)}, keep_rows=CL > 20))


@query("densify_calendar", sql("""SELECT l.instrument, c.datetime, b.close FROM (SELECT instrument, min(datetime) AS a, max(datetime) AS z FROM bars_d GROUP BY 1) l
    JOIN (SELECT DISTINCT datetime FROM bars_d) c ON c.datetime BETWEEN l.a AND l.z
    LEFT JOIN bars_d b ON b.instrument = l.instrument AND b.datetime = c.datetime""", "bars_d"))
def _(s, d):
    b = bars_d(s, d).df.select("instrument", "datetime", "close")
    return C.densify(b, C.calendar_of(b))


@query("market_hours", sql("""SELECT instrument, datetime, value FROM ticks WHERE CAST(datetime AS TIME) BETWEEN TIME '09:15:00' AND TIME '11:30:00'
    OR CAST(datetime AS TIME) BETWEEN TIME '13:00:00' AND TIME '15:00:00'""", "ticks"))
def _(s, d):
    from strataline.sources.panels import market_hours
    return market_hours(ticks(s, d))
