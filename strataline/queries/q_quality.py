"""Raw-data normalisation and quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataline.operators import calendars as C
from strataline.operators import quality as Q
from strataline.plans.evaluate import Panel
from strataline.queries.common import bars_d, bars_h, query, r, rounded, rq, sql, supp_m, table, ticks

WI = "WINDOW w AS (PARTITION BY instrument ORDER BY datetime), x AS (PARTITION BY instrument ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def _holes(s, d):
    b = bars_d(s, d, in_order=True)
    return b.df.withColumn("volume", F.when(F.col("volume") % 9 < 1, 0.0).otherwise(F.col("volume")))


HOLES = "holes AS (SELECT instrument, datetime, open, high, low, close, vwap, CASE WHEN volume % 9 < 1 THEN 0.0 ELSE volume END AS volume FROM bars_d)"
DENSE = """dense AS (SELECT l.instrument, c.datetime, CASE WHEN volume > 0 THEN close END AS close, CASE WHEN volume > 0 THEN volume END AS volume FROM
    (SELECT instrument, min(datetime) AS a, max(datetime) AS z FROM holes GROUP BY 1) l JOIN (SELECT DISTINCT datetime FROM holes) c ON c.datetime BETWEEN l.a AND l.z
    LEFT JOIN holes b ON b.instrument = l.instrument AND b.datetime = c.datetime)"""


@query("align_blank_change", sql(f"""SELECT instrument, datetime, close, volume, {rq('CASE WHEN prev <> 0 THEN cur / prev - 1 END', 5)} AS change FROM
    (SELECT *, lag(cur) OVER w AS prev FROM (SELECT *, last_value(close IGNORE NULLS) OVER x AS cur FROM dense {WI}) {WI})""", "bars_d", HOLES, DENSE))
def _(s, d):
    h = _holes(s, d).select("instrument", "datetime", "close", "volume")
    df = Q.with_change(Panel(Q.blank_untraded(Q.align_bars(h, C.calendar_of(h)))))
    return df.withColumn("change", r("change", 5))


def _glitchy(s, d, months=(6, 7)):
    m = supp_m(s, d)
    bad = F.month("datetime").isin(*months)
    return Panel(m.df.withColumn("close", F.when(bad, F.col("close") * 100).otherwise(F.col("close"))))


def repair_sql(passes=3, months="6, 7"):
    ctes = [f"g0 AS (SELECT instrument, datetime, volume, CASE WHEN month(datetime) IN ({months}) THEN close * 100 ELSE close END AS close FROM supp_m)"]
    for i in range(passes):
        ctes.append(f"g{i + 1} AS (SELECT instrument, datetime, volume, CASE WHEN close / lag(close) OVER (PARTITION BY instrument ORDER BY datetime) - 1 BETWEEN 89 AND 111 THEN close / 100 ELSE close END AS close FROM g{i})")
    return sql(f"SELECT instrument, datetime, {rq('close')} AS close, volume FROM g{passes}", "supp_m", *ctes)


@query("repair_units", repair_sql())
def _(s, d):
    df = Q.repair_units(_glitchy(s, d))
    return df.select("instrument", "datetime", r("close").alias("close"), "volume")


@query("repair_units_long_runs", repair_sql(10, "2, 3, 4, 5, 6, 7, 8, 9, 10"))
def _(s, d):
    df = Q.repair_units(_glitchy(s, d, range(2, 11)))
    return df.select("instrument", "datetime", r("close").alias("close"), "volume")


@query("normalise_bars", sql(f"""SELECT instrument, datetime, close, volume, {rq('CASE WHEN close IS NOT NULL AND prev <> 0 THEN cur / prev - 1 END', 5)} AS change FROM
    (SELECT *, lag(cur) OVER w AS prev FROM (SELECT *, last_value(close IGNORE NULLS) OVER x AS cur FROM dense {WI}) {WI})""", "bars_d",
    "holes AS (SELECT instrument, datetime, 50 + close / 10 AS close, CASE WHEN volume % 9 < 1 THEN 0.0 ELSE volume END AS volume FROM bars_d)", DENSE))
def _(s, d):
    h = _holes(s, d).select("instrument", "datetime", (50 + F.col("close") / 10).alias("close"), "volume")
    df = Q.normalise_bars(h, C.calendar_of(h))
    return df.select("instrument", "datetime", "close", "volume", r("change", 5).alias("change"))


@query("adjust_prices", sql(f"""SELECT instrument, datetime, {rq('open * f', 5)} AS "open", {rq('volume / f', 4)} AS volume, {rq('f', 5)} AS factor FROM
    (SELECT *, last_value(CASE WHEN volume % 4 >= 1 THEN vwap / close END IGNORE NULLS) OVER x AS f FROM bars_d {WI}) WHERE close > 1""", "bars_d"))
def _(s, d):
    b = bars_d(s, d, in_order=True)
    df = b.df.withColumns({"adjclose": F.when(F.col("volume") % 4 >= 1, F.col("vwap")), "c0": F.col("close")})
    out = Q.adjust_prices(Panel(df))
    return out.where("c0 > 1").select("instrument", "datetime", r("open", 5).alias("open"), r("volume", 4).alias("volume"), r("factor", 5).alias("factor"))


@query("rebase_first_close", sql(f"""SELECT instrument, datetime, {rq('close / c0', 5)} AS close, {rq('volume * c0', 4)} AS volume FROM
    (SELECT *, first_value(close) OVER x AS c0 FROM bars_d {WI})""", "bars_d"))
def _(s, d):
    df = Q.rebase_first_close(bars_d(s, d).df.select("instrument", "datetime", "close", "volume"))
    return df.select("instrument", "datetime", r("close", 5).alias("close"), r("volume", 4).alias("volume"))


@query("continue_from", sql(f"""SELECT n.instrument, n.datetime, {rq('n.close * 3 * o.close / (a.close * 3)', 5)} AS close FROM bars_d n JOIN
    (SELECT instrument, max(datetime) AS d, arg_max(close, datetime) AS close FROM bars_d WHERE datetime <= TIMESTAMP '2024-01-15' GROUP BY 1) o ON o.instrument = n.instrument
    JOIN bars_d a ON a.instrument = n.instrument AND a.datetime = o.d WHERE n.datetime > o.d""", "bars_d"))
def _(s, d):
    b = bars_d(s, d).df.select("instrument", "datetime", "close")
    old = b.where("datetime <= timestamp_ntz'2024-01-15'")
    new = b.join(old.select("instrument").distinct(), "instrument", "left_semi").withColumn("close", F.col("close") * 3)
    return rounded(Q.continue_from(old, new, ["close"]), n=5)


DAY = "day AS (SELECT event_type AS instrument, CAST(date_trunc('day', ts) AS TIMESTAMP) AS datetime, avg(value) AS close, sum(value) - 500 AS volume FROM events GROUP BY 1, 2)"


def _daily(s, d):
    t = ticks(s, d)
    return t.groupBy("instrument", F.date_trunc("day", "datetime").cast("timestamp_ntz").alias("datetime")).agg(
        F.avg("value").alias("close"), (F.sum("value") - 500).alias("volume"))


@query("minute_adjust", sql(f"""SELECT h.instrument, h.datetime, {rq('h.close * f', 5)} AS close, {rq('CASE WHEN f <> 0 THEN h.volume / f END', 4)} AS volume, {rq('f')} AS factor,
    CASE WHEN d.volume > 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS paused FROM (SELECT *, CAST(datetime AS DATE) AS dt, last_value(close) OVER
    (PARTITION BY instrument, CAST(datetime AS DATE) ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lc FROM bars_h) h
    JOIN day d ON d.instrument = h.instrument AND CAST(d.datetime AS DATE) = h.dt, LATERAL (SELECT d.close / h.lc AS f)""", "bars_h", DAY))
def _(s, d):
    m = bars_h(s, d).df.select("instrument", "datetime", "close", "volume")
    out = Q.minute_adjust(m, _daily(s, d))
    return out.select("instrument", "datetime", r("close", 5).alias("close"), r("volume", 4).alias("volume"), r("factor").alias("factor"), "paused")


@query("paused_numbers", sql("""SELECT m.instrument, m.datetime, k.paused, k.paused_num FROM uh m JOIN
    (SELECT instrument, dt, CAST(p AS INTEGER) AS paused, CASE WHEN p THEN 0 ELSE pos - coalesce(max(CASE WHEN p THEN pos END) OVER x, 0) END AS paused_num,
       min(CASE WHEN NOT p THEN dt END) OVER (PARTITION BY instrument) AS a, max(CASE WHEN NOT p THEN dt END) OVER (PARTITION BY instrument) AS z FROM
      (SELECT instrument, dt, bool_and(volume = 0) AS p, row_number() OVER (PARTITION BY instrument ORDER BY dt) AS pos FROM uh GROUP BY 1, 2)
      WINDOW x AS (PARTITION BY instrument ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) k
    ON k.instrument = m.instrument AND k.dt = m.dt WHERE k.dt BETWEEN k.a AND k.z""",
    """uh AS (SELECT CAST(user_id AS VARCHAR) AS instrument, ts AS datetime, CAST(ts AS DATE) AS dt, value AS close, CASE WHEN (day(ts) + user_id) % 5 = 0 THEN 0.0 ELSE value END AS volume FROM events)"""))
def _(s, d):
    t = table(s, d, "events").select(F.col("user_id").cast("string").alias("instrument"), F.col("ts").alias("datetime"), F.col("value").alias("close"),
                                     F.when((F.dayofmonth("ts") + F.col("user_id")) % 5 == 0, 0.0).otherwise(F.col("value")).alias("volume"))
    return Q.paused_numbers(t, ["close", "volume"]).select("instrument", "datetime", "paused", "paused_num")


@query("publish_dates", """SELECT o_orderkey, CAST(year(o_orderdate) * 100 + quarter(o_orderdate) AS INTEGER) AS period,
    CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) + 45 ELSE CAST(o_orderdate AS DATE) + 7 END AS date FROM orders""")
def _(s, d):
    o = table(s, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("period"))
    raw = o.withColumn("date", F.when(F.col("o_orderkey") % 3 != 0, F.date_add("period", 7)))
    return Q.publish_dates(raw)


@query("missing_minutes", sql("""SELECT b.instrument, CAST(date_trunc('day', b.datetime) AS TIMESTAMP) + to_minutes(CAST(m AS INTEGER)) AS datetime, 0.0::DOUBLE AS paused_num FROM bars_d b,
    (SELECT unnest(range(570, 690, 30)) AS m UNION ALL SELECT unnest(range(780, 900, 30))) WHERE CAST(b.instrument AS INTEGER) % 10 = 3""", "bars_d"))
def _(s, d):
    b = bars_d(s, d).df.select("instrument", "datetime")
    return Q.missing_minutes(b, b.where(F.col("instrument").cast("int") % 10 != 3), 30)


@query("five_minute_bars", sql(f"""SELECT instrument, datetime, {rq('close * (dc / lc)', 5)} AS close, {rq('CASE WHEN prev <> 0 THEN cur / prev - 1 END', 5)} AS change FROM
    (SELECT *, lag(cur) OVER w AS prev, last_value(close IGNORE NULLS) OVER (PARTITION BY instrument, CAST(datetime AS DATE) ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lc FROM
     (SELECT g.*, v.close, d.close AS dc, last_value(v.close IGNORE NULLS) OVER (PARTITION BY g.instrument ORDER BY g.datetime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cur FROM
      (SELECT l.instrument, c.datetime FROM (SELECT instrument, min(datetime) AS a, max(datetime) AS z FROM five GROUP BY 1) l JOIN
        (SELECT DISTINCT x.datetime + to_minutes(CAST(m AS INTEGER)) AS datetime FROM day x, (SELECT unnest(range(570, 690, 5)) AS m UNION ALL SELECT unnest(range(780, 900, 5)))) c ON c.datetime BETWEEN l.a AND l.z) g
      LEFT JOIN (SELECT * FROM five WHERE volume > 0) v ON v.instrument = g.instrument AND v.datetime = g.datetime
      LEFT JOIN day d ON d.instrument = g.instrument AND CAST(d.datetime AS DATE) = CAST(g.datetime AS DATE)) WINDOW w AS (PARTITION BY instrument ORDER BY datetime))""", DAY,
    """five AS (SELECT event_type AS instrument, time_bucket(INTERVAL 5 MINUTE, ts) AS datetime, arg_max(value, ts) AS close, sum(value) AS volume FROM events
       WHERE (hour(ts) * 60 + minute(ts) >= 570 AND hour(ts) * 60 + minute(ts) < 690) OR (hour(ts) * 60 + minute(ts) >= 780 AND hour(ts) * 60 + minute(ts) < 900) GROUP BY 1, 2)"""))
def _(s, d):
    from strataline.operators.resample import session_resample
    five = session_resample(ticks(s, d), 5, {"close": ("value", "last"), "volume": ("value", "sum")})
    out = Q.five_minute_bars(five, _daily(s, d))
    return out.select("instrument", "datetime", r("close", 5).alias("close"), r("change", 5).alias("change"))


@query("fill_both_ways", sql(f"""SELECT instrument, datetime, coalesce(last_value(v IGNORE NULLS) OVER x, first_value(v IGNORE NULLS) OVER
    (PARTITION BY instrument ORDER BY datetime ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM (SELECT *, CASE WHEN close > 30 THEN close END AS v FROM bars_h) {WI}""", "bars_h"))
def _(s, d):
    b = bars_h(s, d)
    return Q.fill_both_ways(Panel(b.df.select("instrument", "datetime", F.when(F.col("close") > 30, F.col("close")).alias("v"))), ["v"])


@query("health_missing", sql("""SELECT instrument, count(*) FILTER (close <= 20) AS close, count(*) FILTER (volume <= 40) AS volume FROM bars_d GROUP BY 1
    HAVING count(*) FILTER (close <= 20) > 8 OR count(*) FILTER (volume <= 40) > 8""", "bars_d"))
def _(s, d):
    b = bars_d(s, d).df.select("instrument", *[F.when(F.col(c) > k, F.col(c)).alias(c) for c, k in (("close", 20), ("volume", 40))])
    return Q.missing_counts(b, ["close", "volume"], 8)


@query("health_large_steps", sql(f"""SELECT instrument, col_name, {rq('max(v)', 4)} AS pct_change, min(CASE WHEN v > lim THEN CAST(datetime AS DATE) END) AS date FROM
    (SELECT instrument, datetime, 'close' AS col_name, abs(close / lag(close) OVER w - 1) AS v, 2.0 AS lim FROM bars_h WINDOW w AS (PARTITION BY instrument ORDER BY datetime)
     UNION ALL SELECT instrument, datetime, 'volume', abs(volume / lag(volume) OVER w - 1), 3.0 FROM bars_h WINDOW w AS (PARTITION BY instrument ORDER BY datetime)) GROUP BY 1, 2 HAVING max(v) > max(lim)""", "bars_h"))
def _(s, d):
    b = bars_h(s, d)
    return rounded(Q.large_steps(Panel(b.df.select("instrument", "datetime", "close", "volume")), 2.0, 3.0), n=4)


@query("health_missing_factor", sql("SELECT DISTINCT instrument, false AS column_missing, true AS data_missing FROM bars_d WHERE CAST(instrument AS INTEGER) % 7 = 0", "bars_d"))
def _(s, d):
    b = bars_d(s, d).df.withColumn("factor", F.when(F.col("instrument").cast("int") % 7 != 0, 1.0))
    return Q.missing_factor(b)


@query("invalid_bars", sql("""SELECT instrument, datetime, list_filter([CASE WHEN close2 IS NULL THEN 'nan_values' END, CASE WHEN high < low + 5 THEN 'high_low_invalid' END,
    CASE WHEN NOT coalesce(open BETWEEN low + 5 AND high, false) THEN 'open_range_invalid' END, CASE WHEN NOT coalesce(close2 BETWEEN low + 5 AND high, false) THEN 'close_range_invalid' END,
    CASE WHEN volume - 10 < 0 THEN 'negative_volume' END], lambda x: x IS NOT NULL) AS errors FROM (SELECT *, CASE WHEN volume % 6 >= 1 THEN close END AS close2 FROM bars_d)
    WHERE close2 IS NULL OR high < low + 5 OR NOT coalesce(open BETWEEN low + 5 AND high, false) OR NOT coalesce(close2 BETWEEN low + 5 AND high, false) OR volume - 10 < 0""", "bars_d"))
def _(s, d):
    b = bars_d(s, d, in_order=True).df.withColumns({"close": F.when(F.col("volume") % 6 >= 1, F.col("close")), "low": F.col("low") + 5, "volume": F.col("volume") - 10})
    return Q.invalid_bars(b).select("instrument", "datetime", "errors")


@query("feature_report", sql("""SELECT 'close' AS "column", false AS constant, (SELECT avg(CAST(close <= 20 AS DOUBLE)) > 0.05 FROM bars_d) AS high_null, false AS infinite
    UNION ALL SELECT 'one', true, false, false UNION ALL SELECT 'inf', false, false, true""", "bars_d"))
def _(s, d):
    b = bars_d(s, d).df.select(F.when(F.col("close") > 20, F.col("close")).alias("close"), F.lit(1.0).alias("one"),
                               F.when(F.col("close") > 20, F.lit(float("inf"))).otherwise(F.col("close")).alias("inf"))
    return Q.feature_report(b, ["close", "one", "inf"])


@query("missing_gate", sql("SELECT instrument, datetime, close FROM bars_d", "bars_d"))
def _(s, d):
    b = bars_d(s, d).df.select("instrument", "datetime", "close")
    return Q.require_present(b, ["close"], 0.1)


@query("compare_panels", sql("""SELECT instrument, count(*) FILTER (day(datetime) = 5) AS only_stored, count(*) FILTER (day(datetime) = 9) AS only_raw, count(*) FILTER (day(datetime) = 12) AS mismatched
    FROM bars_d GROUP BY 1""", "bars_d"))
def _(s, d):
    b = bars_d(s, d).df.select("instrument", "datetime", "close")
    stored = b.where(F.dayofmonth("datetime") != 9).withColumn("close", F.when(F.dayofmonth("datetime") == 12, F.col("close") * 1.01 + 1).otherwise(F.col("close")))
    return Q.compare_panels(b.where(F.dayofmonth("datetime") != 5), stored, ["close"])
