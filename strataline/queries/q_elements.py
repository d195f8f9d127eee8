"""Element-wise operators, symbols, periods and session minutes."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataline.functions import symbols as SY
from strataline.functions import timeofday as T
from strataline.operators import calendars as C
from strataline.plans import expr as E
from strataline.plans.evaluate import features, on_instrument, Panel
from strataline.queries.common import bars_d, bars_h, query, r, rounded, rq, sql, table, ticks

O, H, L, CL, V = (E.field(n) for n in ("open", "high", "low", "close", "volume"))
D = E.sub(CL, 20.0)


@query("elem_unary", sql(f"""SELECT instrument, datetime, {rq('abs(close - 20)')} AS x_abs,
    {rq('sign(close - 20)')} AS x_sign,
    {rq("CASE WHEN close - 20 > 0 THEN ln(close - 20) WHEN close - 20 = 0 THEN '-infinity'::DOUBLE END")} AS x_log,
    NOT (close > 20) AS x_not FROM bars_h""", "bars_h"))
def _(s, d):
    return rounded(features(bars_h(s, d), {"x_abs": E.abs_(D), "x_sign": E.sign(D), "x_log": E.log(D),
                                           "x_not": ~(CL > 20)}))


@query("elem_arithmetic", sql(f"""SELECT instrument, datetime, {rq('open + close')} AS x_add, {rq('open - close')} AS x_sub,
    {rq('open * close', 4)} AS x_mul, {rq('CASE WHEN close <> open THEN open / (close - open) ELSE NULL END', 4)} AS x_div,
    {rq('CASE WHEN close >= 20 THEN pow(close - 20, 0.5) END')} AS x_pow, {rq('2 - close')} AS x_rsub,
    isinf(CASE WHEN close <> open THEN 1.0 ELSE 'infinity'::DOUBLE END) AS x_by_zero FROM bars_h""", "bars_h"))
def _(s, d):
    df = features(bars_h(s, d), {
        "x_add": O + CL, "x_sub": O - CL, "x_mul": O * CL, "x_div": O / (CL - O), "x_pow": D ** 0.5, "x_rsub": 2 - CL,
        "x_by_zero": E.is_inf(O / (CL - O))})
    df = df.withColumn("x_div", F.when(~F.col("x_by_zero"), F.col("x_div")))
    return df.select("instrument", "datetime", *[r(c).alias(c) for c in ("x_add", "x_sub", "x_pow", "x_rsub")],
                     *[r(c, 4).alias(c) for c in ("x_mul", "x_div")], "x_by_zero")


LAG = "lag(close) OVER (PARTITION BY instrument ORDER BY datetime)"


@query("elem_max_min", sql(f"""SELECT instrument, datetime, {rq('CASE WHEN p IS NOT NULL THEN greatest(close, p) END')} AS x_max,
    {rq('CASE WHEN p IS NOT NULL THEN least(close, p) END')} AS x_min FROM (SELECT *, {LAG} AS p FROM bars_h)""", "bars_h"))
def _(s, d):
    return rounded(features(bars_h(s, d), {"x_max": E.greater(CL, E.ref(CL, 1)), "x_min": E.less(CL, E.ref(CL, 1))}))


@query("elem_compare", sql(f"""SELECT instrument, datetime, coalesce(close > p, false) AS x_gt, coalesce(close >= p, false) AS x_ge,
    coalesce(close < p, false) AS x_lt, coalesce(close <= p, false) AS x_le, coalesce(close = p, false) AS x_eq,
    coalesce(close <> p, true) AS x_ne FROM (SELECT *, {LAG} AS p FROM bars_h)""", "bars_h"))
def _(s, d):
    p = E.ref(CL, 1)
    return features(bars_h(s, d), {"x_gt": CL > p, "x_ge": CL >= p, "x_lt": CL < p, "x_le": CL <= p,
                                   "x_eq": E.eq(CL, p), "x_ne": E.ne(CL, p)})


@query("elem_logic", sql(f"""SELECT instrument, datetime, (close > 20 AND open > 20) AS x_and, (close > 20 OR open > 20) AS x_or,
    {rq('CASE WHEN close > open THEN close ELSE open END')} AS x_if,
    {rq('CASE WHEN p IS NULL OR p <> 0 THEN close ELSE 0 END')} AS x_if_num FROM (SELECT *, {LAG} AS p FROM bars_h)""", "bars_h"))
def _(s, d):
    return rounded(features(bars_h(s, d), {
        "x_and": (CL > 20) & (O > 20), "x_or": (CL > 20) | (O > 20), "x_if": E.if_(CL > O, CL, O),
        "x_if_num": E.if_(E.ref(CL, 1), CL, 0.0)}))


@query("elem_null_inf_date", sql(f"""SELECT instrument, datetime, p IS NULL AS x_null, close = open AS x_inf,
    CAST(datetime AS DATE) AS x_date FROM (SELECT *, {LAG} AS p FROM bars_h)""", "bars_h"))
def _(s, d):
    return features(bars_h(s, d), {"x_null": E.is_null(E.ref(CL, 1)), "x_inf": E.is_inf(CL / (CL - O)), "x_date": E.date_of()})


@query("symbol_forms", """SELECT c_custkey, upper('sh' || code) AS prefixed, code || '.SH' AS suffixed,
    CASE WHEN seg = 'CON' THEN '_sym_CON' ELSE seg END AS escaped, seg AS unescaped
    FROM (SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS code,
                 CASE WHEN c_custkey % 3 = 0 THEN 'CON' ELSE upper(c_mktsegment) END AS seg FROM customer)""")
def _(s, d):
    c = table(s, d, "customer").select(
        "c_custkey", F.lpad(F.col("c_custkey").cast("string"), 6, "0").alias("code"),
        F.when(F.col("c_custkey") % 3 == 0, F.lit("CON")).otherwise(F.upper("c_mktsegment")).alias("seg"))
    pre = SY.suffix_to_prefix(F.concat("code", F.lit(".ss")))
    esc = SY.escape_reserved(F.col("seg"))
    return c.select("c_custkey", pre.alias("prefixed"), SY.prefix_to_suffix(F.concat("code", F.lit("sh"))).alias("suffixed"),
                    esc.alias("escaped"), SY.unescape_reserved(esc).alias("unescaped"))


@query("period_arithmetic", """SELECT o_orderkey, CAST(year(o_orderdate) * 100 + quarter(o_orderdate) AS INTEGER) AS period,
    CAST((year(o_orderdate) - 1992) * 4 + quarter(o_orderdate) - 1 AS BIGINT) AS offset_q,
    CAST((2010 * 4 + 1) - (year(o_orderdate) * 4 + quarter(o_orderdate) - 1) + 1 AS INTEGER) AS n_periods FROM orders""")
def _(s, d):
    p = T.quarter_of(F.col("o_orderdate"))
    return table(s, d, "orders").select(
        "o_orderkey", p.cast("int").alias("period"), T.period_offset(F.lit(1992), p, True).cast("bigint").alias("offset_q"),
        F.size(T.periods_between(p, F.lit(201002), True)).alias("n_periods"))


IDX = "SELECT datetime, row_number() OVER (ORDER BY datetime) - 1 AS idx FROM (SELECT DISTINCT datetime FROM bars_h)"


@query("calendar_slice", sql(f"""SELECT datetime, idx FROM ({IDX})
    WHERE datetime BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20 12:00:00'""", "bars_h"))
def _(s, d):
    cal = C.calendar_of(bars_h(s, d).df)
    return C.slice_calendar(cal, "2024-01-05", "2024-01-20 12:00:00")


@query("calendar_locate", sql(f"""SELECT min(datetime) FILTER (datetime >= TIMESTAMP '2024-01-05 00:30:00') AS "start",
    max(datetime) FILTER (datetime <= TIMESTAMP '2024-01-20 12:10:00') AS "end",
    min(idx) FILTER (datetime >= TIMESTAMP '2024-01-05 00:30:00') AS start_idx,
    max(idx) FILTER (datetime <= TIMESTAMP '2024-01-20 12:10:00') AS end_idx FROM ({IDX})""", "bars_h"))
def _(s, d):
    return C.locate(C.calendar_of(bars_h(s, d).df), "2024-01-05 00:30:00", "2024-01-20 12:10:00")


DAYS = "SELECT datetime, row_number() OVER (ORDER BY datetime) - 1 AS idx FROM (SELECT DISTINCT datetime FROM bars_d)"


@query("date_shift", sql(f"""SELECT instrument, a.datetime, c2.datetime AS shifted FROM bars_d a JOIN cal c ON c.datetime = a.datetime
    JOIN cal c2 ON c2.idx = greatest(0, least((SELECT max(idx) FROM cal), c.idx + 3))""", "bars_d", f"cal AS ({DAYS})"))
def _(s, d):
    b = bars_d(s, d).df
    return C.shift_dates(b.select("instrument", "datetime"), C.calendar_of(b), 3).select("instrument", "datetime", "shifted")


@query("date_shift_aligned", sql("""SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS datetime, c2.d AS shifted FROM
    (SELECT o_orderkey, o_orderdate, coalesce((SELECT max(i) FROM cal WHERE d <= o_orderdate), -1) AS i FROM orders) x
    LEFT JOIN cal c2 ON c2.i = greatest(0, least((SELECT max(i) FROM cal), x.i - 1))""",
    """cal AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i FROM (SELECT DISTINCT o_orderdate AS d FROM orders
       WHERE dayofweek(o_orderdate) BETWEEN 1 AND 5))"""))
def _(s, d):
    o = table(s, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("datetime"))
    cal = C.calendar_of(o.where(F.dayofweek("datetime").between(2, 6)))
    return C.shift_dates(o, cal, -1, align="left").select("o_orderkey", "datetime", "shifted")


@query("calendar_resample_week", """SELECT d AS datetime FROM (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i FROM
    (SELECT min(o_orderdate) AS d FROM orders GROUP BY date_trunc('week', o_orderdate))) WHERE i % 2 = 0""")
def _(s, d):
    o = table(s, d, "orders").select(F.col("o_orderdate").alias("datetime"))
    return C.resample_calendar(o, "week", 2)


@query("calendar_resample_month", """SELECT d AS datetime FROM (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i FROM
    (SELECT min(o_orderdate) AS d FROM orders GROUP BY date_trunc('month', o_orderdate))) WHERE i % 3 = 0""")
def _(s, d):
    o = table(s, d, "orders").select(F.col("o_orderdate").alias("datetime"))
    return C.resample_calendar(o, "month", 3)


MIN = "hour(ts) * 60 + minute(ts)"


@query("session_index", f"""SELECT event_id, CAST(CASE WHEN {MIN} >= 570 AND {MIN} < 690 THEN {MIN} - 570
    WHEN {MIN} >= 780 AND {MIN} < 900 THEN {MIN} - 660 END AS INTEGER) AS cn,
    CAST(CASE WHEN {MIN} >= 570 AND {MIN} < 960 THEN {MIN} - 570 END AS INTEGER) AS us,
    CAST(CASE WHEN {MIN} >= 540 AND {MIN} < 810 THEN {MIN} - 540 END AS INTEGER) AS tw FROM events""")
def _(s, d):
    t = F.col("ts")
    return table(s, d, "events").select("event_id", *[T.session_index(t, g).alias(g) for g in ("cn", "us", "tw")])


@query("session_bucket", f"""SELECT event_id, date_trunc('day', ts) + to_minutes(CAST(CASE WHEN m < 570 THEN 885
    WHEN m < 780 THEN least(570 + 15 * ((m - 570) // 15), 675) ELSE least(780 + 15 * ((m - 780) // 15), 885) END AS INTEGER)) AS bar
    FROM (SELECT event_id, ts, {MIN} AS m FROM events)""")
def _(s, d):
    return table(s, d, "events").select("event_id", T.session_bucket(F.col("ts"), 15, "cn").alias("bar"))


@query("minute_calendar", """SELECT DISTINCT d + to_minutes(CAST(m AS INTEGER)) AS datetime FROM
    (SELECT DISTINCT CAST(date_trunc('day', ts) AS TIMESTAMP) AS d FROM events), (SELECT unnest(range(570, 690, 5)) AS m
    UNION ALL SELECT unnest(range(780, 900, 5)))""")
def _(s, d):
    days = ticks(s, d).select(F.date_trunc("day", "datetime").alias("datetime")).distinct()
    return C.minutes_from_days(days, 5)


@query("calendar_participation", sql("""SELECT datetime, n, listed FROM (SELECT datetime, count(*) AS n FROM bars_d GROUP BY 1) a
    JOIN (SELECT datetime AS dt, (SELECT count(*) FROM (SELECT min(datetime) AS f FROM bars_d GROUP BY instrument)
          WHERE f <= x.datetime) AS listed FROM (SELECT DISTINCT datetime FROM bars_d) x) b ON a.datetime = b.dt
    WHERE n >= greatest(floor(listed * 0.88), 10)""", "bars_d"))
def _(s, d):
    return C.calendar_by_participation(bars_d(s, d).df, threshold=0.88)


@query("minutes_of_day_range", f"""SELECT event_id, ({MIN}) AS m FROM events
    WHERE ({MIN} BETWEEN 585 AND 689) OR ({MIN} BETWEEN 780 AND 849)""")
def _(s, d):
    lo, hi = T.index_range("9:45", "14:09", 1, "cn")
    t = F.col("ts")
    i = T.session_index(t, "cn")
    return table(s, d, "events").where(i.between(lo, hi)).select("event_id", T.minute_of_day(t).cast("bigint").alias("m"))


@query("instrument_reference", sql(f"""SELECT a.instrument, a.datetime, {rq('a.close - b.m')} AS diff FROM bars_h a
    LEFT JOIN (SELECT datetime, avg(close) OVER (ORDER BY datetime ROWS 4 PRECEDING) AS m FROM bars_h WHERE instrument = 'click') b
    ON a.datetime = b.datetime""", "bars_h"))
def _(s, d):
    p = on_instrument(bars_h(s, d), "click", {"bench": E.mean(CL, 5)})
    return rounded(features(p, {"diff": CL - E.field("bench")}))
