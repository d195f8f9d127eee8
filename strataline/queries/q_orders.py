"""Order sizing, schedules and execution metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataline.operators import calendars as C
from strataline.operators import orders as O
from strataline.queries.common import bars_h, query, r, rounded, rq, sql, supp_m, table

ORD = """fl AS (SELECT l_orderkey * 100000 + l_suppkey AS order_id, CAST(l_suppkey AS VARCHAR) AS instrument, CAST(any_value(l_orderkey) % 2 AS INTEGER) AS direction, sum(l_quantity) AS amount, sum(l_quantity * (1 - l_discount)) AS deal,
    sum(l_extendedprice) / sum(l_quantity) AS price, date_trunc('month', min(l_shipdate)) AS sm FROM lineitem GROUP BY l_orderkey, l_suppkey)"""


def _orders(s, d):
    # dealt by order_id, so that joins and sums by it need no further exchange
    rows = table(s, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_discount", "l_extendedprice", "l_shipdate",
                                          (F.col("l_orderkey") * 100000 + F.col("l_suppkey")).alias("order_id"))
    g = rows.repartition("order_id").groupBy("order_id", "l_orderkey", "l_suppkey").agg(
        F.sum("l_quantity").alias("amount"), F.sum(F.col("l_quantity") * (1 - F.col("l_discount"))).alias("deal"),
        (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("price"), F.date_trunc("month", F.min("l_shipdate")).cast("timestamp_ntz").alias("start"))
    return g.select("order_id", F.col("l_suppkey").cast("string").alias("instrument"),
                    (F.col("l_orderkey") % 2).cast("int").alias("direction"), "amount", "deal", "price", "start",
                    F.add_months("start", 2).cast("timestamp_ntz").alias("end"))


def _metrics(s, d, method):
    o = _orders(s, d)
    fills = o.select("order_id", F.col("deal").alias("deal_amount"), F.col("price").alias("trade_price"), (F.col("deal") * F.col("price") * 0.001).alias("trade_cost"))
    quotes = supp_m(s, d).df.select("instrument", "datetime", F.col("close").alias("price"), "volume")
    m = O.order_metrics(fills, o.drop("deal", "price"), quotes, method, unit="month")
    return m.withColumn("pa", F.round("pa", 9))  # orders dealt exactly at the base price


def metrics_cte(method):
    w = "m.volume" if method == "vwap" else "1.0"
    return f"""mt AS (SELECT f.*, b.bp, CASE WHEN amount <> 0 THEN deal / amount END AS ffr, deal * price * (CASE WHEN direction = 1 THEN 1 ELSE -1 END) AS tv, round((1 - 2 * direction) * (price / bp - 1), 9) AS pa FROM fl f LEFT JOIN
        (SELECT f.order_id, sum(m.close * {w}) / sum({w}) AS bp FROM fl f JOIN supp_m m ON m.instrument = f.instrument AND m.datetime BETWEEN f.sm AND f.sm + INTERVAL 2 MONTH GROUP BY 1) b USING (order_id))"""


@query("order_metrics", sql(f"SELECT order_id, instrument, direction, amount, {rq('deal', 4)} AS deal_amount, {rq('ffr')} AS ffr, {rq('tv', 2)} AS trade_value, {rq('bp', 4)} AS base_price, {rq('pa')} AS pa FROM mt", "supp_m", ORD, metrics_cte("vwap")))
def _(s, d):
    m = _metrics(s, d, "vwap")
    return m.select("order_id", "instrument", "direction", "amount", r("deal_amount", 4).alias("deal_amount"), r("ffr").alias("ffr"), r("trade_value", 2).alias("trade_value"),
                    r("base_price", 4).alias("base_price"), r("pa").alias("pa"))


STEP = """sp AS (SELECT CAST(sm AS TIMESTAMP) AS datetime, sum(ffr * abs(deal)) / sum(abs(deal)) AS ffr, sum(pa * abs(deal)) / sum(abs(deal)) AS pa, count(*) FILTER (pa > 0) / CAST(count(pa) AS DOUBLE) AS pos, sum(abs(deal)) AS da, sum(abs(tv)) AS v, count(amount) AS n FROM mt GROUP BY 1)"""


@query("step_indicators", sql(f"SELECT datetime, {rq('ffr')} AS ffr, {rq('pa')} AS pa, {rq('pos')} AS pos, {rq('da', 3)} AS deal_amount, {rq('v', 1)} AS value, n AS count FROM sp", "supp_m", ORD, metrics_cte("twap"), STEP))
def _(s, d):
    m = O.step_indicators(_metrics(s, d, "twap"), "amount")
    return m.select("datetime", *[r(c).alias(c) for c in ("ffr", "pa", "pos")], r("deal_amount", 3).alias("deal_amount"), r("value", 1).alias("value"), "count")


@query("indicator_summary", sql(f"SELECT {rq('sum(ffr * v) / sum(v)')} AS ffr, {rq('sum(pa * v) / sum(v)')} AS pa, {rq('sum(pos * n) / sum(n)')} AS pos FROM sp", "supp_m", ORD, metrics_cte("twap"), STEP))
def _(s, d):
    return rounded(O.indicator_summary(O.step_indicators(_metrics(s, d, "twap"), "amount"), "value"))


@query("order_sizing", sql(f"""SELECT order_id, {rq('floor((amount * 1.5 + 0.1) / 10) * 10 / 1.5')} AS rounded, {rq('greatest(least(amount, 40), 0)')} AS clipped,
    {rq('CASE WHEN deal * price <= 1e-5 THEN 0 ELSE greatest(deal * price * (0.0015 + 0.1 * pow(deal * price / 1e6, 2)), 5) END', 3)} AS cost FROM fl""", ORD))
def _(s, d):
    o = _orders(s, d)
    v = F.col("deal") * F.col("price")
    return o.select("order_id", r(O.round_to_unit(F.col("amount"), F.lit(1.5), 10)).alias("rounded"), r(O.clip_to_volume(F.col("amount"), current=F.lit(40.0))).alias("clipped"),
                    r(O.trade_cost(v, 0.0015, 0.1, F.lit(1e6), 5.0), 3).alias("cost"))


@query("volume_limit_cumulative", sql(f"""SELECT order_id, {rq('dealt')} AS dealt, {rq('greatest(least(amount, 60 - dealt), 0)')} AS allowed FROM (SELECT order_id, amount, coalesce(sum(amount) OVER (PARTITION BY instrument, CAST(t AS DATE) ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS dealt FROM
    (SELECT *, sm + to_microseconds(order_id) AS t FROM fl))""", ORD))
def _(s, d):
    o = _orders(s, d).withColumn("datetime", F.timestamp_micros(F.unix_micros(F.col("start").cast("timestamp")) + F.col("order_id")).cast("timestamp_ntz"))
    x = O.dealt_before(o.withColumn("deal_amount", F.col("amount")))
    return x.select("order_id", r("dealt").alias("dealt"), r(O.clip_to_volume(F.col("amount"), cumulative=F.lit(60.0), dealt=F.col("dealt"))).alias("allowed"))


@query("twap_schedule", sql("""SELECT order_id, CAST(k AS INTEGER) AS step, part AS child_amount FROM (SELECT order_id, k, CASE WHEN k = 3 THEN amount - least(round_even(amount * 3 / 4.0 / 8, 0) * 8, amount) ELSE
      least(round_even(amount * (k + 1) / 4.0 / 8, 0) * 8, amount) - CASE WHEN k = 0 THEN 0 ELSE least(round_even(amount * k / 4.0 / 8, 0) * 8, amount) END END AS part FROM o8, (SELECT unnest(range(4)) AS k)) WHERE part > 1e-5""",
    ORD, "o8 AS (SELECT order_id, amount * 16 + 1 AS amount FROM fl)"))
def _(s, d):
    o = _orders(s, d).withColumn("amount", F.col("amount") * 16 + 1)
    return O.twap_schedule(o, F.lit(4), F.lit(8.0)).select("order_id", "step", "child_amount")


@query("front_loaded_schedule", sql(f"""SELECT order_id, CAST(k AS INTEGER) AS step, {rq('amount * CASE WHEN direction = 0 THEN 0.2 ELSE (sinh(kp * (5 - k)) - sinh(kp * (4 - k))) / sinh(kp * 5) END', 5)} AS child_amount FROM
    (SELECT *, acosh(0.5 / 0.1 * 0.3 * 0.3 / 2 + 1) AS kp FROM fl), (SELECT unnest(range(5)) AS k)""", ORD))
def _(s, d):
    o = _orders(s, d).withColumn("vol", F.when(F.col("direction") == 1, 0.3))
    x = O.front_loaded_schedule(o, F.lit(5), 0.5, 0.1)
    return x.select("order_id", "step", r("child_amount", 5).alias("child_amount"))


def _ema(span):
    return f"(SELECT sum(b.close * pow(1 - 2.0 / {span + 1}, p.pos - b.pos)) / sum(pow(1 - 2.0 / {span + 1}, p.pos - b.pos)) FROM posed b WHERE b.instrument = p.instrument AND b.pos <= p.pos)"


@query("trend", sql(f"SELECT instrument, datetime, CASE WHEN v > 1e-9 * abs(close) THEN 'long' WHEN v < -1e-9 * abs(close) THEN 'short' ELSE 'mid' END AS trend FROM (SELECT instrument, datetime, close, {_ema(10)} - {_ema(20)} AS v FROM posed p)", "bars_h",
    "posed AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY datetime) AS pos FROM bars_h)"))
def _(s, d):
    return O.trend(bars_h(s, d)).select("instrument", "datetime", "trend")


@query("sampled_orders", sql("""SELECT instrument, datetime, 100.0::DOUBLE AS amount FROM supp_m
    WHERE CAST('0x' || substr(md5(instrument || '|' || CAST(epoch(datetime) AS BIGINT) || '|7'), 1, 8) AS BIGINT) / 4294967296.0 < 0.1""", "supp_m"))
def _(s, d):
    b = supp_m(s, d).df.select("instrument", "datetime", "volume")
    return O.sample_orders(b, 0.1, 7, F.lit(100.0)).select("instrument", "datetime", "amount")


@query("orders_for_steps", sql("""SELECT CAST(o.o_custkey AS VARCHAR) AS instrument, c.datetime, o.o_totalprice AS amount FROM (SELECT *, DATE '2024-01-01' + CAST(o_orderkey % 28 AS INTEGER) AS day FROM orders) o JOIN (SELECT DISTINCT datetime FROM bars_h) c ON CAST(c.datetime AS DATE) = o.day""", "bars_h"))
def _(s, d):
    o = table(s, d, "orders").select(F.col("o_custkey").cast("string").alias("instrument"), F.col("o_totalprice").alias("amount"),
                                     F.date_add(F.lit("2024-01-01").cast("date"), (F.col("o_orderkey") % 28).cast("int")).cast("timestamp_ntz").alias("datetime"))
    cal = C.calendar_of(bars_h(s, d).df)
    return O.orders_for_steps(o, cal).select("instrument", "datetime", "amount")
