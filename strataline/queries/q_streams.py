"""Streaming jobs driven to completion over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataline.plans import expr as E
from strataline.plans.evaluate import Panel
from strataline.plans.sizing import scratch_folder
from strataline.queries.common import bars_d, query, r, rounded, rq, sql, table
from strataline.streaming import jobs as J


def live(s, d):
    """The events table as a stream of ticks."""
    schema = table(s, d, "events").schema
    e = s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return e.select(F.col("event_type").alias("instrument"), F.col("ts").cast("timestamp").alias("datetime"), "value")


def _run(s, stream):
    at = scratch_folder(s)
    J.run_once(stream, at + "/out", at + "/state")
    return s.read.parquet(at + "/out")


SEEN = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"


@query("stream_bars", sql(f"""SELECT instrument, datetime, open, high, low, close, {rq('volume', 3)} AS volume FROM bars_h WHERE datetime + INTERVAL 1 HOUR <= {SEEN}""", "bars_h"))
def _(s, d):
    return _run(s, J.stream_bars(live(s, d))).select("instrument", "datetime", "open", "high", "low", "close", r("volume", 3).alias("volume"))


@query("stream_intensity", f"""SELECT instrument, w AS datetime, {rq('avg(CAST(value > 20 AS DOUBLE))')} AS intensity FROM (SELECT event_type AS instrument, value, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS w FROM events)
    WHERE w + INTERVAL 1 HOUR <= {SEEN} GROUP BY 1, 2""")
def _(s, d):
    flagged = live(s, d).withColumn("big", F.col("value") > 20)
    return rounded(_run(s, J.stream_intensity(flagged, "big", "1 hour", "30 minutes")))


@query("stream_changes", f"""SELECT event_type AS instrument, ts AS datetime, value, lag(value) OVER w AS previous, {rq('CASE WHEN lag(value) OVER w <> 0 THEN value / lag(value) OVER w - 1 END', 4)} AS change FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)""")
def _(s, d):
    out = _run(s, J.stream_changes(live(s, d)))
    return out.withColumn("change", r("change", 4))


@query("stream_late_rows", """SELECT event_type AS instrument, ts AS datetime, value, epoch_us(ts) // 1000000 % 3 AS batch FROM events, (SELECT
    max(ts) FILTER (epoch_us(ts) // 1000000 % 3 = 0) AS m0, max(ts) FILTER (epoch_us(ts) // 1000000 % 3 < 2) AS m1 FROM events)
    WHERE ts < CASE epoch_us(ts) // 1000000 % 3 WHEN 1 THEN m0 WHEN 2 THEN m1 END - INTERVAL 20 DAY""")
def _(s, d):
    """The events in three deliveries, dealt by the second of their time: what arrives too late goes to a side table."""
    at = scratch_folder(s)
    e = table(s, d, "events").select(F.col("event_type").alias("instrument"), F.col("ts").cast("timestamp").alias("datetime"), "value")
    for k in range(3):
        e.where(F.unix_seconds("datetime") % 3 == k).write.mode("append").parquet(at + "/in")
        J.route_late(s.readStream.schema(e.schema).parquet(at + "/in"), at + "/out", at + "/state", "20 days").awaitTermination()
    return s.read.parquet(at + "/out/late").select("instrument", F.col("datetime").cast("timestamp_ntz").alias("datetime"), "value", F.col("batch").cast("long").alias("batch"))


@query("stream_refresh", sql(f"""SELECT instrument, datetime, {rq('avg(close) OVER (PARTITION BY instrument ORDER BY datetime ROWS 4 PRECEDING)')} AS m FROM bars_d""", "bars_d"))
def _(s, d):
    at = scratch_folder(s)
    bars = bars_d(s, d)
    changes = live(s, d)
    q = J.refresh_stream(changes, lambda: bars, {"m": E.mean(E.field("close"), 5)}, at + "/features", at + "/state", 5)
    q.awaitTermination()
    return rounded(s.read.parquet(at + "/features").drop("date"))
