"""Sequence samples and multi-frequency rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataline.operators import sequence as S
from strataline.queries.common import bars_d, query, r, rounded, rq, sql, ticks

DENSE = """dense AS (SELECT l.instrument, c.datetime, b.close, b.close IS NOT NULL AS own FROM (SELECT instrument, min(datetime) AS a, max(datetime) AS z FROM bars_d GROUP BY 1) l
    JOIN (SELECT DISTINCT datetime FROM bars_d) c ON c.datetime BETWEEN l.a AND l.z LEFT JOIN bars_d b ON b.instrument = l.instrument AND b.datetime = c.datetime)"""
W5 = "WINDOW w AS (PARTITION BY instrument ORDER BY datetime ROWS 4 PRECEDING)"


def _closes(df):
    return df.select("instrument", "datetime", F.transform("sequence", lambda x: x["close"]).alias("seq"))


def _panel(s, d):
    return bars_d(s, d).df.select("instrument", "datetime", "close", "volume")


PADDED = "list_concat([NULL::DOUBLE for i in range(5 - len(l))], l)"


@query("sequences_padded", sql(f"SELECT instrument, datetime, {PADDED} AS seq FROM (SELECT *, list(close) OVER w AS l FROM dense {W5}) WHERE own", "bars_d", DENSE))
def _(s, d):
    return _closes(S.sequences(_panel(s, d), ["close", "volume"], 5))


@query("sequences_ffill", sql(f"""SELECT instrument, datetime, {PADDED} AS seq FROM (SELECT instrument, datetime, own, list(f) OVER w AS l FROM
    (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f FROM dense) {W5})
    WHERE own AND datetime >= TIMESTAMP '2024-01-15'""", "bars_d", DENSE))
def _(s, d):
    return _closes(S.sequences(_panel(s, d), ["close"], 5, fill="ffill", start="2024-01-15"))


@query("sequences_zero_pad_filtered", sql(f"""SELECT instrument, datetime, list_transform({PADDED}, lambda v: coalesce(v, 0)) AS seq FROM (SELECT *, list(close) OVER w AS l FROM dense {W5}) WHERE own AND close > 20""", "bars_d", DENSE))
def _(s, d):
    return _closes(S.sequences(_panel(s, d), ["close"], 5, pad=0.0, keep=F.col("close") > 20))


@query("daily_with_buckets", sql(f"""SELECT b.instrument, b.datetime, b.close, {', '.join(f'{rq(f"avg(CASE WHEN slot = {i} THEN value END)")} AS value_{i}' for i in range(4))} FROM bars_d b LEFT JOIN
    (SELECT CAST(user_id AS VARCHAR) AS instrument, CAST(date_trunc('day', ts) AS TIMESTAMP) AS datetime, (hour(ts) * 60 + minute(ts) - 570) // 90 AS slot, value FROM events WHERE hour(ts) * 60 + minute(ts) >= 570) t
    ON t.instrument = b.instrument AND t.datetime = b.datetime GROUP BY 1, 2, 3""", "bars_d"))
def _(s, d):
    return rounded(S.daily_with_buckets(bars_d(s, d).df.select("instrument", "datetime", "close"), ticks(s, d, "user_id"), "value", 90, 4), "close")
