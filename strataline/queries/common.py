"""Shared pieces of the registered queries: panels derived from the driver's
tables, their SQL twins, and the registry itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.functions.scalar import ieee_div
from strataline.plans.evaluate import Panel
from strataline.sources.panels import bars_from_ticks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


NUDGE = 1.7e-9  # moves decimal ties such as x.xxxxxx5 off the rounding edge on both engines


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r(c, n: int = 6) -> Column:
    """Rounded double without negative zero, as ``rq`` does in SQL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double") + F.lit(NUDGE), n) + F.lit(0.0)


def rq(sql: str, n: int = 6) -> str:
    return f"(round(CAST({sql} AS DOUBLE) + {NUDGE}, {n}) + 0.0)"


def rounded(df: DataFrame, *keep: str, n: int = 6) -> DataFrame:
    """Round every double column outside ``keep``, as :func:`r` does, in one projection."""
    return df.selectExpr(*[f"round(cast(`{c}` as double) + {NUDGE}D, {n}) + 0.0D AS `{c}`" if t in ("double", "float") and c not in keep
                           else f"`{c}`" for c, t in df.dtypes])


def rounded_fast(df: DataFrame, *keep: str, n: int = 6) -> DataFrame:
    """As :func:`rounded`, by binary multiplication and division as DuckDB does it; for wide results, where a decimal number per value is slow."""
    return df.selectExpr(*[f"rint((cast(`{c}` as double) + {NUDGE}D) * 1e{n}D) / 1e{n}D + 0.0D AS `{c}`" if t in ("double", "float") and c not in keep
                           else f"`{c}`" for c, t in df.dtypes])


# ------------------------------------------------------------------ panels

def ticks(spark, sf, by="event_type") -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.col(by).cast("string").alias("instrument"), F.col("ts").alias("datetime"), "value")


def bars_h(spark, sf) -> Panel:
    t = ticks(spark, sf)
    return Panel(bars_from_ticks(t, "hour"))


def bars_d(spark, sf, in_order: bool = False) -> Panel:
    """``in_order``: for queries that compare volumes with thresholds, where the last bit of a sum decides."""
    t = ticks(spark, sf, "user_id")
    return Panel(bars_from_ticks(t, "day", in_order=in_order))


def supp_m(spark, sf) -> Panel:
    li = table(spark, sf, "lineitem")
    df = li.groupBy(F.col("l_suppkey").cast("string").alias("instrument"),
                    F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("datetime")).agg(
        (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"), F.sum("l_quantity").alias("volume"))
    return Panel(df)


def supp_d(spark, sf) -> Panel:
    li = table(spark, sf, "lineitem").withColumn("p", F.col("l_extendedprice") / F.col("l_quantity"))
    df = li.groupBy(F.col("l_suppkey").cast("string").alias("instrument"), F.col("l_shipdate").alias("datetime")).agg(
        F.avg("p").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"),
        (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"), F.sum("l_quantity").alias("volume"),
        (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("vwap"))
    return Panel(df)


def universe(spark, sf) -> DataFrame:
    t = ticks(spark, sf, "user_id")
    day = F.date_trunc("day", "datetime").cast("timestamp_ntz")
    return t.groupBy("instrument").agg(F.min(day).alias("start"), F.max(day).alias("_last")).select(
        "instrument", "start", F.least("_last", F.col("start") + F.expr("INTERVAL 20 DAYS")).alias("end"))


CTE = {
    "bars_h": """bars_h AS (SELECT event_type AS instrument, date_trunc('hour', ts) AS datetime,
        arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close,
        sum(value) AS volume, avg(value) AS vwap FROM events GROUP BY 1, 2)""",
    "bars_d": """bars_d AS (SELECT CAST(user_id AS VARCHAR) AS instrument,
        CAST(date_trunc('day', ts) AS TIMESTAMP) AS datetime,
        arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close,
        sum(value) AS volume, avg(value) AS vwap FROM events GROUP BY 1, 2)""",
    "supp_m": """supp_m AS (SELECT CAST(l_suppkey AS VARCHAR) AS instrument,
        CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS datetime,
        sum(l_extendedprice) / sum(l_quantity) AS close, sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2)""",
    "supp_d": """supp_d AS (SELECT CAST(l_suppkey AS VARCHAR) AS instrument, l_shipdate AS datetime,
        avg(l_extendedprice / l_quantity) AS open, max(l_extendedprice / l_quantity) AS high,
        min(l_extendedprice / l_quantity) AS low, sum(l_extendedprice) / sum(l_quantity) AS close,
        sum(l_quantity) AS volume, sum(l_extendedprice) / sum(l_quantity) AS vwap FROM lineitem GROUP BY 1, 2)""",
    "universe": """universe AS (SELECT CAST(user_id AS VARCHAR) AS instrument,
        CAST(date_trunc('day', min(ts)) AS TIMESTAMP) AS "start",
        least(CAST(date_trunc('day', max(ts)) AS TIMESTAMP),
              CAST(date_trunc('day', min(ts)) AS TIMESTAMP) + INTERVAL 20 DAY) AS "end" FROM events GROUP BY 1)""",
    "ticks": "ticks AS (SELECT event_type AS instrument, ts AS datetime, value FROM events)",
    "uticks": "uticks AS (SELECT CAST(user_id AS VARCHAR) AS instrument, ts AS datetime, value FROM events)",
    "lagged_d": """lagged_d AS (SELECT *, lag(close) OVER (PARTITION BY instrument ORDER BY datetime) AS prev,
        lead(close) OVER (PARTITION BY instrument ORDER BY datetime) AS nxt FROM bars_d)""",
    "scores": """scores AS (SELECT instrument, datetime, close - prev AS score, nxt / close - 1 AS label
        FROM lagged_d WHERE prev IS NOT NULL)""",
}


def scores(spark, sf) -> DataFrame:
    """bars_d with score = close change and label = next close / close - 1."""
    from strataline.plans import expr as E
    from strataline.plans.evaluate import features

    c = E.field("close")
    df = features(bars_d(spark, sf), {"score": E.delta(c, 1), "close": c, "next": E.ref(c, -1)})
    label = ieee_div(F.col("next"), F.col("close")) - 1      # as in SQL: after two closes of zero a NaN, which is not missing
    return df.where(F.col("score").isNotNull()).select("instrument", "datetime", "score", label.alias("label"))


def sql(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join(CTE.get(c, c) for c in ctes) + "\n" + body
