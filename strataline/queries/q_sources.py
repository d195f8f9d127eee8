"""Loads, incremental updates, merges and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataline.plans.sizing import scratch_folder
from strataline.queries.common import bars_d, bars_h, query, r, rounded, rq, sql, table
from strataline.sources import panels as PA
from strataline.sources import store as ST


def base(s, d):
    return bars_d(s, d).df.select("instrument", "datetime", "close")


@query("load_full_features", sql("""SELECT l.instrument, c.datetime, b.close FROM (SELECT instrument, min(datetime) AS a, max(datetime) AS z FROM bars_d GROUP BY 1) l
    JOIN (SELECT DISTINCT datetime FROM bars_d) c ON c.datetime BETWEEN l.a AND l.z LEFT JOIN bars_d b ON b.instrument = l.instrument AND b.datetime = c.datetime""", "bars_d"))
def _(s, d):
    b = base(s, d)
    return ST.full_load(b.unionByName(b.withColumn("close", F.col("close") + 1)))["features"]


@query("load_full_universe", sql('SELECT instrument, min(datetime) AS "start", max(datetime) AS "end" FROM bars_d GROUP BY 1', "bars_d"))
def _(s, d):
    return ST.full_load(base(s, d))["universe"]


@query("load_full_calendar", sql("SELECT datetime, row_number() OVER (ORDER BY datetime) - 1 AS idx FROM (SELECT DISTINCT datetime FROM bars_d)", "bars_d"))
def _(s, d):
    return ST.full_load(base(s, d))["calendar"]


@query("load_new_instruments", sql("SELECT instrument, datetime, close FROM bars_d WHERE CAST(instrument AS INTEGER) % 3 = 0", "bars_d"))
def _(s, d):
    b = base(s, d)
    return ST.new_instruments(b.where(F.col("instrument").cast("int") % 3 != 0), b)


CUT = "TIMESTAMP '2024-01-15'"


@query("load_newer_rows", sql(f"""SELECT b.instrument, b.datetime, b.close FROM bars_d b LEFT JOIN (SELECT instrument, max(datetime) AS e FROM bars_d WHERE datetime <= {CUT} GROUP BY 1) o USING (instrument) WHERE o.e IS NULL OR b.datetime > o.e""", "bars_d"))
def _(s, d):
    b = base(s, d)
    old = ST.full_load(b.where("datetime <= timestamp_ntz'2024-01-15'"))["universe"]
    return ST.newer_rows(old, b)[0]


@query("load_extended_universe", sql('SELECT instrument, min(datetime) AS "start", max(datetime) AS "end" FROM bars_d GROUP BY 1', "bars_d"))
def _(s, d):
    b = base(s, d)
    old = ST.full_load(b.where("datetime <= timestamp_ntz'2024-01-15'"))["universe"]
    return ST.newer_rows(old, b)[1]


@query("overlay_upsert", sql(f"SELECT instrument, datetime, CASE WHEN datetime >= {CUT} AND CAST(instrument AS INTEGER) % 4 <> 0 THEN close * 10 ELSE close END AS close FROM bars_d", "bars_d"))
def _(s, d):
    b = base(s, d)
    new = b.where("datetime >= timestamp_ntz'2024-01-15'").withColumn("close", F.when(F.col("instrument").cast("int") % 4 != 0, F.col("close") * 10))
    return ST.overlay(b, new, ["close"])


@query("outer_align", sql("SELECT instrument, datetime, a.close AS price__close, b.volume AS flow__volume FROM (SELECT * FROM bars_d WHERE day(datetime) <= 20) a FULL JOIN (SELECT * FROM bars_d WHERE day(datetime) >= 10) b USING (instrument, datetime)", "bars_d"))
def _(s, d):
    b = bars_d(s, d).df
    return PA.outer_align({"price": b.where(F.dayofmonth("datetime") <= 20).select("instrument", "datetime", "close"),
                           "flow": b.where(F.dayofmonth("datetime") >= 10).select("instrument", "datetime", "volume")})


@query("nested_merge", sql("SELECT a.instrument, a.datetime, a.open, b.close * 2 AS close FROM bars_d a LEFT JOIN (SELECT * FROM bars_d WHERE day(datetime) >= 10) b USING (instrument, datetime)", "bars_d"))
def _(s, d):
    b = bars_d(s, d).df
    return PA.nest([b.select("instrument", "datetime", "open", "close"), b.where(F.dayofmonth("datetime") >= 10).select("instrument", "datetime", (F.col("close") * 2).alias("close"))]) \
        .select("instrument", "datetime", "open", "close")


@query("partitioned_manifest", sql("SELECT 'x-' || instrument AS symbol, '1d' AS \"interval\", min(datetime) AS start_timestamp, max(datetime) AS end_timestamp, count(*) AS row_count FROM bars_d GROUP BY 1", "bars_d"))
def _(s, d):
    b = base(s, d).withColumn("instrument", F.concat(F.lit("x/"), (F.col("instrument").cast("int") % 1000000).cast("string")))
    return ST.manifest(b.select(F.regexp_replace("instrument", "/", "-").alias("symbol"), "datetime", F.lit("1d").alias("interval")))


@query("partitioned_write", sql(f"SELECT instrument AS symbol, '1d' AS \"interval\", CAST(datetime AS DATE) AS date, datetime, {rq('close')} AS close FROM bars_d", "bars_d"))
def _(s, d):
    folder = scratch_folder(s) + "/by_date"
    ST.save_partitioned(bars_d(s, d).df.select("instrument", "datetime", "close"), folder, "1d", by_symbol=False)
    back = ST.read_partitioned(s, folder, "instrument string, datetime timestamp_ntz, close double")
    return back.select("symbol", "interval", "date", "datetime", r("close").alias("close"))


@query("csv_roundtrip", "SELECT CAST(o_orderkey AS VARCHAR) AS instrument, CAST(o_orderdate AS TIMESTAMP) AS datetime, o_totalprice AS price FROM orders")
def _(s, d):
    folder = scratch_folder(s) + "/orders_csv"
    table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("symbol"), F.col("o_orderdate").alias("date"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status")) \
        .write.mode("overwrite").option("header", True).csv(folder)
    return PA.read_raw(s, folder, "csv", "symbol string, date timestamp_ntz, price double, status string", exclude=["status"])
