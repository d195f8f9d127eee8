"""Point-in-time facts derived from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataline.operators import pit as P
from strataline.plans import expr as E
from strataline.queries.common import query, r, rounded, rq, sql, table
from strataline.sources.store import append_facts


def revisions(s, d):
    o = table(s, d, "orders")
    p = F.year("o_orderdate") * 100 + F.quarter("o_orderdate")
    day = F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 60).cast("int"))
    return o.groupBy((F.col("o_custkey") % 50).cast("string").alias("instrument"), p.alias("period"), day.alias("date")).agg(
        F.max_by("o_totalprice", "o_orderkey").alias("value"))


def grid(s, d):
    """First of each month for every instrument, from the first publication on."""
    rev = revisions(s, d)
    months = rev.select(F.date_trunc("month", "date").cast("timestamp_ntz").alias("datetime"), "instrument").distinct()
    return months.select("instrument", "datetime")


REV = """rev AS (SELECT CAST(o_custkey % 50 AS VARCHAR) AS instrument, year(o_orderdate) * 100 + quarter(o_orderdate) AS period,
    CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 AS INTEGER) AS date, arg_max(o_totalprice, o_orderkey) AS value FROM orders GROUP BY 1, 2, 3)"""
GRID = "grid AS (SELECT DISTINCT instrument, CAST(date_trunc('month', date) AS TIMESTAMP) AS datetime FROM rev)"
# latest revision of each period on each grid day
KNOWN = """known AS (SELECT g.instrument, g.datetime, r.period, r.period // 100 * 4 + r.period % 100 - 1 AS idx, arg_max(r.value, r.date) AS value
    FROM grid g JOIN rev r ON r.instrument = g.instrument AND r.date <= g.datetime GROUP BY 1, 2, 3)"""


@query("pit_latest", sql("SELECT g.instrument, g.datetime, k.value FROM grid g LEFT JOIN (SELECT instrument, datetime, arg_max(value, idx) AS value FROM known GROUP BY 1, 2) k USING (instrument, datetime)", REV, GRID, KNOWN))
def _(s, d):
    return P.point_in_time(revisions(s, d), grid(s, d))


@query("pit_mean_of_periods", sql(f"""SELECT g.instrument, g.datetime, {rq('k.value', 3)} AS value FROM grid g LEFT JOIN (SELECT a.instrument, a.datetime, avg(a.value) AS value FROM known a JOIN
    (SELECT instrument, datetime, max(idx) AS top FROM known GROUP BY 1, 2) t ON t.instrument = a.instrument AND t.datetime = a.datetime AND a.idx > t.top - 4 GROUP BY 1, 2) k USING (instrument, datetime)""", REV, GRID, KNOWN))
def _(s, d):
    df = P.point_in_time(revisions(s, d), grid(s, d), E.mean(E.field("value"), 4))
    return df.withColumn("value", r("value", 3))


@query("pit_change_of_periods", sql(f"""SELECT g.instrument, g.datetime, {rq('k.value', 5)} AS value FROM grid g LEFT JOIN (SELECT a.instrument, a.datetime, a.value / b.value - 1 AS value FROM known a JOIN
    (SELECT instrument, datetime, max(idx) AS top FROM known GROUP BY 1, 2) t ON t.instrument = a.instrument AND t.datetime = a.datetime AND a.idx = t.top
    LEFT JOIN known b ON b.instrument = a.instrument AND b.datetime = a.datetime AND b.idx = t.top - 4) k USING (instrument, datetime)""", REV, GRID, KNOWN))
def _(s, d):
    v = E.field("value")
    return rounded(P.point_in_time(revisions(s, d), grid(s, d), v / E.ref(v, 4) - 1), n=5)


def day_facts(s, d):
    """Facts of three-day periods, several hundred per instrument, published up to two months later."""
    o = table(s, d, "orders")
    day = F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 60).cast("int"))
    return o.groupBy((F.col("o_custkey") % 2).cast("string").alias("instrument"), F.floor(F.date_diff("o_orderdate", F.lit("1992-01-01").cast("date")) / 3).cast("int").alias("period"),
                     day.alias("date")).agg(F.max_by("o_totalprice", "o_orderkey").alias("value"))


DAYS = """df AS (SELECT CAST(o_custkey % 2 AS VARCHAR) AS instrument, CAST(floor(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) / 3) AS INTEGER) AS period,
    CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 AS INTEGER) AS date, arg_max(o_totalprice, o_orderkey) AS value FROM orders GROUP BY 1, 2, 3)"""


@query("pit_sum_of_periods", sql(f"""SELECT instrument, datetime, {rq('sum(value)', 2)} AS value FROM (SELECT g.instrument, g.datetime, r.period, arg_max(r.value, r.date) AS value
    FROM (SELECT DISTINCT instrument, CAST(date_trunc('month', date) AS TIMESTAMP) AS datetime FROM df) g LEFT JOIN df r ON r.instrument = g.instrument AND r.date <= g.datetime GROUP BY 1, 2, 3) GROUP BY 1, 2""", DAYS))
def _(s, d):
    facts = day_facts(s, d)
    months = facts.select("instrument", F.date_trunc("month", "date").cast("timestamp_ntz").alias("datetime")).distinct()
    out = P.point_in_time(facts, months, E.sum_(E.field("value"), 0), quarterly=False)
    return out.withColumn("value", r("value", 2))


@query("pit_named_period", sql("SELECT g.instrument, g.datetime, k.value FROM grid g LEFT JOIN known k ON k.instrument = g.instrument AND k.datetime = g.datetime AND k.period = 199902", REV, GRID, KNOWN))
def _(s, d):
    return P.period_value(revisions(s, d), grid(s, d), 199902)


@query("pit_latest_facts", sql("SELECT instrument, CAST(period AS INTEGER) AS period, arg_max(value, date) AS value, max(date) AS date FROM rev GROUP BY 1, 2", REV))
def _(s, d):
    return P.latest_facts(revisions(s, d))


@query("pit_append", sql("""SELECT 'price' AS field, instrument, CAST(period AS INTEGER) AS period, date, value FROM rev r WHERE date <= DATE '1998-06-30' OR date > coalesce((SELECT max(date) FROM rev o
    WHERE o.instrument = r.instrument AND o.date <= DATE '1998-06-30'), DATE '1900-01-01')""", REV))
def _(s, d):
    f = revisions(s, d).withColumn("field", F.lit("price"))
    return append_facts(f.where("date <= date'1998-06-30'"), f.where("date > date'1998-03-31'"))
