"""Top-k, deduplication, unions, replacement and membership changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataline.operators import calendars as C
from strataline.operators import setops as O
from strataline.queries.common import bars_d, query, r, rounded, rq, scores, sql, table, ticks

SC = ("bars_d", "lagged_d", "scores")


@query("ordered_result", sql("SELECT instrument, datetime, close FROM bars_d ORDER BY 1, 2", "bars_d"))
def _(s, d):
    return O.ordered_result(bars_d(s, d).df.select("instrument", "datetime", "close"))


@query("quantile_members", sql(f"""SELECT instrument, datetime, {rq('score')} AS score, side FROM (SELECT *, row_number() OVER (PARTITION BY datetime ORDER BY score DESC, instrument) AS hi,
    row_number() OVER (PARTITION BY datetime ORDER BY score, instrument) AS lo, count(*) OVER (PARTITION BY datetime) AS n FROM scores), (SELECT unnest(['top', 'bottom']) AS side)
    WHERE (side = 'top' AND hi <= floor(n * 0.2)) OR (side = 'bottom' AND lo <= floor(n * 0.2))""", *SC))
def _(s, d):
    sc = scores(s, d).select("instrument", "datetime", "score")
    both = [O.quantile_members(sc, "score", 0.2, top=t).withColumn("side", F.lit(n)) for t, n in ((True, "top"), (False, "bottom"))]
    return rounded(both[0].unionByName(both[1]))


@query("top_bottom_k", sql(f"""SELECT instrument, datetime, {rq('score')} AS score, side FROM (SELECT *, row_number() OVER (PARTITION BY datetime ORDER BY score DESC, instrument) AS hi,
    row_number() OVER (PARTITION BY datetime ORDER BY score, instrument) AS lo FROM scores), (SELECT unnest(['top', 'bottom']) AS side)
    WHERE (side = 'top' AND hi <= 5) OR (side = 'bottom' AND lo <= 5)""", *SC))
def _(s, d):
    sc = scores(s, d).select("instrument", "datetime", "score")
    both = [O.top_k(sc, "score", 5, top=t).withColumn("side", F.lit(n)) for t, n in ((True, "top"), (False, "bottom"))]
    return rounded(both[0].unionByName(both[1]))


@query("top_by_size", sql(f"""SELECT instrument, datetime, {rq('score')} AS score, sign(score)::DOUBLE AS direction FROM scores
    QUALIFY row_number() OVER (PARTITION BY datetime ORDER BY abs(score) DESC, instrument) <= 10""", *SC))
def _(s, d):
    return O.top_by_size(scores(s, d).select("instrument", "datetime", "score"), "score", 10).select(
        "instrument", "datetime", r("score").alias("score"), "direction")


@query("concat_keep_newest", sql("""SELECT instrument, datetime, close, CAST(CASE WHEN datetime >= TIMESTAMP '2024-01-20' THEN 3 WHEN datetime >= TIMESTAMP '2024-01-10' THEN 2 ELSE 1 END AS INTEGER) AS model
    FROM bars_d""", "bars_d"))
def _(s, d):
    b = bars_d(s, d).df.select("instrument", "datetime", "close")
    parts = [b.where(f"datetime >= timestamp_ntz'{a}'").withColumn("model", F.lit(i)) for a, i in (("2024-01-20", 3), ("2024-01-01", 1), ("2024-01-10", 2))]
    return O.concat_keep_newest(parts, ["instrument", "datetime"])


@query("replace_range", sql("""SELECT instrument, datetime, CASE WHEN datetime BETWEEN TIMESTAMP '2024-01-12' AND TIMESTAMP '2024-01-15' THEN -close ELSE close END AS close
    FROM bars_d""", "bars_d"))
def _(s, d):
    b = bars_d(s, d).df.select("instrument", "datetime", "close")
    new = b.where("datetime BETWEEN timestamp_ntz'2024-01-12' AND timestamp_ntz'2024-01-15'").withColumn("close", -F.col("close"))
    return O.replace_range(b, new)


@query("membership_changes", sql("""SELECT instrument, c.datetime, 'add' AS type FROM (SELECT m.instrument, c.idx FROM mem m JOIN cal c ON c.datetime = m.datetime
       ANTI JOIN (SELECT instrument, idx + 1 AS idx FROM mem JOIN cal USING (datetime)) p ON p.instrument = m.instrument AND p.idx = c.idx WHERE c.idx > 0) x JOIN cal c ON c.idx = x.idx
    UNION ALL SELECT m.instrument, m.datetime, 'remove' FROM mem m JOIN cal c ON c.datetime = m.datetime ANTI JOIN (SELECT instrument, idx - 1 AS idx FROM mem JOIN cal USING (datetime)) q
       ON q.instrument = m.instrument AND q.idx = c.idx WHERE c.idx < (SELECT max(idx) FROM cal)""", "bars_d",
    "cal AS (SELECT datetime, row_number() OVER (ORDER BY datetime) - 1 AS idx FROM (SELECT DISTINCT datetime FROM bars_d))", "mem AS (SELECT instrument, datetime FROM bars_d)"))
def _(s, d):
    b = bars_d(s, d).df.select("instrument", "datetime")
    return O.membership_changes(b, C.calendar_of(b))


@query("spans_from_changes", sql("""SELECT instrument, coalesce(CASE WHEN pt = 'add' THEN pd END, TIMESTAMP '2023-12-01') AS "start", datetime AS "end" FROM
    (SELECT *, lag(type) OVER w AS pt, lag(datetime) OVER w AS pd FROM ev WINDOW w AS (PARTITION BY instrument ORDER BY datetime, CASE WHEN type = 'remove' THEN 0 ELSE 1 END)) WHERE type = 'remove'""",
    """ev AS (SELECT CAST(o_custkey AS VARCHAR) AS instrument, min(o_orderdate) AS datetime, 'add' AS type FROM orders GROUP BY 1 UNION ALL
       SELECT CAST(o_custkey AS VARCHAR), TIMESTAMP '2099-12-31', 'remove' FROM orders GROUP BY 1)"""))
def _(s, d):
    o = table(s, d, "orders").groupBy(F.col("o_custkey").cast("string").alias("instrument")).agg(F.min("o_orderdate").alias("datetime"))
    return O.spans_from_changes(o.withColumn("type", F.lit("add")), o.select("instrument"), "2023-12-01", "2099-12-31")


@query("append_quotes", sql("""SELECT instrument, datetime, close, close AS buy_price, 1.0::DOUBLE AS factor, false AS limit_buy, false AS limit_sell FROM bars_d
    UNION ALL SELECT 'x' || instrument, datetime, close, close, 1.0, false, false FROM bars_d WHERE datetime = TIMESTAMP '2024-01-10'""", "bars_d"))
def _(s, d):
    b = bars_d(s, d).df.select("instrument", "datetime", "close")
    full = b.withColumns({"buy_price": F.col("close"), "factor": F.lit(1.0), "limit_buy": F.lit(False), "limit_sell": F.lit(False)})
    extra = b.where("datetime = timestamp_ntz'2024-01-10'").withColumn("instrument", F.concat(F.lit("x"), "instrument"))
    return O.append_quotes(full, extra, ["buy_price"])


@query("dedupe_first", """SELECT l_suppkey, l_shipdate, l_orderkey, l_extendedprice FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_shipdate ORDER BY l_orderkey, l_extendedprice) = 1""")
def _(s, d):
    li = table(s, d, "lineitem").select("l_suppkey", "l_shipdate", "l_orderkey", "l_extendedprice")
    return O.keep_first(li, ["l_suppkey", "l_shipdate"], [F.col("l_orderkey"), F.col("l_extendedprice")])


def _vectors(s, d):
    t = ticks(s, d, "user_id")
    per = lambda k: t.where(F.dayofmonth("datetime") % 2 == k).groupBy("instrument").agg(F.sum("value").alias("v"))
    return per(1), per(0)


def vec(k):
    return f"(SELECT CAST(user_id AS VARCHAR) AS instrument, sum(value) AS v FROM events WHERE day(ts) % 2 = {k} GROUP BY 1)"


@query("sum_vectors", f"""SELECT instrument, {rq('coalesce(a.v, 0) + coalesce(b.v, 0)')} AS v FROM {vec(1)} a FULL JOIN {vec(0)} b USING (instrument)""")
def _(s, d):
    return rounded(O.sum_vectors(list(_vectors(s, d)), ["instrument"], "v", fill=0.0))


@query("side_by_side", f"""SELECT instrument, {rq('a.v')} AS x, {rq('b.v')} AS y FROM {vec(1)} a FULL JOIN {vec(0)} b USING (instrument)""")
def _(s, d):
    a, b = _vectors(s, d)
    return rounded(O.side_by_side({"x": a, "y": b}, ["instrument"], "v"))
