"""Returns, risk, attribution and signal P&L."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataline.operators import calendars as C
from strataline.operators import portfolio as P
from strataline.plans import expr as E
from strataline.plans.evaluate import Panel, features, with_columns
from strataline.queries.common import bars_d, bars_h, query, r, rounded, rq, scores, sql, supp_m

CL = E.field("close")


def rets(s, d):
    """Monthly supplier returns with a benchmark and a cost column."""
    df = features(supp_m(s, d), {"ret": CL / E.ref(CL, 1) - 1}).where("ret IS NOT NULL")
    bench = df.groupBy("datetime").agg(F.avg("ret").alias("bench"))
    return df.join(bench, "datetime").withColumn("cost", F.lit(0.001))


RETS = """r0 AS (SELECT instrument, datetime, close / lag(close) OVER (PARTITION BY instrument ORDER BY datetime) - 1 AS ret FROM supp_m),
    rets AS (SELECT *, avg(ret) OVER (PARTITION BY datetime) AS bench, 0.001 AS cost FROM r0 WHERE ret IS NOT NULL)"""
XI = "(PARTITION BY instrument ORDER BY datetime)"


def risk_sql(mode, n=12, src="rets", key="instrument"):
    curve = f"sum(ret) OVER {XI}" if mode == "sum" else f"exp(sum(ln(1 + ret)) OVER {XI})"
    dd = "c - top" if mode == "sum" else "c / top - 1"
    if mode == "sum":
        mean, std, ann = "avg(ret)", "stddev_samp(ret)", f"avg(ret) * {n}"
    else:
        mean, std, ann = "exp(avg(ln(1 + ret))) - 1", "stddev_samp(ln(1 + ret))", f"exp(avg(ln(1 + ret)) * {n}) - 1"
    return f"""SELECT instrument, {rq(mean)} AS mean, {rq(std)} AS std, {rq(ann)} AS annualized_return, {rq(f'({mean}) / ({std}) * sqrt({n})', 5)} AS information_ratio, {rq(f'min({dd})')} AS max_drawdown
        FROM (SELECT *, max(c) OVER {XI} AS top FROM (SELECT *, {curve} AS c FROM {src})) GROUP BY 1"""


def _risk_out(df, *keys):
    return df.select(*keys, *[r(c, 5 if c == "information_ratio" else 6).alias(c) for c in ("mean", "std", "annualized_return", "information_ratio", "max_drawdown")])


@query("risk_analysis_sum", sql(risk_sql("sum"), "supp_m", RETS))
def _(s, d):
    return _risk_out(P.risk_analysis(rets(s, d), freq="month"), "instrument")


@query("risk_analysis_product", sql(risk_sql("product"), "supp_m", RETS))
def _(s, d):
    return _risk_out(P.risk_analysis(rets(s, d), freq="month", mode="product"), "instrument")


LOSS = "instrument LIKE '%7' AND datetime = TIMESTAMP '1995-06-01'"


@query("risk_analysis_losses", sql(f"""SELECT instrument, {rq('CASE WHEN lost THEN -1 ELSE exp(lm) - 1 END')} AS mean, {rq('CASE WHEN NOT lost THEN sd END')} AS std, {rq('CASE WHEN lost THEN -1 ELSE exp(lm * 12) - 1 END')} AS annualized_return,
    {rq('CASE WHEN NOT lost THEN (exp(lm) - 1) / sd * sqrt(12) END', 5)} AS information_ratio, {rq('dd')} AS max_drawdown FROM (SELECT instrument, bool_or(ret = -1) AS lost, avg(CASE WHEN ret > -1 THEN ln(1 + ret) END) AS lm,
    stddev_samp(CASE WHEN ret > -1 THEN ln(1 + ret) END) AS sd, min(c / top - 1) AS dd FROM (SELECT *, max(c) OVER {XI} AS top FROM (SELECT *, CASE WHEN bool_or(ret = -1) OVER {XI} THEN 0 ELSE
    exp(sum(CASE WHEN ret > -1 THEN ln(1 + ret) END) OVER {XI}) END AS c FROM (SELECT * REPLACE (CASE WHEN {LOSS} THEN -1 ELSE ret END AS ret) FROM rets))) GROUP BY 1)""", "supp_m", RETS))
def _(s, d):
    hit = F.expr(LOSS.replace("TIMESTAMP ", "timestamp_ntz"))
    return _risk_out(P.risk_analysis(rets(s, d).withColumn("ret", F.when(hit, -1.0).otherwise(F.col("ret"))), freq="month", mode="product"), "instrument")


def hourly(s, d):
    """Small bounded hourly moves per event type as a return series."""
    df = features(bars_h(s, d), {"ret": (CL - E.field("open")) / 10000.0})
    return df.withColumns({"bench": F.col("ret") * 0.5, "cost": F.lit(0.0001)})


HOURLY = "hr AS (SELECT instrument, datetime, (close - open) / 10000.0 AS ret, (close - open) / 20000.0 AS bench, 0.0001 AS cost FROM bars_h)"


@query("risk_monthly", sql(f"""SELECT series, kind, month, * EXCLUDE (instrument, series, kind, month) FROM (SELECT split_part(instrument, '|', 1) AS series, split_part(instrument, '|', 2) AS kind, split_part(instrument, '|', 3) AS month, * FROM ({risk_sql('sum', 238, 'mr')}))""",
    "bars_h", HOURLY, "mr AS (SELECT instrument || '|' || k || '|' || strftime(datetime, '%Y-%m') AS instrument, datetime, CASE WHEN k = 'excess' THEN ret - bench ELSE ret - bench - cost END AS ret FROM hr, (SELECT unnest(['excess', 'excess_with_cost']) AS k))"))
def _(s, d):
    return _risk_out(P.monthly_risk(hourly(s, d)), "series", "kind", "month")


CURVES = f"""cv AS (SELECT *, max(a) OVER {XI} AS ma, max(b) OVER {XI} AS mb, max(e) OVER {XI} AS me, max(f) OVER {XI} AS mf FROM (SELECT instrument, datetime, sum(bench) OVER {XI} AS z, sum(ret) OVER {XI} AS a, sum(ret - cost) OVER {XI} AS b,
    sum(ret - bench) OVER {XI} AS e, sum(ret - bench - cost) OVER {XI} AS f FROM hr))"""


@query("report_curves", sql(f"""SELECT instrument, datetime, {rq('z')} AS cum_bench, {rq('a')} AS cum_return_wo_cost, {rq('b')} AS cum_return_w_cost, {rq('e')} AS cum_ex_return_wo_cost, {rq('f')} AS cum_ex_return_w_cost,
    {rq('a - ma')} AS return_wo_cost_mdd, {rq('b - mb')} AS return_w_cost_mdd, {rq('e - me')} AS ex_return_wo_cost_mdd, {rq('f - mf')} AS ex_return_w_cost_mdd FROM cv""", "bars_h", HOURLY, CURVES))
def _(s, d):
    return rounded(P.report_curves(hourly(s, d)).drop("ret", "bench", "cost"))


@query("worst_interval", sql("""SELECT c.instrument, arg_max(c.datetime, c.a) AS "start", any_value(e."end") AS "end" FROM cv c JOIN (SELECT instrument, arg_min(datetime, a - ma) AS "end" FROM cv GROUP BY 1) e ON e.instrument = c.instrument AND c.datetime <= e."end" GROUP BY 1""", "bars_h", HOURLY, CURVES))
def _(s, d):
    return P.worst_interval(P.report_curves(hourly(s, d)))


@query("performance", sql(f"""SELECT instrument, {rq('pow(1 + avg(ret), 250) - 1', 4)} AS annual_return, {rq('(pow(1 + avg(ret), 250) - 1) / stddev_samp(ret) / sqrt(250)', 5)} AS sharpe, {rq('min(c / top - 1)')} AS max_drawdown, {rq('stddev_samp(ret)')} AS volatility,
    {rq('covar_samp(ret, bench) / var_samp(bench)')} AS beta, {rq('pow(1 + avg(ret), 250) - 1 - covar_samp(ret, bench) / var_samp(bench) * (pow(1 + avg(bench), 250) - 1)', 4)} AS alpha FROM
    (SELECT *, max(c) OVER {XI} AS top FROM (SELECT *, exp(sum(ln(1 + ret)) OVER {XI}) AS c FROM hr)) GROUP BY 1""", "bars_h", HOURLY))
def _(s, d):
    p = P.performance(hourly(s, d))
    return p.select("instrument", *[r(c, {"annual_return": 4, "sharpe": 5, "alpha": 4}.get(c, 6)).alias(c) for c in p.columns[1:]])


def positions(s, d):
    """Top 20 suppliers by volume each month, amount = volume, price = close."""
    from strataline.operators.setops import top_k
    return top_k(supp_m(s, d).df, "volume", 20).select("instrument", "datetime", F.col("volume").alias("amount"), F.col("close").alias("price"))


POS = "pos AS (SELECT instrument, datetime, volume AS amount, close AS price FROM supp_m QUALIFY row_number() OVER (PARTITION BY datetime ORDER BY volume DESC, instrument) <= 20)"


@query("position_values", sql(f"SELECT datetime, {rq('value', 3)} AS value, {rq('value / coalesce(lag(value) OVER (ORDER BY datetime), 1e7) - 1')} AS ret FROM (SELECT datetime, 1000.0 + sum(amount * price) AS value FROM pos GROUP BY 1)", "supp_m", POS))
def _(s, d):
    p = positions(s, d)
    cash = p.select("datetime").distinct().withColumn("cash", F.lit(1000.0))
    v = P.position_values(p, cash, supp_m(s, d).df, 1e7)
    return v.select("datetime", r("value", 3).alias("value"), r("ret").alias("ret"))


@query("benchmark_return", sql(f"SELECT datetime, {rq('coalesce(avg(ret), 0)')} AS bench FROM r0 WHERE instrument IN ('1', '2', '3') GROUP BY 1", "supp_m", RETS))
def _(s, d):
    return rounded(P.benchmark_return(supp_m(s, d), ["1", "2", "3"]))


@query("compound_steps", sql(f"SELECT instrument, time_bucket(INTERVAL 1 DAY, datetime) AS datetime, {rq('product(1 + ret) - 1')} AS ret FROM hr GROUP BY 1, 2", "bars_h", HOURLY))
def _(s, d):
    return rounded(P.compound(hourly(s, d), "1 day"))


WTS = "wts AS (SELECT instrument, datetime, amount * price / sum(amount * price) OVER (PARTITION BY datetime) AS weight FROM pos), nr AS (SELECT instrument, datetime, lead(close) OVER (PARTITION BY instrument ORDER BY datetime) / close - 1 AS nr FROM supp_m)"


@query("portfolio_return", sql(f"SELECT datetime, {rq('coalesce(sum(weight * nr), 0)')} AS ret FROM wts LEFT JOIN nr USING (instrument, datetime) GROUP BY 1", "supp_m", POS, WTS))
def _(s, d):
    w = P.weights_from_positions(positions(s, d))
    return rounded(P.portfolio_return(w, P.next_return(supp_m(s, d))))


def _groups(s, d):
    m = supp_m(s, d).df
    bench = m.where(F.col("instrument").cast("int") % 2 == 0).select("instrument", "datetime")
    return P.bin_groups(m.select("instrument", "datetime", F.col("volume").alias("value")), bench, 4)


BINS = """bins AS (SELECT m.instrument, m.datetime, CAST(4 - (CAST(m.volume >= e1 AS INTEGER) + CAST(m.volume >= e2 AS INTEGER) + CAST(m.volume >= e3 AS INTEGER)) AS INTEGER) AS grp FROM supp_m m JOIN
    (SELECT datetime, quantile_cont(volume, 0.25) AS e1, quantile_cont(volume, 0.5) AS e2, quantile_cont(volume, 0.75) AS e3 FROM supp_m WHERE CAST(instrument AS INTEGER) % 2 = 0 GROUP BY 1) e ON e.datetime = m.datetime)"""


@query("bin_groups", sql('SELECT instrument, datetime, grp AS "group" FROM bins', "supp_m", BINS))
def _(s, d):
    return _groups(s, d)


def side(name, src):
    return f"{name} AS (SELECT datetime, grp, sum(weight) AS w, coalesce(sum(weight * nr), 0) / sum(weight) AS r FROM {src} JOIN bins USING (instrument, datetime) LEFT JOIN nr USING (instrument, datetime) GROUP BY 1, 2)"


@query("brinson", sql(f"""SELECT datetime, {rq('q2 - q1')} AS allocation, {rq('q3 - q1')} AS selection, {rq('q4 - q3 - q2 + q1')} AS interaction, {rq('q4 - q1')} AS total FROM
    (SELECT datetime, coalesce(sum(bw * br), 0) AS q1, coalesce(sum(pw * br), 0) AS q2, coalesce(sum(bw * pr), 0) AS q3, coalesce(sum(pw * pr), 0) AS q4 FROM
     (SELECT datetime, coalesce(p.w, 0) AS pw, coalesce(b.w, 0) AS bw, coalesce(p.r, b.r) AS pr, b.r AS br FROM pg p FULL JOIN bg b USING (datetime, grp)) GROUP BY 1)""",
    "supp_m", POS, WTS, BINS, "bw AS (SELECT instrument, datetime, 1.0 / count(*) OVER (PARTITION BY datetime) AS weight FROM supp_m)", side("pg", "wts"), side("bg", "bw")))
def _(s, d):
    m = supp_m(s, d)
    eq = m.df.groupBy("datetime").agg((1.0 / F.count(F.lit(1))).alias("weight"))
    bench = m.df.select("instrument", "datetime").join(eq, "datetime")
    return rounded(P.brinson(P.weights_from_positions(positions(s, d)), bench, _groups(s, d), P.next_return(m)))


@query("long_short_excess", sql(f"""SELECT t2.datetime, {rq('avg(pf) FILTER (hi <= 10 AND ok) - avg(pf)', 5)} AS long, {rq('avg(-pf) FILTER (lo <= 10 AND ok) + avg(pf)', 5)} AS short, {rq('avg(-pf) FILTER (lo <= 10 AND ok) + avg(pf) FILTER (hi <= 10 AND ok)', 5)} AS long_short FROM
    (SELECT s.*, row_number() OVER (PARTITION BY datetime ORDER BY score DESC, instrument) AS hi, row_number() OVER (PARTITION BY datetime ORDER BY score, instrument DESC) AS lo FROM scores s) s
    JOIN cal c ON c.datetime = s.datetime JOIN cal t2 ON t2.i = c.i + 1
    JOIN (SELECT instrument, datetime, coalesce(lead(close) OVER (PARTITION BY instrument ORDER BY datetime) / close - 1, 0) AS pf, volume % 5 >= 1 AS ok FROM bars_d) q ON q.instrument = s.instrument AND q.datetime = t2.datetime GROUP BY 1""",
    "bars_d", "lagged_d", "scores", "cal AS (SELECT datetime, row_number() OVER (ORDER BY datetime) AS i FROM (SELECT DISTINCT datetime FROM bars_d))"))
def _(s, d):
    b = bars_d(s, d)
    q = with_columns(b, {"profit": E.ref(CL, -1) / CL - 1}).select("instrument", "datetime", "profit", (F.col("volume") % 5 >= 1).alias("tradable"), F.lit(False).alias("suspended"))
    return rounded(P.long_short_excess(scores(s, d).select("instrument", "datetime", "score"), q, C.calendar_of(b.df), 10), n=5)


HELD = "held AS (SELECT instrument, datetime, 0.01 + 0.001 * (CAST(instrument AS INTEGER) % 10) AS weight FROM scores WHERE CAST(instrument AS INTEGER) % 6 = 0 AND day(datetime) % 4 <> 0)"
STEP = """st AS (SELECT instrument, datetime, score, h.weight AS hw, coalesce(h.weight, 0) AS w0, coalesce(p.rn <= 15, false) AS inside, rn FROM (SELECT instrument, datetime, score, row_number() OVER (PARTITION BY datetime ORDER BY score DESC, instrument) AS rn FROM scores QUALIFY rn <= 15) p
    FULL JOIN held h USING (instrument, datetime)), st2 AS (SELECT *, CASE WHEN inside THEN 0 ELSE least(0.012, w0) END AS sold, CASE WHEN inside THEN greatest(1 / 15.0 - w0, 0) ELSE 0 END AS need FROM st),
    st3 AS (SELECT *, sum(sold) OVER (PARTITION BY datetime) AS free, count(hw) OVER (PARTITION BY datetime) AS nh, count(*) FILTER (inside) OVER (PARTITION BY datetime) AS k,
      coalesce(sum(need) OVER (PARTITION BY datetime, inside ORDER BY score DESC, instrument ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM st2)"""


def _held(s, d):
    i = F.col("instrument").cast("int")
    return scores(s, d).where((i % 6 == 0) & (F.dayofmonth("datetime") % 4 != 0)).select("instrument", "datetime", (0.01 + 0.001 * (i % 10)).alias("weight"))


@query("target_weights_first", sql(f"SELECT instrument, datetime, {rq('CASE WHEN nh = 0 THEN 1 / 15.0 WHEN inside THEN w0 + least(need, greatest(free - before, 0)) ELSE w0 - sold END')} AS weight FROM st3", "bars_d", "lagged_d", "scores", HELD, STEP))
def _(s, d):
    return rounded(P.target_weights(scores(s, d), _held(s, d), 15, 0.012))


@query("target_weights_average", sql(f"SELECT instrument, datetime, {rq('CASE WHEN nh = 0 THEN 1 / 15.0 WHEN inside THEN w0 + free / k ELSE w0 - sold END')} AS weight FROM st3", "bars_d", "lagged_d", "scores", HELD, STEP))
def _(s, d):
    return rounded(P.target_weights(scores(s, d), _held(s, d), 15, 0.012, fill="average"))


@query("signed_weights", sql(f"""SELECT instrument, datetime, {rq('CASE WHEN score >= 0 THEN 1 ELSE -1 END * 0.8 * raw / sum(raw) OVER (PARTITION BY datetime)')} AS weight FROM (SELECT s.*, 1 / coalesce(v.vol, 1e-6) AS raw FROM
    (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY datetime ORDER BY abs(score) DESC, instrument) <= 12) s LEFT JOIN
    (SELECT instrument, datetime, CASE WHEN count(ret) OVER w > 1 THEN stddev_samp(ret) OVER w END AS vol FROM (SELECT *, close / prev - 1 AS ret FROM lagged_d) WINDOW w AS (PARTITION BY instrument ORDER BY datetime ROWS 9 PRECEDING)) v USING (instrument, datetime))""", "bars_d", "lagged_d", "scores"))
def _(s, d):
    vol = features(bars_d(s, d), {"vol": E.std(CL / E.ref(CL, 1) - 1, 10)})
    return rounded(P.signed_weights(scores(s, d).select("instrument", "datetime", "score"), 12, vol, 0.8))


SIGNALED = """sg AS (SELECT m.*, last_value(sig IGNORE NULLS) OVER x AS s, coalesce(last_value(size IGNORE NULLS) OVER x, 0) AS z FROM (SELECT *, CASE WHEN month(datetime) % 3 = 1 THEN CASE WHEN volume % 2 < 1 THEN 'BUY' ELSE 'SELL' END END AS sig,
    CASE WHEN month(datetime) % 3 = 1 THEN 0.5 END AS size FROM supp_m) m WINDOW x AS (PARTITION BY instrument ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def _signaled(s, d):
    m = supp_m(s, d)
    sig = m.df.where(F.month("datetime") % 3 == 1).select("instrument", "datetime", F.when(F.col("volume") % 2 < 1, "BUY").otherwise("SELL").alias("signal"), F.lit(0.5).alias("position_size"))
    return P.carry_signals(m, sig)


@query("signals_on_bars", sql("SELECT instrument, datetime, coalesce(s, 'HOLD') AS signal, z::DOUBLE AS position_size FROM sg", "supp_m", SIGNALED))
def _(s, d):
    return _signaled(s, d).select("instrument", "datetime", "signal", "position_size")


PNL = f"""p0 AS (SELECT instrument, datetime, close, CASE WHEN s = 'BUY' THEN z WHEN s = 'SELL' THEN -z ELSE 0 END AS position FROM sg),
    p1 AS (SELECT *, position - coalesce(lag(position) OVER {XI}, 0) AS trade, coalesce(lag(position) OVER {XI}, 0) * coalesce(close / lag(close) OVER {XI} - 1, 0) AS port_ret FROM p0),
    p2 AS (SELECT *, product(1 + port_ret) OVER {XI} AS g FROM p1), p3 AS (SELECT *, g * (1 - sum(abs(trade) * 0.0015 / g) OVER {XI}) AS equity FROM p2),
    p4 AS (SELECT *, max(equity) OVER {XI} AS peak FROM p3)"""


@query("signal_pnl", sql(f"SELECT instrument, datetime, {rq('position')} AS position, {rq('trade')} AS trade, {rq('port_ret')} AS port_ret, {rq('equity')} AS equity, {rq('(peak - equity) / peak')} AS drawdown FROM p4", "supp_m", SIGNALED, PNL))
def _(s, d):
    p = P.signal_pnl(_signaled(s, d), 1.0, 0.001, 0.0005)
    return rounded(p.select("instrument", "datetime", "position", "trade", "port_ret", "equity", "drawdown"))


@query("pnl_metrics", sql(f"""SELECT instrument, {rq('arg_max(equity, datetime) - 1')} AS cumulative_return, {rq('CASE WHEN product(1 + port_ret) >= 0 THEN pow(product(1 + port_ret), 252.0 / count(*)) - 1 END', 5)} AS annualized_return, {rq('CASE WHEN stddev_samp(port_ret) <> 0 THEN avg(port_ret) / stddev_samp(port_ret) * sqrt(252) END', 5)} AS sharpe,
    {rq('max((peak - equity) / peak)')} AS max_drawdown, count(*) AS periods, count(*) FILTER (trade <> 0) AS trades FROM p4 GROUP BY 1""", "supp_m", SIGNALED, PNL))
def _(s, d):
    m = P.pnl_metrics(P.signal_pnl(_signaled(s, d), 1.0, 0.001, 0.0005))
    return m.select("instrument", *[r(c, 5 if c in ("annualized_return", "sharpe") else 6).alias(c) if t == "double" else F.col(c) for c, t in m.dtypes[1:]])


@query("equity_metrics", sql(f"""SELECT a.*, count(t.trade) AS trade_count, {rq('coalesce(avg(CAST(t.port_ret > 0 AS DOUBLE)), 0)')} AS win_rate FROM (SELECT instrument, {rq('arg_max(equity, datetime) / arg_min(equity, datetime) - 1')} AS total_return,
    {rq('avg(rr) / stddev_samp(rr) * sqrt(12)', 5)} AS sharpe_ratio, {rq('min((equity - peak) / peak)')} AS max_drawdown FROM (SELECT *, equity / lag(equity) OVER {XI} - 1 AS rr FROM p4) GROUP BY 1) a
    LEFT JOIN (SELECT * FROM p4 WHERE trade <> 0) t USING (instrument) GROUP BY ALL""", "supp_m", SIGNALED, PNL))
def _(s, d):
    p = P.signal_pnl(_signaled(s, d), 1.0, 0.001, 0.0005)
    m = P.equity_metrics(p, p.where("trade <> 0").select("instrument", F.col("port_ret").alias("profit")), 12)
    return m.select("instrument", *[r(c, 5 if c == "sharpe_ratio" else 6).alias(c) if t == "double" else F.col(c) for c, t in m.dtypes[1:]])


PARSED = """mi AS (SELECT datetime, row_number() OVER (ORDER BY datetime) AS i FROM (SELECT DISTINCT datetime FROM pos)), pi AS (SELECT * FROM wts JOIN mi USING (datetime)),
    parsed AS (SELECT a.instrument, a.datetime, a.weight, CASE WHEN b.instrument IS NULL THEN 1 ELSE 0 END AS status FROM pi a LEFT JOIN pi b ON b.instrument = a.instrument AND b.i = a.i - 1
      UNION ALL SELECT a.instrument, m.datetime, a.weight, -1 FROM pi a JOIN mi m ON m.i = a.i + 1 LEFT JOIN pi b ON b.instrument = a.instrument AND b.i = a.i + 1 WHERE b.instrument IS NULL)"""
LAB = """bn AS (SELECT datetime, lead(b) OVER (ORDER BY datetime) AS bench FROM (SELECT datetime, coalesce(avg(ret), 0) AS b FROM r0 WHERE instrument IN ('1', '2', '3') GROUP BY 1)),
    pl AS (SELECT p.*, n.nr AS label, bn.bench FROM parsed p LEFT JOIN nr n USING (instrument, datetime) LEFT JOIN bn USING (datetime))"""


def _parsed(s, d):
    return P.parse_positions(P.weights_from_positions(positions(s, d)))


def _labelled(s, d):
    m = supp_m(s, d)
    label = P.next_return(m).withColumnRenamed("next_ret", "label")
    return P.attach_label_bench(_parsed(s, d), label, P.benchmark_return(m, ["1", "2", "3"]))


@query("parse_positions", sql(f"SELECT instrument, datetime, {rq('weight')} AS weight, CAST(status AS INTEGER) AS status FROM parsed", "supp_m", POS, WTS, PARSED))
def _(s, d):
    return rounded(_parsed(s, d))


@query("positions_with_label", sql(f"SELECT instrument, datetime, CAST(status AS INTEGER) AS status, {rq('label')} AS label, {rq('bench')} AS bench FROM pl", "supp_m", RETS, POS, WTS, PARSED, LAB))
def _(s, d):
    return rounded(_labelled(s, d).drop("weight"))


@query("label_ranks", sql(f"""SELECT instrument, datetime, CAST(status AS INTEGER) AS status, {rq('rr')} AS rank_ratio, {rq('avg(rr) OVER (PARTITION BY datetime, status)')} AS rank_label_mean, {rq('ex')} AS excess_return FROM
    (SELECT *, (rank() OVER (PARTITION BY datetime ORDER BY -label) + (count(*) OVER (PARTITION BY datetime, label) - 1) / 2.0) / n * 100 AS rr FROM
     (SELECT *, label - avg(label) OVER (PARTITION BY datetime) AS ex, count(*) OVER (PARTITION BY datetime) AS n FROM pl) WHERE label IS NOT NULL)""", "supp_m", RETS, POS, WTS, PARSED, LAB))
def _(s, d):
    return rounded(P.label_ranks(_labelled(s, d)).where("label IS NOT NULL").select("instrument", "datetime", "status", "rank_ratio", "rank_label_mean", "excess_return"))


@query("status_contribution", sql(f"""SELECT datetime, {rq('hm')} AS hold_mean, {rq('bm')} AS buy_mean, {rq('sm')} AS sell_mean, {rq('sum(hm) OVER x')} AS cum_hold, {rq('sum(bm) OVER x')} AS cum_buy, {rq('sum(sm) OVER x')} AS cum_sell, {rq('sum(bm - sm) OVER x')} AS cum_buy_minus_sell FROM
    (SELECT datetime, {', '.join(f'coalesce(sum(weight * (label - bench)) FILTER (status = {v}) / sum(weight) FILTER (status = {v}), 0) AS {k}' for k, v in (('hm', 0), ('bm', 1), ('sm', -1)))} FROM pl WHERE label IS NOT NULL AND bench IS NOT NULL GROUP BY 1) WINDOW x AS (ORDER BY datetime)""", "supp_m", RETS, POS, WTS, PARSED, LAB))
def _(s, d):
    return rounded(P.status_contribution(_labelled(s, d)).select("datetime", "hold_mean", "buy_mean", "sell_mean", "cum_hold", "cum_buy", "cum_sell", "cum_buy_minus_sell"))
