"""Evaluation of scores against forward returns."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataline.operators import signals as G
from strataline.queries.common import bars_d, query, r, rounded, rq, scores, sql

SC = ("bars_d", "lagged_d", "scores")


def arank(c, part="datetime"):
    return f"(rank() OVER (PARTITION BY {part} ORDER BY {c}) + (count(*) OVER (PARTITION BY {part}, {c}) - 1) / 2.0)"


RANKED = f"rk AS (SELECT *, {arank('score')} AS rs, {arank('label')} AS rl FROM scores WHERE score IS NOT NULL AND label IS NOT NULL)"
NN = lambda e: f"CASE WHEN NOT isnan({e}) THEN {e} END"
IC = f"ic AS (SELECT datetime, {NN('corr(score, label)')} AS ic, {NN('corr(rs, rl)')} AS rank_ic FROM rk GROUP BY 1)"


@query("score_label_join", sql(f"SELECT instrument, datetime, {rq('score')} AS score, {rq('label', 5)} AS label FROM scores WHERE label IS NOT NULL", *SC))
def _(s, d):
    sc = scores(s, d)
    j = G.join_label(sc.select("instrument", "datetime", "score"), sc.where("label IS NOT NULL").select("instrument", "datetime", "label"))
    return j.select("instrument", "datetime", r("score").alias("score"), r("label", 5).alias("label"))


@query("ic_by_date", sql(f"SELECT datetime, {rq('ic')} AS ic, {rq('rank_ic')} AS rank_ic FROM ic", *SC, RANKED, IC))
def _(s, d):
    return rounded(G.ic_by_date(scores(s, d)))


@query("ic_many_models", sql(f"""SELECT model, datetime, {rq('corr(score, label)')} AS ic, {rq('corr(rs, rl)')} AS rank_ic FROM (SELECT *, {arank('score', 'model, datetime')} AS rs, {arank('label', 'model, datetime')} AS rl FROM two) GROUP BY 1, 2""",
    *SC, "two AS (SELECT 'a' AS model, instrument, datetime, score, label FROM scores WHERE label IS NOT NULL UNION ALL SELECT 'b', instrument, datetime, -score + CAST(instrument AS INTEGER) / 7.0, label FROM scores WHERE label IS NOT NULL)"))
def _(s, d):
    sc = scores(s, d).where("label IS NOT NULL")
    two = sc.withColumn("model", F.lit("a")).unionByName(sc.withColumns({"model": F.lit("b"), "score": -F.col("score") + F.col("instrument").cast("int") / 7.0}))
    return rounded(G.ic_by_date(two, ("model", "datetime")))


@query("ic_summary", sql(f"SELECT {rq('avg(ic)')} AS ic, {rq('avg(ic) / stddev_samp(ic)')} AS icir, {rq('avg(rank_ic)')} AS rank_ic, {rq('avg(rank_ic) / stddev_samp(rank_ic)')} AS rank_icir FROM ic", *SC, RANKED, IC))
def _(s, d):
    return rounded(G.ic_summary(G.ic_by_date(scores(s, d))))


SIDES = """sides AS (SELECT *, row_number() OVER (PARTITION BY datetime ORDER BY score DESC, instrument) <= floor(n * 0.2) AS is_long, row_number() OVER (PARTITION BY datetime ORDER BY score, instrument) <= floor(n * 0.2) AS is_short
    FROM (SELECT *, count(*) OVER (PARTITION BY datetime) AS n, label - avg(label) OVER (PARTITION BY datetime) AS dl FROM scores))"""


@query("long_short_precision", sql(f"SELECT datetime, {rq('avg(CAST(dl > 0 AS DOUBLE)) FILTER (is_long)')} AS long, {rq('avg(CAST(dl < 0 AS DOUBLE)) FILTER (is_short)')} AS short FROM sides GROUP BY 1", *SC, SIDES))
def _(s, d):
    return rounded(G.long_short_precision(scores(s, d), demean=True))


LSR = "lsr AS (SELECT datetime, (avg(label) FILTER (is_long) - avg(label) FILTER (is_short)) / 2 AS long_short, avg(label) AS average FROM sides GROUP BY 1)"


@query("long_short_return", sql(f"SELECT datetime, {rq('long_short')} AS long_short, {rq('average')} AS average FROM lsr", *SC, SIDES, LSR))
def _(s, d):
    return rounded(G.long_short_return(scores(s, d)))


@query("long_short_annualised", sql(f"SELECT {rq('avg(long_short) * 252', 4)} AS long_short_ann, {rq('avg(long_short) / stddev_samp(long_short) * sqrt(252)', 5)} AS long_short_ir FROM lsr", *SC, SIDES, LSR))
def _(s, d):
    a = G.annualised(G.long_short_return(scores(s, d)), ["long_short"])
    return a.select(r("long_short_ann", 4).alias("long_short_ann"), r("long_short_ir", 5).alias("long_short_ir"))


@query("signal_report", sql(f"""SELECT {rq('avg(ic)')} AS ic, {rq('avg(ic) / stddev_samp(ic)')} AS icir, {rq('avg(rank_ic)')} AS rank_ic, {rq('avg(rank_ic) / stddev_samp(rank_ic)')} AS rank_icir,
    (SELECT {rq('avg(a)')} FROM (SELECT avg(CAST(label > 0 AS DOUBLE)) FILTER (is_long) AS a FROM sides GROUP BY datetime)) AS long_precision,
    (SELECT {rq('avg(a)')} FROM (SELECT avg(CAST(label < 0 AS DOUBLE)) FILTER (is_short) AS a FROM sides GROUP BY datetime)) AS short_precision,
    (SELECT {rq('avg(long_short)', 5)} FROM lsr) AS long_short_return, (SELECT {rq('avg(average)', 5)} FROM lsr) AS average_return FROM ic""", *SC, RANKED, IC, SIDES, LSR))
def _(s, d):
    rep = G.signal_report(scores(s, d))
    return rep.select(*[r(c, 5 if c.endswith("return") else 6).alias(c) for c in rep.columns])


DAYIX = "dix AS (SELECT datetime, row_number() OVER (ORDER BY datetime) AS i FROM (SELECT DISTINCT datetime FROM scores))"


@query("prediction_autocorr", sql(f"""SELECT a.datetime, {rq('CASE WHEN count(b.score) > 1 THEN corr(a.score, b.score) END')} AS autocorr FROM (SELECT * FROM scores JOIN dix USING (datetime)) a
    LEFT JOIN (SELECT * FROM scores JOIN dix USING (datetime)) b ON a.instrument = b.instrument AND a.i = b.i + 1 GROUP BY 1""", *SC, DAYIX))
def _(s, d):
    return rounded(G.prediction_autocorr(scores(s, d)))


@query("rank_autocorr", sql(f"""SELECT datetime, {rq('CASE WHEN count(lp) > 1 THEN corr(p, lp) END')} AS autocorr FROM (SELECT datetime, {arank('score')} AS p, CASE WHEN last IS NOT NULL THEN {arank('last')} END AS lp FROM
    (SELECT *, lag(score) OVER (PARTITION BY instrument ORDER BY datetime) AS last FROM scores)) GROUP BY 1""", *SC))
def _(s, d):
    return rounded(G.rank_autocorr(scores(s, d)))


GROUPED = "grp AS (SELECT *, CASE WHEN n // 5 > 0 THEN (p - 1) // (n // 5) + 1 END AS g FROM (SELECT *, row_number() OVER (PARTITION BY datetime ORDER BY score DESC, instrument) AS p, count(*) OVER (PARTITION BY datetime) AS n FROM scores))"
GCOLS = ", ".join(f"avg(label) FILTER (g = {i}) AS group{i}" for i in range(1, 6))


@query("group_returns", sql(f"SELECT datetime, {', '.join(f'{rq(f'group{i}', 5)} AS group{i}' for i in range(1, 6))}, {rq('average', 5)} AS average, {rq('group1 - group5', 5)} AS long_short, {rq('group1 - average', 5)} AS long_average FROM (SELECT datetime, {GCOLS}, avg(label) AS average FROM grp GROUP BY 1)", *SC, GROUPED))
def _(s, d):
    return rounded(G.group_returns(scores(s, d)), n=5)


@query("group_returns_cumulative", sql(f"SELECT datetime, {rq('sum(group1) OVER x', 4)} AS cum_group1, {rq('sum(group1 - group5) OVER x', 4)} AS cum_long_short FROM (SELECT datetime, {GCOLS} FROM grp GROUP BY 1) WINDOW x AS (ORDER BY datetime)", *SC, GROUPED))
def _(s, d):
    g = G.cumulative(G.group_returns(scores(s, d)), ["group1", "long_short"])
    return g.select("datetime", r("cum_group1", 4).alias("cum_group1"), r("cum_long_short", 4).alias("cum_long_short"))


@query("turnover", sql(f"""SELECT datetime, {rq('1 - (count(*) FILTER (a <= n // 5 AND b <= n // 5)) / CAST(any_value(n) // 5 AS DOUBLE)')} AS top, {rq('1 - (count(*) FILTER (c <= n // 5 AND e <= n // 5)) / CAST(any_value(n) // 5 AS DOUBLE)')} AS bottom FROM
    (SELECT *, count(*) OVER (PARTITION BY datetime) AS n, row_number() OVER (PARTITION BY datetime ORDER BY score DESC, instrument) AS a, row_number() OVER (PARTITION BY datetime ORDER BY score, instrument) AS c,
     CASE WHEN l IS NOT NULL THEN row_number() OVER (PARTITION BY datetime ORDER BY l DESC NULLS LAST, instrument) END AS b, CASE WHEN l IS NOT NULL THEN row_number() OVER (PARTITION BY datetime ORDER BY l NULLS LAST, instrument) END AS e
     FROM (SELECT *, lag(score) OVER (PARTITION BY instrument ORDER BY datetime) AS l FROM scores)) GROUP BY 1""", *SC))
def _(s, d):
    return rounded(G.turnover(scores(s, d)))


@query("monthly_ic", sql(f"SELECT CAST(date_trunc('month', datetime) AS TIMESTAMP) AS month, {rq('avg(ic)')} AS ic FROM ic GROUP BY 1", *SC, RANKED, IC))
def _(s, d):
    return rounded(G.monthly_ic(G.ic_by_date(scores(s, d))))


@query("signals_threshold", sql(f"SELECT instrument, datetime, CASE WHEN score > 10 THEN 'BUY' WHEN score < -10 THEN 'SELL' ELSE 'HOLD' END AS signal, {rq('greatest(-20, least(20, score))')} AS position_size FROM scores", *SC))
def _(s, d):
    return rounded(G.threshold_signals(scores(s, d), 10, -10, -20, 20).select("instrument", "datetime", "signal", "position_size"))


@query("signals_scaled", sql(f"SELECT instrument, datetime, CASE WHEN score >= 10 THEN 'BUY' WHEN score <= -10 THEN 'SELL' ELSE 'HOLD' END AS signal, {rq('greatest(0, least(1, (score + 10) / 20)) * 0.5')} AS position_size FROM scores", *SC))
def _(s, d):
    return rounded(G.scaled_signals(scores(s, d), 10, -10, 0.5).select("instrument", "datetime", "signal", "position_size"))


@query("feature_stats", sql(f"""SELECT datetime, count(DISTINCT label) AS n_distinct, {rq('count(DISTINCT label) / count(*)')} AS distinct_ratio, 0::BIGINT AS n_inf, count(*) - count(label) AS n_missing, {rq('1 - count(label) / count(*)')} AS missing_ratio,
    {rq('avg(label)')} AS mean, {rq('stddev_samp(label)')} AS std, {rq('CASE WHEN count(label) >= 3 THEN skewness(label) END', 5)} AS skew, {rq('CASE WHEN count(label) >= 4 THEN kurtosis(label) END', 4)} AS kurt FROM scores GROUP BY 1""", *SC))
def _(s, d):
    f = G.feature_stats(scores(s, d), "label")
    return f.select(*[r(c, {"skew": 5, "kurt": 4}.get(c, 6)).alias(c) if t == "double" else F.col(c) for c, t in f.dtypes])


@query("feature_autocorr", sql(f"""SELECT datetime, feature, {rq('CASE WHEN count(l) FILTER (v IS NOT NULL) > 1 AND var_pop(v) FILTER (l IS NOT NULL) > 0 AND var_pop(l) FILTER (v IS NOT NULL) > 0 THEN corr(v, l) END')} AS autocorr FROM
    (SELECT datetime, 'close' AS feature, close AS v, lag(close) OVER w AS l FROM bars_d WINDOW w AS (PARTITION BY instrument ORDER BY datetime) UNION ALL
     SELECT datetime, 'volume', volume, lag(volume) OVER w FROM bars_d WINDOW w AS (PARTITION BY instrument ORDER BY datetime)) GROUP BY 1, 2""", "bars_d"))
def _(s, d):
    return rounded(G.feature_autocorr(bars_d(s, d).df, ["close", "volume"]))
