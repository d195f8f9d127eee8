"""Cross-sectional and fitted processors."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataline.functions.scalar import ieee_div
from strataline.operators import processors as P
from strataline.queries.common import bars_d, query, r, rounded, rq, scores, sql

FIT = ("2024-01-03", "2024-01-20")
INFIT = "datetime BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-20'"
COLS = ["close", "volume"]


def base(s, d):
    return bars_d(s, d).df.select("instrument", "datetime", "close", "volume")


def each(template, n=6, cols=COLS):
    """SELECT list applying a template to each column."""
    return ", ".join(f"{rq(template.format(c=c), n)} AS {c}" for c in cols)


def fitted_sql(aggs, template, n=6, cols=COLS, src="bars_d"):
    inner = ", ".join(f"{fn.format(c=c)} AS {k}_{c}" for c in cols for k, fn in aggs.items())
    return sql(f"SELECT instrument, datetime, {each(template, n, cols)} FROM {src}, (SELECT {inner} FROM {src} WHERE {INFIT})", "bars_d")


@query("norm_minmax", fitted_sql({"lo": "min({c})", "hi": "max({c})"}, "({c} - lo_{c}) / (hi_{c} - lo_{c})"))
def _(s, d):
    df = base(s, d)
    return rounded(P.MinMax(COLS).fit(df, *FIT).transform(df))


@query("norm_zscore", fitted_sql({"m": "avg({c})", "s": "stddev_pop({c})"}, "({c} - m_{c}) / s_{c}"))
def _(s, d):
    df = base(s, d)
    return rounded(P.ZScore(COLS).fit(df, *FIT).transform(df))


@query("norm_robust", sql(f"SELECT instrument, datetime, {each('greatest(-3, least(3, ({c} - m_{c}) / ((d_{c} + 1e-12) * 1.4826)))')} FROM bars_d, meds, (SELECT "
    + ", ".join(f"median(abs({c} - m_{c})) AS d_{c}" for c in COLS) + f" FROM bars_d, meds WHERE {INFIT})", "bars_d",
    f"meds AS (SELECT median(close) AS m_close, median(volume) AS m_volume FROM bars_d WHERE {INFIT})"))
def _(s, d):
    df = base(s, d)
    return rounded(P.RobustZScore(COLS).fit(df, *FIT).transform(df))


CS = "OVER (PARTITION BY datetime)"


@query("cs_zscore", sql(f"SELECT instrument, datetime, {each(f'CASE WHEN stddev_samp({{c}}) {CS} > 0 THEN ({{c}} - avg({{c}}) {CS}) / stddev_samp({{c}}) {CS} END')} FROM bars_d", "bars_d"))
def _(s, d):
    return rounded(P.DateZScore(COLS).transform(base(s, d)))


ROBUST = """rob AS (SELECT b.*, m_close, m_volume, median(abs(close - m_close)) OVER (PARTITION BY b.datetime) AS d_close, median(abs(volume - m_volume)) OVER (PARTITION BY b.datetime) AS d_volume
    FROM bars_d b JOIN (SELECT datetime, median(close) AS m_close, median(volume) AS m_volume FROM bars_d GROUP BY 1) m ON m.datetime = b.datetime)"""
RZ = "greatest(-3, least(3, ({c} - m_{c}) / (d_{c} * 1.4826)))"


@query("cs_robust_zscore", sql(f"SELECT instrument, datetime, {each(RZ)} FROM rob", "bars_d", ROBUST))
def _(s, d):
    return rounded(P.DateZScore(COLS, "robust").transform(base(s, d)))


@query("robust_zscore_helper", sql(f"SELECT instrument, datetime, {rq('(z - avg(z) OVER (PARTITION BY datetime)) / stddev_samp(z) OVER (PARTITION BY datetime)')} AS z FROM (SELECT *, {RZ.format(c='close')} AS z FROM rob)", "bars_d", ROBUST))
def _(s, d):
    return rounded(P.robust_zscore(base(s, d), "close", "z", zscore=True).select("instrument", "datetime", "z"))


def avg_rank(c, part):
    return f"(rank() OVER (PARTITION BY {part} ORDER BY {c}) + (count(*) OVER (PARTITION BY {part}, {c}) - 1) / 2.0)"


@query("cs_rank", sql(f"SELECT instrument, datetime, {each('((' + avg_rank('{c}', 'datetime') + ') / count({c}) OVER (PARTITION BY datetime) - 0.5) * 3.46')} FROM bars_d", "bars_d"))
def _(s, d):
    return rounded(P.DateRank(COLS).transform(base(s, d)))


@query("cs_fill", sql(f"SELECT instrument, datetime, {rq(f'coalesce(v, avg(v) {CS})')} AS v FROM (SELECT *, CASE WHEN close > 20 THEN close END AS v FROM bars_d)", "bars_d"))
def _(s, d):
    df = base(s, d).select("instrument", "datetime", F.when(F.col("close") > 20, F.col("close")).alias("v"))
    return rounded(P.DateFill(["v"]).transform(df))


@query("replace_inf", sql(f"SELECT instrument, datetime, {rq(f'CASE WHEN close < 5 THEN avg(CASE WHEN close >= 5 THEN close END) {CS} ELSE close END')} AS v FROM bars_d", "bars_d"))
def _(s, d):
    df = base(s, d).select("instrument", "datetime", F.when(F.col("close") < 5, F.lit(float("inf"))).otherwise(F.col("close")).alias("v"))
    return rounded(P.ReplaceInf(["v"]).transform(df))


@query("fill_tanh_cast", sql(f"SELECT instrument, datetime, {rq('tanh(coalesce(v, 0.5) - 1)')} AS v, CAST(round(\"LABEL0\") AS TINYINT) AS \"LABEL0\" FROM (SELECT *, CASE WHEN close > 20 THEN close / 50 END AS v, close % 50 AS \"LABEL0\" FROM bars_d)", "bars_d"))
def _(s, d):
    df = base(s, d).select("instrument", "datetime", F.when(F.col("close") > 20, F.col("close") / 50).alias("v"), (F.col("close") % 50).alias("LABEL0"))
    df = P.Tanh().transform(P.FillMissing(["v"], 0.5).transform(df)).withColumn("LABEL0", F.round("LABEL0"))
    return rounded(P.CastColumns(["LABEL0"], "tinyint").transform(df))


SEC = {"KUP2": "greatest(high - greatest(open, close), 0)", "MA5": "avg(close) OVER (PARTITION BY instrument ORDER BY datetime ROWS 4 PRECEDING) / close", "STD5": "volume + 1"}


def section_sql():
    def norm(src, out, cols):
        med = f"{out}_m AS (SELECT datetime, {', '.join(f'median({c}) AS m_{c}' for c in cols)} FROM {src} GROUP BY 1)"
        cen = f"{out}_c AS (SELECT s.instrument, s.datetime, {', '.join(f's.{c} - m_{c} AS {c}' for c in cols)} FROM {src} s JOIN {out}_m m ON m.datetime = s.datetime)"
        mad = f"{out}_d AS (SELECT datetime, {', '.join(f'median(abs({c})) AS d_{c}' for c in cols)} FROM {out}_c GROUP BY 1)"
        z = f"{out}_z AS (SELECT c.instrument, c.datetime, {', '.join(f'CASE WHEN d_{c} <> 0 THEN c.{c} / (d_{c} * 1.4826) END AS {c}' for c in cols)} FROM {out}_c c JOIN {out}_d d ON d.datetime = c.datetime)"
        hi = f"{out}_h AS (SELECT instrument, datetime, {', '.join(f'CASE WHEN {c} > 3 THEN 3 + ({c} - 3) / (max({c}) OVER (PARTITION BY datetime) - 3) * 0.5 ELSE {c} END AS {c}' for c in cols)} FROM {out}_z)"
        lo = f"{out} AS (SELECT instrument, datetime, {', '.join(f'coalesce(CASE WHEN {c} < -3 THEN -3 - ({c} + 3) / (min({c}) OVER (PARTITION BY datetime) + 3) * 0.5 ELSE {c} END, 0) AS {c}' for c in cols)} FROM {out}_h)"
        return [med, cen, mad, z, hi, lo]
    ctes = [f"f0 AS (SELECT instrument, datetime, {', '.join(f'{v} AS {k}' for k, v in SEC.items())} FROM bars_d)",
            "f1 AS (SELECT instrument, datetime, pow(KUP2, 0.25) AS KUP2, MA5, ln(STD5) AS STD5 FROM f0)"]
    ctes += norm("f1", "g1", ["KUP2", "MA5", "STD5"])
    ctes.append("f2 AS (SELECT instrument, datetime, CASE WHEN KUP2 >= 0 THEN pow(KUP2, 0.5) END AS KUP2 FROM g1)")
    ctes += norm("f2", "g2", ["KUP2"])
    return sql(f"SELECT g1.instrument, g1.datetime, {rq('g2.KUP2', 4)} AS KUP2, {rq('g1.MA5', 4)} AS MA5, {rq('g1.STD5', 4)} AS STD5 FROM g1 JOIN g2 ON g1.instrument = g2.instrument AND g1.datetime = g2.datetime", "bars_d", *ctes)


@query("section_norm", section_sql())
def _(s, d):
    from strataline.plans import expr as E
    from strataline.plans.evaluate import features
    O, H, C, V = (E.field(n) for n in ("open", "high", "close", "volume"))
    df = features(bars_d(s, d), {"KUP2": E.greater(H - E.greater(O, C), 0), "MA5": E.mean(C, 5), "close": C, "STD5": V + 1})
    df = df.select("instrument", "datetime", "KUP2", ieee_div(F.col("MA5"), F.col("close")).alias("MA5"), "STD5")
    return rounded(P.SectionNorm(["KUP2", "MA5", "STD5"]).transform(df), n=4)


BLOCKS = {"price": ["open", "close"], "volume": ["volume"]}


@query("block_norm", sql(f"""SELECT instrument, datetime, {rq('(open - pm) / ps')} AS "open", {rq('(close - pm) / ps')} AS "close", {rq('(ln(1 + volume) - vm) / vs')} AS volume FROM bars_d, st,
    (SELECT stddev_pop(abs(v - pm)) AS ps FROM pv, st), (SELECT stddev_pop(abs(ln(1 + volume) - vm)) AS vs FROM bars_d, st WHERE {INFIT})""", "bars_d",
    f"pv AS (SELECT open AS v FROM bars_d WHERE {INFIT} UNION ALL SELECT close FROM bars_d WHERE {INFIT})",
    f"st AS (SELECT (SELECT avg(v) FROM pv) AS pm, (SELECT avg(ln(1 + volume)) FROM bars_d WHERE {INFIT}) AS vm)"))
def _(s, d):
    df = bars_d(s, d).df.select("instrument", "datetime", "open", "close", "volume")
    return rounded(P.BlockNorm(BLOCKS).fit(df, *FIT).transform(df))


def _squash(z, hi, lo):
    return f"CASE WHEN {z} > 3 THEN least(3 + ({z} - 3) / ({hi} - 3) * 0.5, 3.5) WHEN {z} < -3 THEN greatest(-3 - ({z} + 3) / ({lo} + 3) * 0.5, -3.5) ELSE {z} END"


@query("block_norm_robust", sql(f"""SELECT instrument, datetime, {rq(_squash('po', 'ph', 'pl'))} AS "open", {rq(_squash('pc', 'ph', 'pl'))} AS "close", {rq(_squash('vz', 'vh', 'vl'))} AS volume FROM
    (SELECT *, (open - pm) / ps AS po, (close - pm) / ps AS pc, (ln(1 + volume) - vm) / vs AS vz FROM bars_d, st, sc),
    (SELECT max((v - pm) / ps) AS ph, min((v - pm) / ps) AS pl FROM pv, st, sc),
    (SELECT max((ln(1 + volume) - vm) / vs) AS vh, min((ln(1 + volume) - vm) / vs) AS vl FROM bars_d, st, sc WHERE {INFIT})""", "bars_d",
    f"pv AS (SELECT open AS v FROM bars_d WHERE {INFIT} UNION ALL SELECT close FROM bars_d WHERE {INFIT})",
    f"st AS (SELECT (SELECT median(v) FROM pv) AS pm, (SELECT median(ln(1 + volume)) FROM bars_d WHERE {INFIT}) AS vm)",
    f"sc AS (SELECT (SELECT median(abs(v - pm)) FROM pv, st) * 1.4826 + 1e-12 AS ps, (SELECT median(abs(ln(1 + volume) - vm)) FROM bars_d, st WHERE {INFIT}) * 1.4826 + 1e-12 AS vs)"))
def _(s, d):
    df = bars_d(s, d).df.select("instrument", "datetime", "open", "close", "volume")
    return rounded(P.BlockNorm(BLOCKS, robust=True).fit(df, *FIT).transform(df))


@query("processor_views", sql(f"""SELECT 'infer' AS "view", instrument, datetime, {rq('score')} AS score, {rq('label', 5)} AS label FROM z UNION ALL
    SELECT 'learn', instrument, datetime, {rq('score')}, {rq(f'CASE WHEN stddev_samp(label) {CS} > 0 THEN (label - avg(label) {CS}) / stddev_samp(label) {CS} END', 5)} FROM z WHERE label IS NOT NULL""",
    "bars_d", "lagged_d", "scores", f"z AS (SELECT instrument, datetime, (score - m) / sd AS score, label FROM scores, (SELECT avg(score) AS m, stddev_pop(score) AS sd FROM scores WHERE {INFIT}))"))
def _(s, d):
    v = P.Pipeline(infer=[P.ZScore(["score"])], learn=[P.DropMissingLabel(["label"]), P.DateZScore(["label"])]).fit(scores(s, d), *FIT)
    out = v["infer"].withColumn("view", F.lit("infer")).unionByName(v["learn"].withColumn("view", F.lit("learn")))
    return out.select("view", "instrument", "datetime", r("score").alias("score"), r("label", 5).alias("label"))


@query("refit_per_split", sql(f"""SELECT instrument, datetime, split, {rq('(close - m) / sd')} AS close FROM
    (SELECT b.instrument, b.datetime, b.close, s.split, s.m, s.sd FROM bars_d b JOIN
     (SELECT k AS split, avg(close) AS m, stddev_pop(close) AS sd FROM bars_d, (SELECT unnest([0, 1]) AS k)
      WHERE datetime BETWEEN TIMESTAMP '2024-01-01' + to_days(CAST(7 * k AS INTEGER)) AND TIMESTAMP '2024-01-10' + to_days(CAST(7 * k AS INTEGER)) GROUP BY 1) s
     ON b.datetime BETWEEN TIMESTAMP '2024-01-11' + to_days(CAST(7 * s.split AS INTEGER)) AND TIMESTAMP '2024-01-17' + to_days(CAST(7 * s.split AS INTEGER)))""", "bars_d"))
def _(s, d):
    df = base(s, d).drop("volume")
    splits = [{"train": ("2024-01-01", "2024-01-10"), "test": ("2024-01-11", "2024-01-17")},
              {"train": ("2024-01-08", "2024-01-17"), "test": ("2024-01-18", "2024-01-24")}]
    return rounded(P.refit_per_split(df, lambda: P.ZScore(["close"]), splits))


@query("date_apply", sql(f"SELECT instrument, datetime, {rq(f'close - max(close) {CS}')} AS below_top FROM bars_d", "bars_d"))
def _(s, d):
    def gap(pdf):
        pdf["below_top"] = pdf["close"] - pdf["close"].max()
        return pdf[["instrument", "datetime", "below_top"]]
    return rounded(P.apply_by_date(base(s, d), gap, "instrument string, datetime timestamp_ntz, below_top double"))


@query("weight_by_time", sql("""SELECT instrument, datetime, CASE WHEN datetime BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-12' THEN 2.0::DOUBLE
    WHEN datetime BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-10' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM bars_d""", "bars_d"))
def _(s, d):
    return P.weight_by_time(base(s, d), [("2024-01-05", "2024-01-10", 0.5), ("2024-01-08", "2024-01-12", 2.0)]).select("instrument", "datetime", "weight")


def g_rank(c):
    return f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0) / count(*) OVER ()"


@query("weight_by_loss", sql(f"""SELECT instrument, datetime, CAST(bin AS INTEGER) AS bin, {rq('1.0 / (0.25 * avg(h) OVER (PARTITION BY bin) + 0.1)')} AS weight FROM
    (SELECT *, greatest(1, least(10, ceil((h - min(h) OVER ()) / ((max(h) OVER () - min(h) OVER ()) / 10)))) AS bin FROM
     (SELECT instrument, datetime, h1 + {g_rank('ratio')} AS h FROM (SELECT instrument, datetime, {g_rank('-close')} AS h1, ({g_rank('low')}) / ({g_rank('high')}) AS ratio FROM bars_d)))""", "bars_d"))
def _(s, d):
    df = bars_d(s, d).df.select("instrument", "datetime", "high", "low", "close")
    out = P.weight_by_loss(df, ["high", "low"], "close", k=2)
    return out.select("instrument", "datetime", "bin", r("weight").alias("weight"))
