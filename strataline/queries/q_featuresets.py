"""Feature sets over hourly bars and daily supplier bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataline.operators import orderbook as B
from strataline.plans import expr as E
from strataline.plans import featuresets as FS
from strataline.plans.evaluate import Panel, features, on_instrument
from strataline.queries.common import ORACLE, bars_d, bars_h, query, r, rounded, rounded_fast, rq, sql, supp_d, table, ticks

EPS = "1e-12"


def window_defs(ns):
    return ", ".join(f"w{n} AS (PARTITION BY instrument ORDER BY datetime ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in ns)


def div(a, b):
    return f"CASE WHEN ({b}) <> 0 THEN ({a}) / ({b}) END"


def _balance_sql(x, n):
    up, down, mv = (f"(sum({x}{k}) OVER w{n})" for k in ("_up", "_dn", "_mv"))
    return f"{up} / ({mv} + {EPS})", f"{down} / ({mv} + {EPS})", f"({up} - {down}) / ({mv} + {EPS})"


FLAT = "stddev_samp({0}) OVER w{1} > 2e-5"


def factors158_sql(ns=(5, 10, 20, 30, 60), include=None, digits=4):
    """SQL twin of the 158-factor set, written from the published factor formulas."""
    c = {}
    c["KMID"], c["KLEN"], c["KMID2"] = div("close - open", "open"), div("high - low", "open"), f"(close - open) / (high - low + {EPS})"
    c["KUP"], c["KUP2"] = div("high - greatest(open, close)", "open"), f"(high - greatest(open, close)) / (high - low + {EPS})"
    c["KLOW"], c["KLOW2"] = div("least(open, close) - low", "open"), f"(least(open, close) - low) / (high - low + {EPS})"
    c["KSFT"], c["KSFT2"] = div("2 * close - high - low", "open"), f"(2 * close - high - low) / (high - low + {EPS})"
    for f in ("open", "high", "low", "vwap"):
        c[f"{f.upper()}0"] = div(f, "close")
    for n in ns:
        w = f"OVER w{n}"
        some = f"count(close) {w} > 1"
        per = {
            "ROC": ("ROC", div(f"lag(close, {n}) OVER w", "close")), "MA": ("MA", div(f"avg(close) {w}", "close")),
            "STD": ("STD", div(f"stddev_samp(close) {w}", "close")),
            "BETA": ("BETA", f"CASE WHEN {some} THEN (regr_slope(close, pos) {w}) / close END"),
            "RSQR": ("RSQR", f"CASE WHEN {some} AND stddev_samp(close) {w} > 2e-5 THEN regr_r2(close, pos) {w} END"),
            "RESI": ("RESI", f"CASE WHEN {some} THEN (close - (avg(close) {w} + (regr_slope(close, pos) {w}) * (pos - avg(pos) {w}))) / close END"),
            "MAX": ("MAX", div(f"max(high) {w}", "close")), "LOW": ("MIN", div(f"min(low) {w}", "close")),
            "QTLU": ("QTLU", div(f"quantile_cont(close, 0.8) {w}", "close")), "QTLD": ("QTLD", div(f"quantile_cont(close, 0.2) {w}", "close")),
            "RANK": ("RANK", f"(len(list_filter(lc{n}, lambda v: v < close)) + (len(list_filter(lc{n}, lambda v: v = close)) + 1) / 2.0) / len(lc{n})"),
            "RSV": ("RSV", f"(close - min(low) {w}) / (max(high) {w} - min(low) {w} + {EPS})"),
            "IMAX": ("IMAX", f"list_position(lh{n}, list_max(lh{n})) / {n}.0"), "IMIN": ("IMIN", f"list_position(ll{n}, list_min(ll{n})) / {n}.0"),
            "IMXD": ("IMXD", f"(list_position(lh{n}, list_max(lh{n})) - list_position(ll{n}, list_min(ll{n}))) / {n}.0"),
            "CORR": ("CORR", f"CASE WHEN {some} AND {FLAT.format('close', n)} AND {FLAT.format('lv', n)} THEN corr(close, lv) {w} END"),
            "CORD": ("CORD", f"CASE WHEN count(cr) {w} > 1 AND {FLAT.format('cr', n)} AND {FLAT.format('vr', n)} THEN corr(cr, vr) {w} END"),
            "CNTP": ("CNTP", f"avg(upd) {w}"), "CNTN": ("CNTN", f"avg(dnd) {w}"), "CNTD": ("CNTD", f"avg(upd) {w} - avg(dnd) {w}"),
            "SUMP": ("SUMP", _balance_sql("c", n)[0]), "SUMN": ("SUMN", _balance_sql("c", n)[1]), "SUMD": ("SUMD", _balance_sql("c", n)[2]),
            "VMA": ("VMA", f"(avg(volume) {w}) / (volume + {EPS})"), "VSTD": ("VSTD", f"(stddev_samp(volume) {w}) / (volume + {EPS})"),
            "WVMA": ("WVMA", f"(stddev_samp(wv) {w}) / (avg(wv) {w} + {EPS})"),
            "VSUMP": ("VSUMP", _balance_sql("v", n)[0]), "VSUMN": ("VSUMN", _balance_sql("v", n)[1]), "VSUMD": ("VSUMD", _balance_sql("v", n)[2]),
        }
        for fam, (prefix, e) in per.items():
            if include is None or fam in include:
                c[f"{prefix}{n}"] = e
    lists = ", ".join(f"list(close) OVER w{n} AS lc{n}, list(high) OVER w{n} AS lh{n}, list(low) OVER w{n} AS ll{n}" for n in ns)
    body = ", ".join(f"{rq(v, digits)} AS {k}" for k, v in c.items())
    return body, lists


def factor_query(src, ns=(5, 10, 20, 30, 60), include=None, digits=4, only=None):
    body, lists = factors158_sql(ns, include, digits)
    w = f"WINDOW w AS (PARTITION BY instrument ORDER BY datetime), {window_defs(ns)}"
    return sql(f"SELECT instrument, datetime, {body} FROM (SELECT *, {lists} FROM prep {w}) {w}", src, f"""
        raw AS (SELECT *, row_number() OVER w AS pos, lag(close) OVER w AS p, lag(volume) OVER w AS q FROM {src}
            WINDOW w AS (PARTITION BY instrument ORDER BY datetime))""", """
        prep AS (SELECT *, ln(volume + 1) AS lv, close / p AS cr, ln(volume / q + 1) AS vr,
            CAST(coalesce(close > p, false) AS DOUBLE) AS upd, CAST(coalesce(close < p, false) AS DOUBLE) AS dnd,
            CASE WHEN p IS NOT NULL THEN greatest(close - p, 0) END AS c_up, CASE WHEN p IS NOT NULL THEN greatest(p - close, 0) END AS c_dn, abs(close - p) AS c_mv,
            CASE WHEN q IS NOT NULL THEN greatest(volume - q, 0) END AS v_up, CASE WHEN q IS NOT NULL THEN greatest(q - volume, 0) END AS v_dn, abs(volume - q) AS v_mv,
            abs(close / p - 1) * volume AS wv FROM raw)""")


@query("factors158_hourly", factor_query("bars_h"))
def _(s, d):
    return rounded(features(bars_h(s, d), FS.factors158()), n=4)


@query("factors158_daily_suppliers", factor_query("supp_d"))
def _(s, d):
    return rounded_fast(features(Panel(supp_d(s, d).df, arrays=True), FS.factors158()), n=4)


FAST = ("ROC", "MA", "STD", "BETA", "MAX", "LOW", "RSV", "CNTP", "SUMP", "VMA", "VSTD")


@query("factors_daily_suppliers", factor_query("supp_d", (5, 20), FAST))
def _(s, d):
    return rounded_fast(features(supp_d(s, d), FS.factors158(windows=(5, 20), include=FAST)), n=4)


# the shape of the published speed task: fourteen factors from daily bars
FOURTEEN = ("KMID", "KLEN", "ROC5", "MA5", "STD5", "BETA5", "MAX5", "MIN5", "RSV5", "ROC20", "MA20", "STD20", "VMA20", "WVMA20")


@query("factors14_daily_suppliers", sql("SELECT instrument, datetime, " + ", ".join(FOURTEEN) + " FROM (" + factor_query(
    "supp_d", (5, 20), ("ROC", "MA", "STD", "BETA", "MAX", "LOW", "RSV", "VMA", "WVMA")) + ")", "one AS (SELECT 1)"))
def _(s, d):
    every = FS.factors158(windows=(5, 20))
    return rounded(features(supp_d(s, d), {k: every[k] for k in FOURTEEN}), n=4)


def lags_sql(depth):
    cols = []
    for f in ("close", "open", "high", "low", "vwap", "volume"):
        base = f"(volume + {EPS})" if f == "volume" else "close"
        cols += [f"{rq(f'lag({f}, {k}) OVER w / {base}', 4)} AS {f.upper()}{k}" for k in range(depth)]
    return sql(f"SELECT instrument, datetime, {', '.join(cols)} FROM bars_h WINDOW w AS (PARTITION BY instrument ORDER BY datetime)", "bars_h")


@query("lags360_hourly", lags_sql(60))
def _(s, d):
    return rounded(features(bars_h(s, d), FS.lags360()), n=4)


@query("labels_forward", sql(f"""SELECT instrument, datetime, {rq('lead(close, 2) OVER w / lead(close, 1) OVER w - 1')} AS label_close,
    {rq('lead(vwap, 6) OVER w / lead(vwap, 1) OVER w - 1')} AS label_vwap FROM bars_h
    WINDOW w AS (PARTITION BY instrument ORDER BY datetime)""", "bars_h"))
def _(s, d):
    return rounded(features(bars_h(s, d), {"label_close": FS.forward_label(), "label_vwap": FS.forward_label("vwap", 5)}))


# ------------------------------------------------------------------ minute sets on hourly bars (24 rows per day)

def _paused(p: Panel) -> Panel:
    """Bars with holes and an active-row counter derived from them."""
    hole = F.col("volume") % 7 < 1
    df = p.df.select("instrument", "datetime", *[F.when(~hole, F.col(c)).alias(c) for c in ("open", "high", "low", "close", "vwap", "volume")],
                     F.when(F.col("volume") % 5 < 1, 1.0).otherwise(2.0).alias("paused_num"), F.lit(1.0).alias("factor"))
    return Panel(df)


PAUSED = """paused AS (SELECT instrument, datetime, CASE WHEN NOT hole THEN open END AS open, CASE WHEN NOT hole THEN high END AS high,
    CASE WHEN NOT hole THEN low END AS low, CASE WHEN NOT hole THEN close END AS close, CASE WHEN NOT hole THEN vwap END AS vwap,
    CASE WHEN NOT hole THEN volume END AS volume, CASE WHEN volume % 5 < 1 THEN 1.0 ELSE 2.0 END AS paused_num FROM
    (SELECT *, volume % 7 < 1 AS hole FROM bars_h))"""


def _norm(f, lag):
    v = f"coalesce({f}, close)"
    return f"(lag({v}, {lag}) OVER w)" if lag else v


def minute_sql():
    out = []
    for lag, tag in ((0, ""), (24, "_1")):
        for f in ("open", "high", "low", "close", "vwap"):
            out.append((f + tag, f"{_norm(f, lag)} / base"))
    ff = ", ".join(f"{rq(f'last_value({k}_raw IGNORE NULLS) OVER x', 5)} AS {k}" for k, _ in out)
    raw = ", ".join(f"{e} AS {k}_raw" for k, e in out)
    vol = "CASE WHEN {0} >= 0 THEN {0} ELSE 0 END"
    return sql(f"""SELECT instrument, datetime, {ff}, {rq(vol.format('coalesce(volume / lm, 0)'), 5)} AS volume,
        {rq(vol.format('coalesce(v1 / lm, 0)'), 5)} AS volume_1 FROM
        (SELECT *, {raw}, lag(volume, 24) OVER w AS v1, lag(dl, 24) OVER w AS lm FROM
          (SELECT *, last_value(b IGNORE NULLS) OVER dd AS base, last_value(m IGNORE NULLS) OVER dd AS dl FROM
            (SELECT *, lag(fc, 27) OVER w AS b, avg(volume) OVER wl AS m FROM
              (SELECT *, last_value(close IGNORE NULLS) OVER x AS fc FROM paused {X}) {WL}) {DD}) {WL}) {X}""", "bars_h", PAUSED) \
        .replace("SELECT instrument, datetime, (round", "SELECT instrument, datetime, paused_num, (round", 1)


X = "WINDOW x AS (PARTITION BY instrument ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
WL = "WINDOW w AS (PARTITION BY instrument ORDER BY datetime), wl AS (PARTITION BY instrument ORDER BY datetime ROWS 119 PRECEDING)"
DD = "WINDOW dd AS (PARTITION BY instrument, CAST(datetime AS DATE) ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"


@query("minute_features", "SELECT * EXCLUDE (paused_num) FROM (" + minute_sql() + ") WHERE paused_num > 1.001")
def _(s, d):
    return rounded(features(_paused(bars_h(s, d)), FS.minute_features(24, volume_mean_days=5), keep_rows=FS.trading()), n=5)


@query("minute_backtest_fields", sql(f"""SELECT instrument, datetime, {rq('fc')} AS close0, {rq('coalesce(vwap, fc)')} AS vwap0,
    {rq('coalesce(volume, 0)', 4)} AS volume0, 1.0::DOUBLE AS factor0 FROM (SELECT *, last_value(close IGNORE NULLS) OVER x AS fc FROM paused {X})
    WHERE paused_num > 1.001""", "bars_h", PAUSED))
def _(s, d):
    df = features(_paused(bars_h(s, d)), FS.minute_backtest_fields(), keep_rows=FS.trading())
    return df.select("instrument", "datetime", r("close0").alias("close0"), r("vwap0").alias("vwap0"),
                     r("volume0", 4).alias("volume0"), "factor0")


@query("cut_edges", sql("""SELECT instrument, datetime, close FROM (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY datetime) AS a,
    row_number() OVER (PARTITION BY instrument ORDER BY datetime DESC) AS b FROM bars_h) WHERE a > 48 AND b > 5""", "bars_h"))
def _(s, d):
    from strataline.operators.filters import cut_edges
    return cut_edges(bars_h(s, d), 48, 5).select("instrument", "datetime", "close")


# ------------------------------------------------------------------ order book derived from events

def _book(s, d, levels=3):
    e = table(s, d, "events")
    v = F.col("value")
    cols = []
    for i in range(1, levels + 1):
        cols += [(v + 0.01 * i).alias(f"ask{i}"), (v - 0.02 * i).alias(f"bid{i}"),
                 (F.col("user_id") % 7 + i).cast("double").alias(f"asize{i}"), (F.col("event_id") % 5 + i).cast("double").alias(f"bsize{i}")]
    return e.select(F.col("event_type").alias("instrument"), F.col("ts").alias("datetime"), *cols)


BOOK = """book AS (SELECT event_type AS instrument, ts AS datetime, time_bucket(INTERVAL 1 HOUR, ts) AS b, """ + ", ".join(
    f"value + {0.01 * i} AS ask{i}, value - {0.02 * i} AS bid{i}, CAST(user_id % 7 + {i} AS DOUBLE) AS asize{i}, CAST(event_id % 5 + {i} AS DOUBLE) AS bsize{i}"
    for i in (1, 2, 3)) + " FROM events)"
ALLA, ALLB = "(asize1 + asize2 + asize3)", "(bsize1 + bsize2 + bsize3)"


def book_sql():
    vol = f"sum({ALLA} + {ALLB})"
    touch = "(arg_max(ask1, datetime) + arg_max(bid1, datetime))"
    last = lambda e: f"arg_max({e}, datetime)"
    c = {}
    for sd, tot in (("asize", ALLA), ("bsize", ALLB)):
        for i in (1, 2, 3):
            c[f"v_{sd}_{i}"] = div(f"avg({sd}{i})", vol)
        c[f"v_avg_{sd}"] = div(f"avg({tot}) / 3", vol)
    for i in (1, 2, 3):
        c[f"p_spread_{i}"] = div(f"2 * {last(f'ask{i} - bid{i}')}", touch)
        c[f"p_mid_{i}"] = div(f"2 * {last(f'(ask{i} + bid{i}) / 2')}", touch)
    for sd in ("ask", "bid"):
        for i in (1, 2):
            c[f"p_diff_{sd}_{i}_{i + 1}"] = div(f"2 * {last(f'abs({sd}{i + 1} - {sd}{i})')}", touch)
    c["p_diff_ask_3_1"], c["p_diff_bid_1_3"] = div(f"2 * {last('abs(ask3 - ask1)')}", touch), div(f"2 * {last('abs(bid1 - bid3)')}", touch)
    c["p_accspread"] = div(f"2 * ({last('ask1 + ask2 + ask3')} - {last('bid1 + bid2 + bid3')})", touch)
    c["v_accspread"] = div(f"avg({ALLA}) - avg({ALLB})", vol)
    return sql("SELECT instrument, b AS datetime, " + ", ".join(f"{rq(v, 5)} AS {k}" for k, v in c.items()) + " FROM book GROUP BY 1, 2", BOOK)


@query("orderbook_depth_spread", book_sql())
def _(s, d):
    return rounded(B.book_features(_book(s, d), "1 hour", 3), n=5)


def change_sql():
    cols = [f"{a}{i}" for a in ("bid", "ask") for i in (1, 2, 3)]
    sizes = [f"{a}{i}" for a in ("asize", "bsize") for i in (1, 2, 3)]
    sm = ", ".join([f"arg_max({c}, datetime) AS {c}" for c in cols] + [f"avg({c}) AS {c}" for c in sizes])
    mv = ", ".join(f"CASE WHEN b - lag(b) OVER w = INTERVAL 5 MINUTE THEN 2.0 / 5 * ({c} - lag({c}) OVER w) END AS {c}" for c in cols + sizes)
    out = ", ".join(f"{rq(div(f'm.{c}', 't.v' if 'size' in c else 't.touch'), 5)} AS {'v' if 'size' in c else 'p'}_diff_{c}_5m" for c in cols + sizes)
    return sql(f"""SELECT t.instrument, t.b AS datetime, {out} FROM (SELECT instrument, b, arg_max(ask1, datetime) + arg_max(bid1, datetime) AS touch,
        sum({ALLA} + {ALLB}) AS v FROM book GROUP BY 1, 2) t LEFT JOIN (SELECT instrument, time_bucket(INTERVAL 1 HOUR, b) AS h, {', '.join(f'avg({c}) AS {c}' for c in cols + sizes)}
        FROM (SELECT instrument, b, {mv} FROM (SELECT instrument, time_bucket(INTERVAL 5 MINUTE, datetime) AS b, {sm} FROM book GROUP BY 1, 2)
        WINDOW w AS (PARTITION BY instrument ORDER BY b)) GROUP BY 1, 2) m ON m.instrument = t.instrument AND m.h = t.b""", BOOK)


@query("orderbook_changes", change_sql())
def _(s, d):
    return rounded(B.change_features(_book(s, d), "1 hour", "5 minutes", 3), n=5)


def _flow(s, d):
    e = table(s, d, "events")
    return e.select(F.col("event_type").alias("instrument"), F.col("ts").alias("datetime"),
                    F.when(F.col("event_id") % 3 == 0, 66.0).when(F.col("event_id") % 3 == 1, 83.0).otherwise(67.0).alias("function_code"),
                    F.when(F.col("user_id") % 2 == 0, 48.0).otherwise(49.0).alias("order_kind"),
                    (F.col("event_id") % 11).alias("ask_order"), (F.col("user_id") % 11).alias("bid_order"))


FLOW = """flow AS (SELECT event_type AS instrument, ts AS datetime, epoch_us(ts) AS us, CASE event_id % 3 WHEN 0 THEN 66.0 WHEN 1 THEN 83.0 ELSE 67.0 END AS fc,
    CASE WHEN user_id % 2 = 0 THEN 48.0 ELSE 49.0 END AS ok, event_id % 11 AS ao, user_id % 11 AS bo FROM events)"""
INTENSITY = f"""inten AS (SELECT instrument, datetime, (sum(CAST(fc = 66 AND ok = 48 AS DOUBLE)) OVER a) / (count(fc) OVER a) AS la_s,
    (sum(CAST(fc = 66 AND ok = 48 AS DOUBLE)) OVER b) / (count(fc) OVER b) AS la_l, (sum(CAST(fc = 67 AND ao > bo AS DOUBLE)) OVER a) / (count(fc) OVER a) AS ca_s FROM flow
    WINDOW a AS (PARTITION BY instrument ORDER BY us RANGE BETWEEN 599999999 PRECEDING AND CURRENT ROW),
           b AS (PARTITION BY instrument ORDER BY us RANGE BETWEEN 7199999999 PRECEDING AND CURRENT ROW))"""


def _intensities():
    fc = E.field("function_code")
    la = lambda span: B.intensity(B.order_flags("B", "0"), fc, span)
    return la("10min"), la("2h"), B.intensity(B.trade_flags("C", "a"), fc, "10min")


@query("orderflow_intensity", sql(f"""SELECT instrument, time_bucket(INTERVAL 1 HOUR, datetime) AS datetime, {rq('avg(la_s)')} AS la_intensity, {rq('avg(ca_s)')} AS ca_intensity,
    {rq('avg(CAST(la_s > la_l AS DOUBLE))')} AS la_relative FROM inten GROUP BY 1, 2""", FLOW, INTENSITY))
def _(s, d):
    short, long, ca = _intensities()
    return rounded(B.bar_mean(Panel(_flow(s, d)), {"la_intensity": short, "ca_intensity": ca, "la_relative": short > long}, "1 hour"))


@query("orderflow_intensity_changes", sql(f"""SELECT instrument, time_bucket(INTERVAL 1 HOUR, b) AS datetime, {rq('avg(m)')} AS la_diff FROM
    (SELECT instrument, b, CASE WHEN b - lag(b) OVER w = INTERVAL 5 MINUTE THEN (x - lag(x) OVER w) / 5 END AS m FROM
     (SELECT instrument, time_bucket(INTERVAL 5 MINUTE, datetime) AS b, arg_max(la_s, datetime) AS x FROM inten GROUP BY 1, 2)
     WINDOW w AS (PARTITION BY instrument ORDER BY b)) GROUP BY 1, 2""", FLOW, INTENSITY))
def _(s, d):
    return rounded(B.intensity_changes(Panel(_flow(s, d)), {"la_diff": _intensities()[0]}, "1 hour", "5 minutes"))


@query("orderbook_future_change", sql(f"""SELECT instrument, time_bucket(INTERVAL 1 HOUR, datetime) AS datetime, {rq('avg(lead5 / touch - 1)')} AS lag_5_change_rate FROM
    (SELECT *, lead(touch, 5) OVER (PARTITION BY instrument ORDER BY datetime) AS lead5 FROM
     (SELECT g.instrument, g.datetime, last_value(x IGNORE NULLS) OVER (PARTITION BY g.instrument ORDER BY g.datetime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS touch FROM
      (SELECT instrument, unnest(generate_series(min(b), max(b), INTERVAL 5 MINUTE)) AS datetime FROM k GROUP BY 1) g LEFT JOIN k ON k.instrument = g.instrument AND k.b = g.datetime))
    WHERE touch <> 0 GROUP BY 1, 2""", BOOK, "k AS (SELECT instrument, time_bucket(INTERVAL 5 MINUTE, datetime) AS b, arg_max(ask1 + bid1, datetime) AS x FROM book GROUP BY 1, 2)"))
def _(s, d):
    return rounded(B.future_change_rates(_book(s, d), [5], "5 minutes", "1 hour"))


# ------------------------------------------------------------------ technical sets

POSED = "posed AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY datetime) AS pos FROM bars_h)"


@query("technical_crypto", sql(f"""SELECT instrument, datetime, {rq('ret', 5)} AS returns, {rq('ln(1 + ret)', 5)} AS log_returns,
    {rq('CASE WHEN count(ret) OVER w96 = 96 THEN stddev_samp(ret) OVER w96 END', 5)} AS volatility,
    {rq('CASE WHEN count(*) OVER w96 = 96 THEN avg(volume) OVER w96 END', 4)} AS volume_ma,
    {rq('CASE WHEN count(*) OVER w96 = 96 THEN stddev_samp(volume) OVER w96 END', 4)} AS volume_std,
    {rq('CASE WHEN count(*) OVER w96 = 96 THEN volume / avg(volume) OVER w96 END', 5)} AS volume_ratio,
    {rq('CASE WHEN count(*) OVER w5 = 5 THEN avg(close) OVER w5 END', 5)} AS bb_middle,
    {rq('CASE WHEN count(*) OVER w5 = 5 THEN avg(close) OVER w5 + 2 * stddev_pop(close) OVER w5 END', 5)} AS bb_upper,
    {rq('CASE WHEN count(*) OVER w5 = 5 THEN avg(close) OVER w5 - 2 * stddev_pop(close) OVER w5 END', 5)} AS bb_lower,
    coalesce(lead(ret) OVER w > 0, false) AS target FROM (SELECT *, close / lag(close) OVER (PARTITION BY instrument ORDER BY datetime) - 1 AS ret FROM bars_h)
    WINDOW w AS (PARTITION BY instrument ORDER BY datetime), {window_defs((5, 96))}""", "bars_h"))
def _(s, d):
    every = FS.crypto_technical()
    names = ("returns", "log_returns", "volatility", "volume_ma", "volume_std", "volume_ratio", "bb_middle", "bb_upper", "bb_lower", "target")
    df = features(bars_h(s, d), {k: every[k] for k in names})
    return df.select("instrument", "datetime", *[r(k, 4 if k in ("volume_ma", "volume_std") else 5).alias(k) for k in names if k != "target"], "target")


def _ema_of(col, decay, alias, base="base"):
    return f"""(SELECT p.instrument, p.pos, sum(b.{col} * pow({decay}, p.pos - b.pos)) / sum(pow({decay}, p.pos - b.pos)) AS {alias}
        FROM {base} p JOIN {base} b ON b.instrument = p.instrument AND b.pos <= p.pos AND b.{col} IS NOT NULL GROUP BY 1, 2)"""


@query("technical_crypto_ema", sql(f"""SELECT b.instrument, b.datetime, {rq('CASE WHEN l.v > 0 THEN 100 - 100 / (1 + g.v / l.v) WHEN g.v > 0 THEN 100 END', 4)} AS rsi,
    {rq('b.macd', 5)} AS macd, {rq('m.v', 5)} AS macd_signal, {rq('e.v', 5)} AS ema_12, {rq('h.v', 5)} AS ema_24 FROM md b LEFT JOIN {_ema_of('gain', '(1 - 1.0 / 14)', 'v')} g USING (instrument, pos) LEFT JOIN {_ema_of('loss', '(1 - 1.0 / 14)', 'v')} l USING (instrument, pos)
    JOIN {_ema_of('macd', '(1 - 2.0 / 10)', 'v', 'md')} m USING (instrument, pos) JOIN {_ema_of('close', '(1 - 2.0 / 49)', 'v')} e USING (instrument, pos)
    JOIN {_ema_of('close', '(1 - 2.0 / 97)', 'v')} h USING (instrument, pos)""", "bars_h", POSED,
    """base AS (SELECT *, CASE WHEN d IS NOT NULL THEN greatest(d, 0) END AS gain, CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END AS loss FROM
       (SELECT *, close - lag(close) OVER (PARTITION BY instrument ORDER BY datetime) AS d FROM posed))""",
    f"""md AS (SELECT b.*, f.v - s.v AS macd FROM base b JOIN {_ema_of('close', '(1 - 2.0 / 13)', 'v')} f USING (instrument, pos)
       JOIN {_ema_of('close', '(1 - 2.0 / 27)', 'v')} s USING (instrument, pos))"""))
def _(s, d):
    every = FS.crypto_technical()
    names = ("rsi", "macd", "macd_signal", "ema_12", "ema_24")
    df = features(bars_h(s, d), {k: every[k] for k in names})
    return df.select("instrument", "datetime", *[r(k, 4 if k == "rsi" else 5).alias(k) for k in names])


def _pct(c, part="instrument"):
    return f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY {part} ORDER BY {c}) + (count({c}) OVER (PARTITION BY {part}, {c}) - 1) / 2.0) / count({c}) OVER (PARTITION BY {part}) END"


FULLW = lambda e, x, n: f"CASE WHEN count({x}) OVER w{n} = {n} THEN {e} OVER w{n} END"


@query("alphas_price_volume", sql(f"""SELECT instrument, datetime,
    {rq(FULLW('-corr(open, volume)', 'open', 10).replace('-corr(open, volume) OVER w10', '-(corr(open, volume) OVER w10)'))} AS alpha101,
    {rq(_pct('vc5'))} AS alpha103, {rq(_pct('vw10'))} AS alpha105, {rq('-(' + _pct('d5') + ')')} AS alpha205,
    {rq('CASE WHEN cnt20 = 20 AND close > m20 THEN 1 ELSE -1 END')} AS alpha204, {rq('CASE WHEN cnt20 = 20 THEN (close - m20) / (2 * s20) END')} AS alpha302,
    {rq('CASE WHEN cnt20 = 20 AND close > m20 + 2 * s20 THEN 1 ELSE 0 END')} AS alpha303, {rq(_pct('atr'))} AS alpha301, {rq('-(' + _pct('sd20') + ')')} AS alpha305,
    {rq(_pct('mom'))} AS alpha203
    FROM (SELECT *, volume / lag(volume, 5) OVER w - 1 AS vc5, CASE WHEN count(*) OVER w10 = 10 THEN (sum(close * volume) OVER w10) / (sum(volume) OVER w10) END AS vw10,
       close - lag(close, 5) OVER w AS d5, count(*) OVER w20 AS cnt20, avg(close) OVER w20 AS m20, stddev_samp(close) OVER w20 AS s20,
       CASE WHEN count(tr) OVER w14 = 14 THEN avg(tr) OVER w14 END AS atr, CASE WHEN count(*) OVER w20 = 20 THEN stddev_samp(close) OVER w20 END AS sd20,
       (close - lag(close) OVER w) + (close - lag(close, 2) OVER w) + (close - lag(close, 3) OVER w) AS mom
      FROM (SELECT *, CASE WHEN p IS NOT NULL THEN greatest(high - low, abs(high - p), abs(low - p)) END AS tr FROM
        (SELECT *, lag(close) OVER (PARTITION BY instrument ORDER BY datetime) AS p FROM bars_h))
      WINDOW w AS (PARTITION BY instrument ORDER BY datetime), {window_defs((10, 14, 20))})
    WINDOW {window_defs((10,))}""", "bars_h"))
def _(s, d):
    every = FS.crypto_alphas()
    names = ("alpha101", "alpha103", "alpha105", "alpha205", "alpha204", "alpha302", "alpha303", "alpha301", "alpha305", "alpha203")
    return rounded(features(bars_h(s, d), {k: every[k] for k in names}))


def _place(value, window):
    return f"(len(list_filter({window}, lambda v: v < {value})) + (len(list_filter({window}, lambda v: v = {value})) + 1) / 2.0) / len({window})"


def _full_corr(a, b, n):
    return f"CASE WHEN count(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END) OVER w{n} = {n} AND {FLAT.format(a, n)} AND {FLAT.format(b, n)} THEN corr({a}, {b}) OVER w{n} END"


def _recursive_ema(span, alias):
    a = f"(2.0 / {span + 1})"
    return f"""(SELECT p.instrument, p.pos, sum(b.close * CASE WHEN b.pos = 1 THEN 1 ELSE {a} END * pow(1 - {a}, p.pos - b.pos)) AS {alias}
        FROM posed p JOIN posed b ON b.instrument = p.instrument AND b.pos <= p.pos GROUP BY 1, 2)"""


W = "(PARTITION BY instrument ORDER BY datetime)"
OTHER_ALPHAS = sql(f"""SELECT instrument, datetime, {rq('(' + _pct('x001') + ') - 0.5')} AS alpha001, {rq('-c002')} AS alpha002, {rq('-c003')} AS alpha003,
    {rq('-(' + 'CASE WHEN n9 = 9 THEN ' + _place('r_l', 'll9') + ' END)')} AS alpha004, {rq('r_ot * -abs(r_ct)')} AS alpha005,
    {rq('CASE WHEN m20v < volume THEN -(CASE WHEN n7 = 10 THEN ' + _place('abs(d7)', 'l7') + ' END) * sign(d7) ELSE -1 END')} AS alpha102, {rq('c104')} AS alpha104,
    {rq(_pct('rsi'))} AS alpha201, {rq(_pct('macd'))} AS alpha202, {rq('CASE WHEN nsd = 10 THEN ' + _place('s20', 'lsd') + ' END')} AS alpha304
    FROM (SELECT *, CASE WHEN n5 = 5 THEN list_position(ls, list_max(ls)) - 1 END AS x001 FROM (SELECT *, list(sh) OVER w5 AS ls, count(sh) OVER w5 AS n5, list(r_l) OVER w9 AS ll9, count(r_l) OVER w9 AS n9,
       list(s20) OVER w10 AS lsd, count(s20) OVER w10 AS nsd, {_full_corr('r_lv', 'r_co', 6)} AS c002, {_full_corr('r_h', 'r_v', 5)} AS c003, {_full_corr('vc5', 'cc5', 10)} AS c104
      FROM (SELECT *, pow(CASE WHEN ret < 0 THEN sr ELSE close END, 2) AS sh, {_pct('lv2')} AS r_lv, {_pct('co')} AS r_co, {_pct('high')} AS r_h, {_pct('volume')} AS r_v, {_pct('low')} AS r_l,
         {_pct('ct')} AS r_ct, {_pct('ot')} AS r_ot, CASE WHEN n14 = 14 AND l14 > 0 THEN 100 - 100 / (1 + g14 / l14) WHEN n14 = 14 AND g14 > 0 THEN 100 END AS rsi
        FROM (SELECT *, CASE WHEN count(ret) OVER w20 = 20 THEN stddev_samp(ret) OVER w20 END AS sr, CASE WHEN count(*) OVER w20 = 20 THEN avg(volume) OVER w20 END AS m20v,
           CASE WHEN count(*) OVER w20 = 20 THEN stddev_samp(close) OVER w20 END AS s20, open - CASE WHEN count(*) OVER w10 = 10 THEN sum(tp) OVER w10 END / 10 AS ot, close - tp AS ct,
           list(abs(d7)) OVER w10 AS l7, count(d7) OVER w10 AS n7, count(*) OVER w14 AS n14, avg(CASE WHEN dl > 0 THEN dl ELSE 0 END) OVER w14 AS g14, avg(CASE WHEN dl < 0 THEN -dl ELSE 0 END) OVER w14 AS l14
          FROM (SELECT p.*, f.v - s.v AS macd, close / lag(close) OVER {W} - 1 AS ret, close - lag(close) OVER {W} AS dl, close - lag(close, 7) OVER {W} AS d7, ln(volume) - ln(lag(volume, 2) OVER {W}) AS lv2,
             (close - open) / open AS co, (high + low + close) / 3 AS tp, volume / lag(volume, 5) OVER {W} - 1 AS vc5, close / lag(close, 5) OVER {W} - 1 AS cc5
            FROM posed p JOIN {_recursive_ema(12, 'v')} f USING (instrument, pos) JOIN {_recursive_ema(26, 'v')} s USING (instrument, pos))
          WINDOW {window_defs((10, 14, 20))}))
      WINDOW {window_defs((5, 6, 9, 10))}))""", "bars_h", POSED)


@query("alphas_all", f"SELECT * FROM ({ORACLE['alphas_price_volume']}) JOIN ({OTHER_ALPHAS}) USING (instrument, datetime)")
def _(s, d):
    return rounded(features(bars_h(s, d), FS.crypto_alphas()))


@query("technical_averages", sql(f"""SELECT instrument, datetime, {', '.join(f"{rq(FULLW('avg(close)', 'close', n), 5)} AS ma_{n}, {rq(FULLW('avg(volume)', 'volume', n), 4)} AS ma_vol_{n}" for n in (5, 10, 20, 60))},
    {rq('CASE WHEN c14 = 14 AND l14 > 0 THEN 100 - 100 / (1 + g14 / l14) WHEN c14 = 14 AND g14 > 0 THEN 100 END', 4)} AS rsi,
    {', '.join(f"{rq(FULLW('stddev_samp(lr)', 'lr', n), 5)} AS volatility_{n}" for n in (5, 20))}, {rq('high / low', 4)} AS hl_ratio, {rq('close / open', 4)} AS co_ratio,
    {rq('CASE WHEN count(*) OVER w20 = 20 THEN volume / avg(volume) OVER w20 END', 5)} AS vol_ratio FROM
    (SELECT *, count(*) OVER w14 AS c14, avg(CASE WHEN dl > 0 THEN dl ELSE 0 END) OVER w14 AS g14, avg(CASE WHEN dl < 0 THEN -dl ELSE 0 END) OVER w14 AS l14 FROM
     (SELECT *, close - lag(close) OVER w AS dl, ln(close / lag(close) OVER w) AS lr FROM bars_h WINDOW w AS (PARTITION BY instrument ORDER BY datetime))
     WINDOW {window_defs((14,))}) WINDOW {window_defs((5, 10, 20, 60))}""", "bars_h"))
def _(s, d):
    df = features(bars_h(s, d), FS.technical2())
    digits = {**{f"ma_vol_{n}": 4 for n in (5, 10, 20, 60)}, "rsi": 4, "hl_ratio": 4, "co_ratio": 4}
    return df.select("instrument", "datetime", *[r(c, digits.get(c, 5)).alias(c) for c in df.columns[2:]])


@query("realised_volatility", sql(f"""SELECT instrument, datetime, {rq('CASE WHEN v >= 0 THEN sqrt(v) END', 5)} AS vol FROM
    (SELECT instrument, datetime, (sum(lr * lr) OVER w20) / 19 - pow(sum(lr) OVER w20, 2) / (20 * 19.0) AS v FROM
     (SELECT *, ln(close / lag(close) OVER (PARTITION BY instrument ORDER BY datetime)) AS lr FROM bars_h) WINDOW {window_defs((20,))})""", "bars_h"))
def _(s, d):
    return rounded(features(bars_h(s, d), {"vol": FS.realised_volatility(20)}), n=5)


@query("beta_excess", sql(f"""SELECT instrument, datetime, {rq('beta', 5)} AS beta, {rq('ret - beta * mkt', 5)} AS excess, {rq('ret - mkt', 5)} AS excess_unit FROM
    (SELECT *, CASE WHEN mv <> 0 THEN (CASE WHEN count(pr) OVER w60 > 1 THEN covar_samp(ret, mkt) OVER w60 END) / mv END AS beta FROM
     (SELECT a.*, b.ret AS mkt, b.mv, CASE WHEN a.ret IS NOT NULL AND b.ret IS NOT NULL THEN 1 END AS pr FROM rets a LEFT JOIN (SELECT datetime, ret, var_samp(ret) OVER (ORDER BY datetime ROWS 59 PRECEDING) AS mv FROM rets WHERE instrument = 'view') b
      ON a.datetime = b.datetime) WINDOW {window_defs((60,))})""", "bars_h",
    "rets AS (SELECT *, close / lag(close) OVER (PARTITION BY instrument ORDER BY datetime) - 1 AS ret FROM bars_h)"))
def _(s, d):
    p = on_instrument(bars_h(s, d), "view", FS.benchmark_fields(60))
    return rounded(features(p, FS.beta_and_excess(60)), n=5)
