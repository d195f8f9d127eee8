"""Returns, risk, positions and attribution.

Return series are panels: ``instrument`` names the series (strategy,
benchmark), so many series are analysed in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.functions import scalar as S
from strataline.operators.calendars import calendar_of
from strataline.operators.orderstats import average_rank, group_quantiles, top_rows
from strataline.operators.setops import top_by_size
from strataline.plans import expr as E
from strataline.plans.evaluate import Panel, with_columns

# fixed values: periods per year
PER_YEAR = {"day": 238, "week": 50, "month": 12, "minute": 240 * 238}


def _growth(r: E.Expr) -> E.Expr:
    """Running product of 1 + r: zero from the first total loss on, and of the sign of its factors."""
    f = 1.0 + r
    lost = E.sum_(E.if_(E.eq(f, 0.0), 1.0, 0.0), 0)
    odd = E.column_map("mod2", lambda n: n % 2, E.sum_(E.if_(E.lt(f, 0.0), 1.0, 0.0), 0))
    size = E.exp(E.sum_(E.log(E.abs_(E.if_(E.eq(f, 0.0), 1.0, f))), 0))
    return E.if_(E.gt(lost, 0.0), 0.0, E.if_(E.eq(odd, 1.0), -1.0, 1.0) * size)


def risk_analysis(returns: DataFrame, column: str = "ret", freq: str = "day", mode: str = "sum", periods: float | None = None) -> DataFrame:
    """Mean, std, annualised return, information ratio and largest drawdown per series."""
    n = float(periods or PER_YEAR[freq])
    r = E.field(column)
    curve = E.sum_(r, 0) if mode == "sum" else _growth(r)
    peaks = with_columns(Panel(returns.where(F.col(column).isNotNull())), {"_c": curve, "_top": E.max_(curve, 0)})
    dd = F.col("_c") - F.col("_top") if mode == "sum" else F.col("_c") / F.col("_top") - 1
    x = F.col(column)
    if mode == "sum":
        mean, std = F.avg(x), F.stddev_samp(x)
        ann = mean * n
    else:
        # the whole product and its roots; a negative product has none
        f, m = 1 + x, F.count(x)
        lost, odd = F.max(F.when(f == 0, 1).otherwise(0)) == 1, F.sum(F.when(f < 0, 1).otherwise(0)) % 2 == 1
        log_mean = F.sum(F.log(F.abs(F.when(f != 0, f)))) / m
        mean = F.when(lost, -1.0).when(~odd, F.exp(log_mean) - 1)
        std = F.when(~lost & (F.min(f) > 0), F.stddev_samp(F.log1p(x)))
        ann = F.when(lost, -1.0).when(~odd, F.exp(log_mean * n) - 1)
    return peaks.groupBy("instrument").agg(
        mean.alias("mean"), std.alias("std"), ann.alias("annualized_return"),
        S.null_div(mean * F.sqrt(F.lit(n)), std).alias("information_ratio"), F.min(dd).alias("max_drawdown"))


def monthly_risk(report: DataFrame, freq: str = "day") -> DataFrame:
    """Risk of excess return without and with cost per calendar month; months under three rows are left out."""
    parts = []
    for kind, r in (("excess", F.col("ret") - F.col("bench")), ("excess_with_cost", F.col("ret") - F.col("bench") - F.col("cost"))):
        month = F.date_format("datetime", "yyyy-MM")
        parts.append(report.select(F.concat_ws("|", "instrument", F.lit(kind), month).alias("instrument"), "datetime", r.alias("ret")))
    rows = parts[0].unionByName(parts[1])
    full = rows.groupBy("instrument").count().where("count >= 3").select("instrument")
    out = risk_analysis(rows.join(full, "instrument", "left_semi"), freq=freq)
    key = F.split("instrument", "\\|")
    return out.select(F.get(key, F.lit(0)).alias("series"), F.get(key, F.lit(1)).alias("kind"), F.get(key, F.lit(2)).alias("month"),
                      *[c for c in out.columns if c != "instrument"])


def report_curves(report: DataFrame) -> DataFrame:
    """Cumulative returns with and without cost and benchmark, and their drawdowns."""
    r, b, c = E.field("ret"), E.field("bench"), E.field("cost")
    series = {"cum_bench": b, "cum_return_wo_cost": r, "cum_return_w_cost": r - c, "cum_ex_return_wo_cost": r - b, "cum_ex_return_w_cost": r - b - c}
    cum = {k: E.sum_(v, 0) for k, v in series.items()}
    mdd = {k.replace("cum_", "") + "_mdd": cum[k] - E.max_(cum[k], 0) for k in cum if k != "cum_bench"}
    return with_columns(Panel(report), cum | mdd)


def worst_interval(curves: DataFrame, cum: str = "cum_return_wo_cost", mdd: str = "return_wo_cost_mdd") -> DataFrame:
    """End = date of the deepest drawdown; start = date of the peak before it."""
    end = curves.groupBy("instrument").agg(F.min_by("datetime", F.struct(mdd, "datetime")).alias("end"))
    j = curves.join(end, "instrument").where(F.col("datetime") <= F.col("end"))
    neg = F.struct((-F.col(cum)).alias("c"), F.col("datetime"))
    return j.groupBy("instrument").agg(F.min_by("datetime", neg).alias("start"), F.first("end").alias("end"))


def performance(returns: DataFrame, method: str = "ci", risk_free: float = 0.0, year: int = 250) -> DataFrame:
    """Annual return, Sharpe, largest drawdown (product), volatility, and beta / alpha where ``bench`` exists.

    Beta is the scalar cov / var of the two series.
    """
    def annual(c):
        return F.pow(1 + F.avg(c), F.lit(float(year))) - 1 if method == "ci" else F.avg(c) * year

    g = _growth(E.field("ret"))
    p = with_columns(Panel(returns), {"_c": g, "_top": E.max_(g, 0)})
    std = F.stddev_samp("ret")
    aggs = [annual("ret").alias("annual_return"), S.null_div(annual("ret") - risk_free, std * F.sqrt(F.lit(float(year)))).alias("sharpe"),
            F.min((F.col("_c") - F.col("_top")) / F.col("_top")).alias("max_drawdown"), std.alias("volatility")]
    if "bench" in returns.columns:
        beta = S.null_div(F.covar_samp("ret", "bench"), F.var_samp("bench"))
        aggs += [beta.alias("beta"), (annual("ret") - risk_free - beta * (annual("bench") - risk_free)).alias("alpha")]
    return p.groupBy("instrument").agg(*aggs)


def position_values(positions: DataFrame, cash: DataFrame, quotes: DataFrame, initial: float) -> DataFrame:
    """Account value (cash + amount x close) per date and its daily return; the first return is against ``initial``."""
    held = positions.join(quotes.select("instrument", "datetime", "close"), ["instrument", "datetime"])
    v = held.groupBy("datetime").agg(F.sum(F.col("amount") * F.col("close")).alias("_h"))
    total = cash.join(v, "datetime", "left").select("datetime", (F.col("cash") + F.coalesce("_h", F.lit(0.0))).alias("value"))
    one = total.withColumn("instrument", F.lit("account"))
    x = E.field("value")
    prev = E.if_(E.is_null(E.ref(x, 1)), float(initial), E.ref(x, 1))
    return with_columns(Panel(one), {"ret": x / prev - 1}).drop("instrument")


def benchmark_return(panel: Panel, codes: list[str]) -> DataFrame:
    """Mean one-row return over the listed instruments; missing counts as zero."""
    c = E.field("close")
    df = with_columns(Panel(panel.df.where(F.col("instrument").isin(codes)), panel.blocked), {"_r": c / E.ref(c, 1) - 1})
    return df.groupBy("datetime").agg(F.coalesce(F.avg("_r"), F.lit(0.0)).alias("bench"))


def compound(returns: DataFrame, freq: str, column: str = "ret") -> DataFrame:
    """Compound returns to a coarser step; zero and negative growth keep their sign."""
    g = 1 + F.col(column)
    step = F.window("datetime", freq)["start"].cast("timestamp_ntz").alias("datetime")
    size = F.exp(F.sum(F.when(g != 0, F.log(F.abs(g)))))
    odd = F.count_if(g < 0) % 2
    total = F.when(F.count_if(g == 0) > 0, 0.0).otherwise(F.coalesce(size, F.lit(1.0)) * F.when(odd == 1, -1.0).otherwise(1.0))
    return returns.groupBy("instrument", step).agg((total - 1).alias(column))


def next_return(panel: Panel, price: str = "close") -> DataFrame:
    p = E.field(price)
    return with_columns(panel, {"next_ret": E.ref(p, -1) / p - 1}).select("instrument", "datetime", "next_ret")


def portfolio_return(weights: DataFrame, rets: DataFrame, column: str = "next_ret") -> DataFrame:
    """Weighted return per date."""
    return weights.join(rets, ["instrument", "datetime"], "left").groupBy("datetime").agg(
        F.coalesce(F.sum(F.col("weight") * F.col(column)), F.lit(0.0)).alias("ret"))


def weights_from_positions(positions: DataFrame) -> DataFrame:
    """Weight = amount x price over the date's total."""
    v = positions.withColumn("_v", F.col("amount") * F.col("price"))
    tot = v.groupBy("datetime").agg(F.sum("_v").alias("_t"))
    return v.join(tot, "datetime").select("instrument", "datetime", S.null_div(F.col("_v"), F.col("_t")).alias("weight"))


def bin_groups(values: DataFrame, bench: DataFrame, bins: int, column: str = "value") -> DataFrame:
    """Group 1..bins per date by the benchmark members' quantile edges; 1 holds the largest values, bins are [low, high)."""
    members = values.join(bench.select("instrument", "datetime"), ["instrument", "datetime"], "left_semi")
    edges = group_quantiles(members, ["datetime"], column, {f"_e{i}": i / bins for i in range(1, bins)})
    passed = sum([F.when(F.col(column) >= F.col(f"_e{i}"), 1).otherwise(0) for i in range(1, bins)], F.lit(0))
    return values.join(edges, "datetime").select("instrument", "datetime", (F.lit(bins) - passed).cast("int").alias("group"))


def brinson(port: DataFrame, bench: DataFrame, groups: DataFrame, rets: DataFrame) -> DataFrame:
    """Allocation, selection, interaction and total excess return per date.

    Both sides' weights stand beside each other on one row per instrument, so groups and returns are joined once.
    """
    none = F.lit(None).cast("double")
    both = port.select("instrument", "datetime", F.col("weight").alias("pw"), none.alias("bw")).unionByName(
        bench.select("instrument", "datetime", none.alias("pw"), F.col("weight").alias("bw")))
    both = both.groupBy("instrument", "datetime").agg(F.sum("pw").alias("pw"), F.sum("bw").alias("bw"))
    j = both.join(groups, ["instrument", "datetime"]).join(rets, ["instrument", "datetime"], "left")
    ret = lambda w: S.null_div(F.coalesce(F.sum(F.col(w) * F.col("next_ret")), F.lit(0.0)), F.sum(w))
    by = j.groupBy("datetime", "group").agg(F.sum("pw").alias("pw"), F.sum("bw").alias("bw"), ret("pw").alias("pr"), ret("bw").alias("br"))
    pw, bw = F.coalesce("pw", F.lit(0.0)), F.coalesce("bw", F.lit(0.0))
    pr = F.coalesce("pr", "br")
    q = [F.sum(bw * F.col("br")), F.sum(pw * F.col("br")), F.sum(bw * pr), F.sum(pw * pr)]
    q1, q2, q3, q4 = [F.coalesce(x, F.lit(0.0)) for x in q]
    return by.groupBy("datetime").agg((q2 - q1).alias("allocation"), (q3 - q1).alias("selection"), (q4 - q3 - q2 + q1).alias("interaction"), (q4 - q1).alias("total"))


def long_short_excess(pred: DataFrame, quotes: DataFrame, cal: DataFrame, k: int, shift: int = 1) -> DataFrame:
    """Equal-weight top-k and bottom-k return against the average of what could be held.

    ``quotes`` has profit, tradable and suspended per (instrument, trade date).
    """
    trade = pred.join(cal, "datetime").withColumn("_t", F.col("idx") + shift).join(
        cal.select(F.col("idx").alias("_t"), F.col("datetime").alias("trade_date")), "_t")
    base = trade.where(F.col("score").isNotNull())
    top = top_rows(base, ["datetime"], [F.desc("score"), F.col("instrument")], k).withColumn("_side", F.lit("long"))
    low = top_rows(base, ["datetime"], [F.asc("score"), F.desc("instrument")], k).withColumn("_side", F.lit("short"))
    every = base.withColumn("_side", F.lit("all"))
    q = quotes.withColumnRenamed("datetime", "trade_date")
    rows = top.unionByName(low).unionByName(every).join(q, ["instrument", "trade_date"])
    profit = F.coalesce("profit", F.lit(0.0))
    ok = F.when(F.col("_side") == "all", ~F.col("suspended")).otherwise(F.col("tradable"))
    mean = lambda side, sign: F.avg(F.when(ok & (F.col("_side") == side), profit * sign))
    out = rows.groupBy("trade_date").agg(mean("long", 1).alias("l"), mean("short", -1).alias("s"), mean("all", 1).alias("a"))
    return out.select(F.col("trade_date").alias("datetime"), (F.col("l") - F.col("a")).alias("long"), (F.col("s") + F.col("a")).alias("short"),
                      (F.col("s") + F.col("l")).alias("long_short"))


def target_weights(scores: DataFrame, current: DataFrame, k: int, max_sold: float = 1.0, fill: str = "first") -> DataFrame:
    """Target weights of one step per date from scores and current weights.

    Holdings outside the top k give up at most ``max_sold`` each; the freed
    weight goes to top-k names in score order up to 1/k ('first') or evenly
    ('average').  A date without holdings starts at 1/k each.
    """
    top = top_rows(scores.where(F.col("score").isNotNull()), ["datetime"], [F.desc("score"), F.col("instrument")], k).select("instrument", "datetime", "score")
    held = current.select("instrument", "datetime", F.col("weight").alias("_w"))
    j = top.withColumn("_in", F.lit(True)).join(held, ["instrument", "datetime"], "full")
    w, inside = F.coalesce("_w", F.lit(0.0)), F.coalesce("_in", F.lit(False))
    sold = F.when(inside, 0.0).otherwise(F.least(F.lit(max_sold), w))
    step = j.withColumns({"_w0": w, "_inside": inside, "_sold": sold})
    sums = step.groupBy("datetime").agg(F.sum("_sold").alias("_free"), F.sum("_w0").alias("_gross"), F.count_if("_inside").alias("_k"),
                                        F.count("_w").alias("_held"))
    s = step.join(sums, "datetime")
    if fill == "average":
        extra = F.col("_free") / F.col("_k")
    else:
        from pyspark.sql import Window
        need = F.when(F.col("_inside"), F.greatest(F.lit(1.0 / k) - F.col("_w0"), F.lit(0.0))).otherwise(0.0)
        s = s.withColumn("_need", need)
        # only the k chosen names of a date are ordered
        before = F.sum("_need").over(Window.partitionBy("datetime", "_inside").orderBy(F.desc("score"), "instrument").rowsBetween(Window.unboundedPreceding, -1))
        extra = F.least(F.col("_need"), F.greatest(F.col("_free") - F.coalesce(before, F.lit(0.0)), F.lit(0.0)))
        chosen = s.where("_inside").withColumn("_x", extra)
        rest = s.where("NOT _inside").withColumn("_x", F.lit(0.0))
        s, extra = chosen.unionByName(rest), F.col("_x")
    weight = F.when(F.col("_held") == 0, F.lit(1.0 / k)).when(F.col("_inside"), F.col("_w0") + extra).otherwise(F.col("_w0") - F.col("_sold"))
    return s.select("instrument", "datetime", weight.alias("weight"))


def signed_weights(pred: DataFrame, n: int, vol: DataFrame | None = None, max_leverage: float = 1.0) -> DataFrame:
    """Top-n absolute scores, weighted by inverse volatility or equally, signed and capped in gross exposure."""
    top = top_by_size(pred, "score", n).withColumn("_sign", F.when(F.col("score") >= 0, 1.0).otherwise(-1.0))
    raw = F.lit(1.0)
    if vol is not None:
        top = top.join(vol.select("instrument", "datetime", "vol"), ["instrument", "datetime"], "left")
        raw = S.null_div(F.lit(1.0), F.coalesce("vol", F.lit(1e-6)))
    top = top.withColumn("_raw", raw)
    sums = top.groupBy("datetime").agg(F.sum("_raw").alias("_t"))
    scale = F.lit(min(1.0, max_leverage))  # the normalised gross exposure is one
    return top.join(sums, "datetime").select("instrument", "datetime", (F.col("_raw") / F.col("_t") * F.col("_sign") * scale).alias("weight"))


def carry_signals(bars: Panel, signals: DataFrame) -> DataFrame:
    """Bars with the latest signal at or before them; HOLD and zero before the first."""
    j = bars.df.join(signals.select("instrument", "datetime", "signal", "position_size"), ["instrument", "datetime"], "left")
    filled = with_columns(Panel(j, bars.blocked), {"_sig": E.ffill(E.field("signal")), "_size": E.ffill(E.field("position_size"))})
    return filled.select(*bars.df.columns, F.coalesce("_sig", F.lit("HOLD")).alias("signal"), F.coalesce("_size", F.lit(0.0)).alias("position_size"))


def signal_pnl(bars: DataFrame, capital: float = 1.0, fee: float = 0.0, slippage: float = 0.0) -> DataFrame:
    """Position, trade and equity of signals on bars, without a bar loop.

    Equity follows E = E (1 + r) - c.  With P the running product of 1 + r it
    equals P (E0 - sum(c / P)); a wipe-out (1 + r = 0) starts a new segment.
    """
    size = F.when(F.col("signal") == "BUY", F.col("position_size")).when(F.col("signal") == "SELL", -F.col("position_size")).otherwise(0.0)
    c, pos = E.field("close"), E.field("position")
    prev = E.if_(E.is_null(E.ref(pos, 1)), 0.0, E.ref(pos, 1))
    pct = E.if_(E.is_null(c / E.ref(c, 1)), 0.0, c / E.ref(c, 1) - 1)
    hot = Panel(bars).is_hot()
    step = with_columns(Panel(bars.withColumn("position", size), blocked=hot), {"trade": pos - prev, "port_ret": prev * pct})
    step = step.withColumns({"_cost": F.abs("trade") * (fee + slippage), "_f": 1 + F.col("port_ret")})
    seg = with_columns(Panel(step, blocked=hot), {"_seg": E.sum_(E.if_(E.eq(E.field("_f"), 0.0), 1.0, 0.0), 0)})
    f = E.if_(E.eq(E.field("_f"), 0.0), 1.0, E.field("_f"))
    sign = E.if_(E.eq(E.column_map("mod2", lambda n: n % 2, E.sum_(E.if_(E.lt(f, 0.0), 1.0, 0.0), 0)), 1.0), -1.0, 1.0)
    grow = E.exp(E.sum_(E.log(E.abs_(f)), 0)) * sign
    start = E.if_(E.eq(E.field("_seg"), 0.0), float(capital), 0.0)
    keyed = seg.withColumn("_inst", F.col("instrument")).withColumn("instrument", F.concat_ws("#", "instrument", F.col("_seg").cast("string")))
    eq = with_columns(Panel(keyed, blocked=hot), {"equity": grow * (start - E.sum_(E.field("_cost") / grow, 0))})
    eq = eq.withColumn("instrument", F.col("_inst")).drop("_inst", "_seg", "_f", "_cost")
    return with_columns(Panel(eq, blocked=hot), {"peak": E.max_(E.field("equity"), 0)}).withColumn("drawdown", S.null_div(F.col("peak") - F.col("equity"), F.col("peak")))


def pnl_metrics(pnl: DataFrame, capital: float = 1.0, periods: float = 252.0) -> DataFrame:
    """Cumulative and annualised return, Sharpe, largest drawdown and number of trades per instrument."""
    last = F.max_by("equity", "datetime")
    n = F.count(F.lit(1))
    r = F.col("port_ret")
    # a negative product has no real root; a wiped-out series ends at -100 %
    odd = F.count_if(r < -1) % 2 == 1
    grow = F.when(F.count_if(r == -1) > 0, 0.0).when(~odd, F.exp(F.sum(F.log(F.abs(1 + r)))))
    return pnl.groupBy("instrument").agg(
        (last / capital - 1).alias("cumulative_return"), (F.pow(grow, periods / n) - 1).alias("annualized_return"),
        S.null_div(F.avg(r) * F.sqrt(F.lit(periods)), F.stddev_samp(r)).alias("sharpe"), F.max("drawdown").alias("max_drawdown"),
        n.alias("periods"), F.count_if(F.col("trade") != 0).alias("trades"))


def equity_metrics(equity: DataFrame, trades: DataFrame, bars_per_year: float = 365 * 24 * 4) -> DataFrame:
    """Total return, Sharpe and drawdown of equity curves, with trade count and share of winning trades."""
    x = E.field("equity")
    d = with_columns(Panel(equity), {"_r": x / E.ref(x, 1) - 1, "_top": E.max_(x, 0)})
    m = d.groupBy("instrument").agg(
        (S.null_div(F.max_by("equity", "datetime"), F.min_by("equity", "datetime")) - 1).alias("total_return"),
        S.null_div(F.avg("_r") * F.sqrt(F.lit(float(bars_per_year))), F.stddev_samp("_r")).alias("sharpe_ratio"),
        F.min(S.null_div(F.col("equity") - F.col("_top"), F.col("_top"))).alias("max_drawdown"))
    t = trades.groupBy("instrument").agg(F.count(F.lit(1)).alias("trade_count"), F.avg((F.col("profit") > 0).cast("double")).alias("win_rate"))
    return m.join(t, "instrument", "left").fillna(0, subset=["trade_count"]).fillna(0.0, subset=["win_rate"])


def parse_positions(positions: DataFrame) -> DataFrame:
    """Status per held row: 1 bought, 0 held; rows gone on the next trading date come again there with -1."""
    cal = calendar_of(positions)
    p = positions.join(cal, "datetime")
    prev = p.select("instrument", (F.col("idx") + 1).alias("idx"), F.lit(True).alias("_had"))
    here = p.join(prev, ["instrument", "idx"], "left").withColumn("status", F.when(F.col("_had"), 0).otherwise(1)).drop("_had")
    nxt = p.select("instrument", (F.col("idx") - 1).alias("idx"))
    gone = p.join(nxt, ["instrument", "idx"], "left_anti").drop("datetime").withColumn("idx", F.col("idx") + 1).join(cal, "idx")
    return here.unionByName(gone.withColumn("status", F.lit(-1))).drop("idx")


def attach_label_bench(positions: DataFrame, label: DataFrame, bench: DataFrame) -> DataFrame:
    """Positions with their label and the benchmark's next return."""
    nxt = with_columns(Panel(bench.withColumn("instrument", F.lit("bench"))), {"_b": E.ref(E.field("bench"), -1)}).select("datetime", F.col("_b").alias("bench"))
    return positions.join(label, ["instrument", "datetime"], "left").join(nxt, "datetime", "left")


def label_ranks(parsed: DataFrame) -> DataFrame:
    """Descending label rank as percent of the day, its mean per status, and excess over the day's mean label."""
    neg = parsed.withColumn("_neg", -F.col("label"))
    ranked = average_rank(neg, ["datetime"], "_neg", "_r")
    day = ranked.groupBy("datetime").agg(F.count(F.lit(1)).alias("_n"), F.avg("label").alias("_m"))
    j = ranked.join(day, "datetime").withColumn("rank_ratio", F.col("_r") / F.col("_n") * 100)
    per = j.groupBy("datetime", "status").agg(F.avg("rank_ratio").alias("rank_label_mean"))
    return j.withColumn("excess_return", F.col("label") - F.col("_m")).join(per, ["datetime", "status"]).drop("_neg", "_r", "_n", "_m")


def status_contribution(parsed: DataFrame) -> DataFrame:
    """Weighted mean excess label of held, bought and sold rows per date, with running sums."""
    d = parsed.withColumn("_x", F.col("label") - F.col("bench")).where(F.col("_x").isNotNull() & F.col("weight").isNotNull())
    aggs = []
    for name, st in (("hold", 0), ("buy", 1), ("sell", -1)):
        hit = F.col("status") == st
        aggs += [F.coalesce(F.sum(F.when(hit, F.col("_x") * F.col("weight"))), F.lit(0.0)).alias(f"{name}_value"),
                 F.coalesce(F.sum(F.when(hit, F.col("weight"))), F.lit(0.0)).alias(f"{name}_weight")]
    day = d.groupBy("datetime").agg(*aggs)
    day = day.withColumns({f"{n}_mean": F.coalesce(S.null_div(F.col(f"{n}_value"), F.col(f"{n}_weight")), F.lit(0.0)) for n in ("hold", "buy", "sell")})
    day = day.withColumns({"buy_minus_sell_value": F.col("buy_value") - F.col("sell_value"), "buy_minus_sell_mean": F.col("buy_mean") - F.col("sell_mean"),
                           "buy_plus_sell_weight": F.col("buy_weight") + F.col("sell_weight"), "instrument": F.lit("all")})
    run = {f"cum_{n}": E.sum_(E.field(f"{n}_mean"), 0) for n in ("hold", "buy", "sell", "buy_minus_sell")}
    return with_columns(Panel(day), run).drop("instrument")
