"""Order-book features from ticks, orders and transactions, resampled to bars."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.functions.scalar import safe_div
from strataline.operators.resample import resample
from strataline.plans import expr as E
from strataline.plans.evaluate import Panel, with_columns


def _total(name: str, levels: int) -> Column:
    return reduce(lambda a, b: a + b, [F.col(f"{name}{i}") for i in range(1, levels + 1)])


def _bar(freq: str) -> Column:
    return F.window("datetime", freq)["start"].cast("timestamp_ntz").alias("datetime")


def _last(c: Column) -> Column:
    return F.max_by(c, F.when(c.isNotNull(), F.col("datetime")))


def book_features(ticks: DataFrame, freq: str = "1 minute", levels: int = 10) -> DataFrame:
    """Depth ratios, spreads, mids, level gaps, average depths and accumulated differences in one aggregation."""
    volume = F.sum(_total("asize", levels) + _total("bsize", levels))
    touch = _last(F.col("ask1")) + _last(F.col("bid1"))
    out = []
    for side in ("asize", "bsize"):
        for i in range(1, levels + 1):
            out.append(safe_div(F.avg(f"{side}{i}"), volume).alias(f"v_{side}_{i}"))
        out.append(safe_div(F.avg(_total(side, levels)) / levels, volume).alias(f"v_avg_{side}"))
    for i in range(1, levels + 1):
        a, b = F.col(f"ask{i}"), F.col(f"bid{i}")
        out.append(safe_div(2 * _last(a - b), touch).alias(f"p_spread_{i}"))
        out.append(safe_div(2 * _last((a + b) / 2), touch).alias(f"p_mid_{i}"))
    for side in ("ask", "bid"):
        for i in range(1, levels):
            out.append(safe_div(2 * _last(F.abs(F.col(f"{side}{i + 1}") - F.col(f"{side}{i}"))), touch)
                       .alias(f"p_diff_{side}_{i}_{i + 1}"))
    out.append(safe_div(2 * _last(F.abs(F.col(f"ask{levels}") - F.col("ask1"))), touch).alias(f"p_diff_ask_{levels}_1"))
    out.append(safe_div(2 * _last(F.abs(F.col("bid1") - F.col(f"bid{levels}"))), touch).alias(f"p_diff_bid_1_{levels}"))
    out.append(safe_div(2 * (_last(_total("ask", levels)) - _last(_total("bid", levels))), touch).alias("p_accspread"))
    out.append(safe_div(F.avg(_total("asize", levels)) - F.avg(_total("bsize", levels)), volume).alias("v_accspread"))
    return ticks.groupBy("instrument", _bar(freq)).agg(*out)


def bucket_changes(ticks: DataFrame, columns: dict[str, tuple[str, str]], step: str, scale: float) -> DataFrame:
    """Per-bucket change ``scale * (value - value of the adjacent earlier bucket)``.

    Empty buckets have no change on either side, so only buckets that exist are
    kept and adjacency is checked on their start times: no dense grid is built.
    """
    small = resample(ticks, step, columns, keep_empty=False)
    exprs = {f"_p_{n}": E.ref(E.field(n), 1) for n in columns}
    t = E.column_map("micros", lambda c: F.unix_micros(c.cast("timestamp")), E.field("datetime"))
    exprs["_gap"] = E.sub(t, E.ref(t, 1))
    lagged = with_columns(Panel(small), exprs)
    num, unit = step.split()
    us = E.span_micros(num + {"s": "s", "m": "min", "h": "h"}[unit[0]])
    return lagged.select("instrument", "datetime", *[
        F.when(F.col("_gap") == us, scale * (F.col(n) - F.col(f"_p_{n}"))).alias(n) for n in columns])


def change_features(ticks: DataFrame, freq: str = "1 minute", step: str = "3 seconds", levels: int = 10) -> DataFrame:
    """Mean per-second change of prices over the touch and of sizes over the traded depth."""
    seconds = float(step.split()[0])
    cols = {f"{s}{i}": (f"{s}{i}", "last") for s in ("bid", "ask") for i in range(1, levels + 1)}
    cols |= {f"{s}{i}": (f"{s}{i}", "mean") for s in ("asize", "bsize") for i in range(1, levels + 1)}
    moves = bucket_changes(ticks, cols, step, 2.0 / seconds)
    means = moves.groupBy("instrument", _bar(freq)).agg(*[F.avg(c).alias(c) for c in cols])
    base = ticks.groupBy("instrument", _bar(freq)).agg(
        (_last(F.col("ask1")) + _last(F.col("bid1"))).alias("_touch"),
        F.sum(_total("asize", levels) + _total("bsize", levels)).alias("_volume"))
    j = base.join(means, ["instrument", "datetime"], "left")
    tag = step.replace(" seconds", "s").replace(" minutes", "m").replace(" hours", "h")
    return j.select("instrument", "datetime", *[
        safe_div(F.col(c), F.col("_volume" if "size" in c else "_touch")).alias(f"{'v' if 'size' in c else 'p'}_diff_{c}_{tag}")
        for c in cols])


def intensity(flag: E.Expr, counted: E.Expr, span: str) -> E.Expr:
    """Share of flagged rows among the rows of the last ``span`` of time."""
    return E.sum_(flag, span) / E.count(counted, span)


def order_flags(code: str, kind: str | None = None) -> E.Expr:
    """Orders of one side and kind, given by their character codes."""
    f = E.eq(E.field("function_code"), float(ord(code)))
    return f if kind is None else f & E.eq(E.field("order_kind"), float(ord(kind)))


def trade_flags(code: str, taker: str) -> E.Expr:
    """Transactions of a code where the ask ('a') or the bid ('b') order came later."""
    a, b = E.field("ask_order"), E.field("bid_order")
    return E.eq(E.field("function_code"), float(ord(code))) & (E.gt(a, b) if taker == "a" else E.lt(a, b))


def bar_mean(rows: Panel, exprs: dict[str, E.Expr], freq: str = "1 minute") -> DataFrame:
    """Row-level expressions averaged into bars."""
    cols = with_columns(rows, {n: E.if_(e, 1.0, 0.0) if e.boolean else e for n, e in exprs.items()})
    return cols.groupBy("instrument", _bar(freq)).agg(*[F.avg(n).alias(n) for n in exprs])


def intensity_changes(rows: Panel, exprs: dict[str, E.Expr], freq: str = "1 minute", step: str = "3 seconds") -> DataFrame:
    """Change rate of intensities between adjacent buckets, averaged into bars."""
    cols = with_columns(rows, exprs).select("instrument", "datetime", *exprs)
    moves = bucket_changes(cols, {n: (n, "last") for n in exprs}, step, 1.0 / float(step.split()[0]))
    return moves.groupBy("instrument", _bar(freq)).agg(*[F.avg(n).alias(n) for n in exprs])


def future_change_rates(ticks: DataFrame, lags: list[int], grid: str = "1 second", freq: str = "1 minute") -> DataFrame:
    """Mean of touch(t + lag) / touch(t) - 1 over a forward-filled grid, per bar."""
    t = ticks.withColumn("touch", F.col("ask1") + F.col("bid1"))
    dense = resample(t, grid, {"touch": ("touch", "last")}, forward_fill=True)
    x = E.field("touch")
    rates = with_columns(Panel(dense), {f"lag_{k}_change_rate": E.ref(x, -k) / x - 1 for k in lags})
    return rates.groupBy("instrument", _bar(freq)).agg(
        *[F.avg(f"lag_{k}_change_rate").alias(f"lag_{k}_change_rate") for k in lags])
