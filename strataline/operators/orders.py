"""Order sizing, schedules, fills and trade indicators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataline.functions import scalar as S
from strataline.plans import expr as E
from strataline.plans.evaluate import Panel, with_columns


def round_to_unit(amount: Column, factor: Column, unit: float) -> Column:
    """Adjusted amount cut to whole trade units of real shares."""
    return S.null_div(F.floor((amount * factor + 0.1) / unit) * unit, factor)


def clip_to_volume(amount: Column, current: Column | None = None, cumulative: Column | None = None, dealt: Column | None = None) -> Column:
    """Amount within the step's volume and what is left of a cumulative limit, never negative."""
    out = amount
    if current is not None:
        out = F.least(out, current)
    if cumulative is not None:
        out = F.least(out, cumulative - dealt)
    return F.greatest(out, F.lit(0.0))


def trade_cost(value: Column, rate: float, impact: float = 0.0, total: Column | None = None, minimum: float = 0.0) -> Column:
    """max(value x (rate + impact x (value / total)^2), minimum); nothing for a negligible value."""
    share = F.lit(1.0) if total is None else F.coalesce(F.pow(S.null_div(value, total), F.lit(2.0)), F.lit(1.0))
    return F.when(value <= 1e-5, 0.0).otherwise(F.greatest(value * (rate + impact * share), F.lit(minimum)))


def dealt_before(fills: DataFrame) -> DataFrame:
    """Amount already dealt by the same instrument earlier on the same day."""
    keyed = fills.withColumn("_inst", F.col("instrument")).withColumn("instrument", F.concat_ws("#", "instrument", F.to_date("datetime").cast("string")))
    out = with_columns(Panel(keyed), {"dealt": E.sum_(E.ref(E.field("deal_amount"), 1), 0)})
    return out.withColumn("instrument", F.col("_inst")).drop("_inst").fillna(0.0, subset=["dealt"])


def twap_schedule(orders: DataFrame, steps: Column, unit: Column) -> DataFrame:
    """Children of each order: equal parts rounded to the unit against the running total, remainder on the last step."""
    seq = F.sequence(F.lit(0), steps - 1)
    zero = F.struct(F.lit(0.0).alias("done"), F.array().cast("array<double>").alias("parts"))

    def child(acc, k):
        remain = F.col("amount") - acc["done"]
        want = F.col("amount") / steps * (k + 1) - acc["done"]
        part = F.when(unit.isNull(), want).otherwise(F.least(F.rint(want / unit) * unit, remain))
        part = F.when(k == steps - 1, remain).otherwise(part)
        part = F.when(part > 1e-5, part).otherwise(0.0)
        return F.struct((acc["done"] + part).alias("done"), F.array_append(acc["parts"], part).alias("parts"))

    plan = F.aggregate(seq, zero, child)["parts"]
    return orders.select("*", F.posexplode(plan).alias("step", "child_amount")).where("child_amount > 0")


def front_loaded_schedule(orders: DataFrame, steps: Column, risk: float, impact: float, vol: str = "vol") -> DataFrame:
    """Risk-averse sinh schedule from a volatility column; equal parts where it is missing or zero."""
    s = F.col(vol)
    kappa = F.acosh(risk / impact * s * s / 2 + 1)
    k = F.col("step")
    ratio = (F.sinh(kappa * (steps - k)) - F.sinh(kappa * (steps - k - 1))) / F.sinh(kappa * steps)
    flat = F.lit(1.0) / steps
    rows = orders.select("*", F.explode(F.sequence(F.lit(0), steps - 1)).alias("step"))
    share = F.when(s.isNull() | (s == 0), flat).otherwise(ratio)
    return rows.withColumn("child_amount", F.col("amount") * share)


TIE = 1e-9  # averages closer than this share of the price are equal


def trend(panel: Panel, fast: int = 10, slow: int = 20) -> DataFrame:
    """Direction of EMA(fast) - EMA(slow): long, short, or mid where the two are equal up to rounding."""
    c = E.field("close")
    out = with_columns(panel, {"_s": E.ema(c, fast) - E.ema(c, slow)})
    s, tie = F.col("_s"), TIE * F.abs("close")
    return out.withColumn("trend", F.when(s > tie, "long").when(s < -tie, "short").otherwise("mid")).drop("_s")


def sample_orders(candidates: DataFrame, fraction: float, seed: int, amount: Column) -> DataFrame:
    """Random order list per step, reproducible on any engine: a row is taken by the digest of its key and the seed."""
    key = F.concat_ws("|", "instrument", F.unix_seconds(F.col("datetime").cast("timestamp")).cast("string"), F.lit(str(seed)))
    u = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") / float(1 << 32)
    return candidates.where(u < fraction).withColumn("amount", amount)


def orders_for_steps(order_file: DataFrame, cal: DataFrame) -> DataFrame:
    """Listed orders joined to the calendar steps of their day."""
    steps = cal.withColumn("_day", F.to_date("datetime"))
    return order_file.withColumn("_day", F.to_date("datetime")).drop("datetime").join(steps, "_day").drop("_day", "idx")


def base_prices(orders: DataFrame, quotes: DataFrame, method: str = "twap", unit: str = "day") -> DataFrame:
    """Average market price of each order's interval (``start`` .. ``end``), by time or by volume.

    Both ends of an interval look up running sums of the quotes, in a union with them, and the sums are subtracted: a quote is
    read once, however many orders span it, and equal intervals of an instrument are looked up once.  Sums run inside
    (instrument, ``unit`` slot) and over an instrument's slots, and both differences are taken apart, so a short interval does
    not lose digits to a long history.  Orders that no quote falls into have no row.
    """
    return orders.select("order_id", "instrument", "start", "end").join(interval_prices(orders, quotes, method, unit), ["instrument", "start", "end"]).select(
        "order_id", "base_price", "base_volume")


def interval_prices(orders: DataFrame, quotes: DataFrame, method: str = "twap", unit: str = "day") -> DataFrame:
    """instrument, start, end, base_price and base_volume of the orders' different intervals (see :func:`base_prices`)."""
    slot = F.date_trunc(unit, "datetime").alias("_slot")
    w = F.coalesce(F.col("volume").cast("double"), F.lit(0.0)) if method == "vwap" else F.lit(1.0)
    none, span = F.lit(0.0), F.struct("start", "end")
    spans = orders.select("instrument", "start", "end").distinct()
    seen = quotes.where(F.col("price") > 1e-8).select("instrument", "datetime", F.lit(1).alias("_kind"), F.lit(None).cast(spans.select(span.alias("s")).schema["s"].dataType).alias("_span"),
                                                      w.alias("_w"), (F.col("price") * w).alias("_p"), F.lit(1).alias("_k"))
    ends = spans.select("instrument", F.inline(F.array(*[F.struct(F.col(c).alias("datetime"), F.lit(k).alias("_kind"), span.alias("_span")) for c, k in (("start", 0), ("end", 2))])))
    rows = seen.unionByName(ends.select("instrument", "datetime", "_kind", "_span", none.alias("_w"), none.alias("_p"), F.lit(0).alias("_k"))).withColumn("_slot", slot)
    sums = ("_w", "_p", "_k")
    inside = Window.partitionBy("instrument", "_slot").orderBy("datetime", "_kind").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    marks = rows.select("instrument", "_slot", "_kind", "_span", *[F.sum(c).over(inside).alias(f"{c}_in") for c in sums]).where("_kind != 1")
    before = Window.partitionBy("instrument").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("instrument", "_slot").agg(*[F.sum(c).alias(c) for c in sums]).select(
        "instrument", "_slot", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in sums])
    both = marks.join(totals, ["instrument", "_slot"])
    at = lambda c: F.sum(F.when(F.col("_kind") == 2, F.col(c)).otherwise(-F.col(c)))
    out = both.groupBy("instrument", "_span").agg(*[(at(f"{c}_before") + at(f"{c}_in")).alias(c) for c in sums]).where("_k > 0")
    return out.select("instrument", "_span.start", "_span.end", S.null_div(F.col("_p"), F.col("_w")).alias("base_price"), F.col("_w").alias("base_volume"))


def order_metrics(fills: DataFrame, orders: DataFrame, quotes: DataFrame, method: str = "twap", unit: str = "day") -> DataFrame:
    """Per order: dealt amount, fulfil rate, average price, value, cost, base price and price advantage.

    direction is 1 for buy and 0 for sell; an advantage is a better price than the base.
    """
    agg = fills.groupBy("order_id").agg(
        F.sum("deal_amount").alias("deal_amount"), S.null_div(F.sum(F.col("deal_amount") * F.col("trade_price")), F.sum("deal_amount")).alias("trade_price"),
        F.sum(F.col("deal_amount") * F.col("trade_price")).alias("_value"), F.sum("trade_cost").alias("trade_cost"))
    j = orders.join(agg, "order_id", "left").join(interval_prices(orders, quotes, method, unit), ["instrument", "start", "end"], "left")
    sign = 1 - F.col("direction") * 2
    deal = F.coalesce("deal_amount", F.lit(0.0))
    return j.select("order_id", "instrument", "direction", "amount", deal.alias("deal_amount"), S.null_div(deal, F.col("amount")).alias("ffr"),
                    "trade_price", (F.coalesce("_value", F.lit(0.0)) * -sign).alias("trade_value"), F.coalesce("trade_cost", F.lit(0.0)).alias("trade_cost"),
                    "base_price", (sign * (S.null_div(F.col("trade_price"), F.col("base_price")) - 1)).alias("pa"), F.col("start").alias("datetime"))


def step_indicators(metrics: DataFrame, weight: str = "mean") -> DataFrame:
    """Per step: fulfil rate and price advantage (plain or weighted), positive rate, amounts and count."""
    w = {"mean": None, "amount": F.abs("deal_amount"), "value": F.abs("trade_value")}[weight]

    def mean(c):
        return F.avg(c) if w is None else S.null_div(F.sum(F.col(c) * w), F.sum(w))

    return metrics.groupBy("datetime").agg(
        mean("ffr").alias("ffr"), mean("pa").alias("pa"), S.null_div(F.count_if(F.col("pa") > 0).cast("double"), F.count("pa").cast("double")).alias("pos"),
        F.sum(F.abs("deal_amount")).alias("deal_amount"), F.sum(F.abs("trade_value")).alias("value"), F.count("amount").alias("count"))


def indicator_summary(steps: DataFrame, weight: str = "mean") -> DataFrame:
    """Indicators over time weighted by count, amount or value; the positive rate always by count."""
    w = {"mean": F.col("count"), "amount": F.abs("deal_amount"), "value": F.abs("value")}[weight]
    n = F.col("count")
    return steps.agg(S.null_div(F.sum(F.col("ffr") * w), F.sum(w).cast("double")).alias("ffr"), S.null_div(F.sum(F.col("pa") * w), F.sum(w).cast("double")).alias("pa"),
                     S.null_div(F.sum(F.col("pos") * n), F.sum(n).cast("double")).alias("pos"))
