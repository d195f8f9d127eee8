"""Changing the time grain of a panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.functions import timeofday as T
from strataline.plans import expr as E
from strataline.plans.evaluate import Panel, with_columns


def _pick(fn: str, c: str):
    v, t = F.col(c), F.col("datetime")
    named = {
        "last": lambda: F.max_by(v, F.when(v.isNotNull(), t)), "first": lambda: F.min_by(v, F.when(v.isNotNull(), t)),
        "last_row": lambda: F.max_by(v, t), "first_row": lambda: F.min_by(v, t),
        "sum": lambda: F.sum(v), "mean": lambda: F.avg(v), "max": lambda: F.max(v), "min": lambda: F.min(v),
        "count": lambda: F.count(v), "std": lambda: F.stddev_samp(v), "median": lambda: F.percentile(v, F.lit(0.5)),
    }
    return named[fn]()


def resample(panel: DataFrame, freq: str, aggs: dict[str, tuple[str, str]], keep_empty: bool = True,
             forward_fill: bool = False) -> DataFrame:
    """Bucketed aggregates ``out -> (column, function)`` labelled by bucket start.

    ``freq`` is a window duration ('15 minutes').  With ``keep_empty`` each
    instrument gets every bucket between its first and last one.
    """
    start = F.window("datetime", freq)["start"].cast("timestamp_ntz")
    out = panel.groupBy("instrument", start.alias("datetime")).agg(
        *[_pick(fn, c).alias(name) for name, (c, fn) in aggs.items()])
    if keep_empty:
        lives = out.groupBy("instrument").agg(F.min("datetime").alias("a"), F.max("datetime").alias("b"))
        # a day at a time, so that no row carries an instrument's whole grid
        days = lives.select("instrument", "a", "b", F.explode(F.sequence(
            F.date_trunc("day", "a").cast("timestamp_ntz"), F.date_trunc("day", "b").cast("timestamp_ntz"),
            F.expr("INTERVAL 1 DAY"))).alias("d")) if _sub_day(freq) else None
        if days is not None:
            nxt = F.col("d") + F.expr(f"INTERVAL 1 DAY - INTERVAL 1 MICROSECOND")
            grid = days.select("instrument", F.explode(F.sequence(
                F.greatest("a", "d"), F.least(F.col("b"), nxt), F.expr(f"INTERVAL {freq}"))).alias("datetime"))
        else:
            grid = lives.select("instrument", F.explode(F.sequence("a", "b", F.expr(f"INTERVAL {freq}"))).alias("datetime"))
        out = grid.join(out, ["instrument", "datetime"], "left")
    if forward_fill:
        filled = {n: E.ffill(E.field(n)) for n in aggs}
        out = with_columns(Panel(out), filled)
    return out.select("instrument", "datetime", *aggs)


def _sub_day(freq: str) -> bool:
    return any(u in freq for u in ("second", "minute", "hour", "milli"))


def slice_aggregate(panel: DataFrame, start, end, aggs: dict[str, tuple[str, str]]) -> DataFrame:
    """One row per instrument over a closed time slice; last/first skip missing values."""
    cut = panel.where(F.col("datetime").between(F.lit(start), F.lit(end)))
    return cut.groupBy("instrument").agg(*[_pick(fn, c).alias(n) for n, (c, fn) in aggs.items()])


def slice_apply(panel: DataFrame, start, end, column: str, udaf, out: str = "value") -> DataFrame:
    """Slice aggregate by a grouped-aggregate Pandas UDF (the callable form)."""
    cut = panel.where(F.col("datetime").between(F.lit(start), F.lit(end)))
    return cut.groupBy("instrument").agg(udaf(F.col(column)).alias(out))


def session_resample(panel: DataFrame, every: int, aggs: dict[str, tuple[str, str]], region: str = "cn") -> DataFrame:
    """Aggregate to session bars of ``every`` minutes; rows outside the session are left out."""
    inside = panel.where(T.session_index(F.col("datetime"), region).isNotNull())
    bucket = T.session_bucket(F.col("datetime"), every, region)
    return inside.groupBy("instrument", bucket.alias("datetime")).agg(
        *[_pick(fn, c).alias(n) for n, (c, fn) in aggs.items()])


def fill_limit(panel: Panel, columns: list[str], limit: int) -> DataFrame:
    """Forward fill at most ``limit`` consecutive missing rows."""
    exprs = {}
    for c in columns:
        v = E.field(c)
        seen = E.ffill(E.where(~E.is_null(v), E.POS))
        near = E.le(E.sub(E.POS, seen), float(limit))
        exprs[f"_{c}"] = E.where(near, E.ffill(v))
    out = with_columns(panel, exprs)
    return out.select(*[F.col(f"_{c}").alias(c) if c in columns else F.col(c) for c in panel.df.columns])


def gap_counts(panel: Panel, step: str) -> DataFrame:
    """Missing periods per instrument against an expected row spacing."""
    us = E.span_micros(step)
    t = E.column_map("micros", lambda c: F.unix_micros(c.cast("timestamp")), E.field("datetime"))
    lagged = with_columns(panel, {"_t": t, "_p": E.ref(t, 1)})
    gap = F.col("_t") - F.col("_p")
    missing = F.when(gap > us, F.floor(gap / us) - 1).otherwise(0)
    return lagged.groupBy("instrument").agg(F.sum(missing).cast("bigint").alias("gaps"))


def outlier_flags(panel: Panel, price_jump: float, volume_spike: float, window: int = 96) -> DataFrame:
    """Rows with a large price move or a volume spike over its full-window mean."""
    c, v = E.field("close"), E.field("volume")
    jump = E.gt(E.abs_(c / E.ref(c, 1) - 1), price_jump)
    spike = E.gt(v, E.full_window(E.mean(v, window), v, window) * volume_spike)
    return with_columns(panel, {"is_outlier": jump | spike})


def sample_minutes(panel: DataFrame, at: list[str]) -> DataFrame:
    """Rows at the given hh:mm times, relabelled to their date."""
    return panel.where(F.date_format("datetime", "HH:mm").isin(at)).withColumn(
        "datetime", F.date_trunc("day", "datetime").cast("timestamp_ntz"))
