"""Fixed-length history samples for sequence models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.operators.calendars import calendar_of, densify
from strataline.plans import expr as E
from strataline.plans.evaluate import Panel, with_columns


def sequences(panel: DataFrame, columns: list[str], steps: int, fill: str | None = None, pad: float | None = None,
              keep: Column | None = None, start=None, end=None, out: str = "sequence") -> DataFrame:
    """One array of the last ``steps`` dates (oldest first) per panel row.

    History runs over the date grid: dates an instrument lacks are missing
    steps, filled on request with its previous row ('ffill') or previous then
    next row ('both').  ``keep`` and the range select sample ends only.
    """
    struct = F.struct(*[F.col(c).cast("double").alias(c) for c in columns])
    marked = panel.withColumn("_row", struct).withColumn("_own", F.coalesce(keep, F.lit(False)) if keep is not None else F.lit(True))
    grid = densify(marked.select("instrument", "datetime", "_row", "_own"), calendar_of(panel))
    row = E.field("_row")
    if fill == "ffill":
        row = E.ffill(row)
    elif fill == "both":
        row = E.column_map("coalesce", F.coalesce, E.ffill(row), E.bfill(row))
    empty = F.struct(*[F.lit(pad).cast("double").alias(c) for c in columns])
    steps_list = E.Expr("win", "history", (row,), (steps,), lambda f, c: F.collect_list(F.struct(c.alias("r"))).over(f.rows(steps)),
                        back=steps - 1)
    hist = with_columns(Panel(grid), {"_hist": steps_list})
    filled = F.transform("_hist", lambda s: F.coalesce(s["r"], empty))
    if pad is not None:
        filled = F.transform(filled, lambda s: F.struct(*[F.coalesce(s[c], F.lit(float(pad))).alias(c) for c in columns]))
    first = F.get("_hist", F.lit(0))["r"]
    left = F.coalesce(first, empty) if fill == "both" else empty
    full = F.concat(F.array_repeat(left, F.lit(steps) - F.size("_hist")), filled)
    res = hist.where(F.coalesce("_own", F.lit(False))).select("instrument", "datetime", full.alias(out))
    if start is not None:
        res = res.where(F.col("datetime") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        res = res.where(F.col("datetime") <= F.lit(end).cast("timestamp_ntz"))
    return res


def daily_with_buckets(daily: DataFrame, ticks: DataFrame, column: str, minutes: int = 15, buckets: int = 16,
                       open_minute: int = 9 * 60 + 30) -> DataFrame:
    """Daily rows joined with the day's fixed bucket averages of a finer series, as columns."""
    m = F.hour("datetime") * 60 + F.minute("datetime") - open_minute
    slot = F.floor(m / minutes)
    per = ticks.withColumn("_slot", slot).where(F.col("_slot").between(0, buckets - 1)).groupBy(
        "instrument", F.date_trunc("day", "datetime").cast("timestamp_ntz").alias("datetime")).agg(
        *[F.avg(F.when(F.col("_slot") == i, F.col(column))).alias(f"{column}_{i}") for i in range(buckets)])
    return daily.join(per, ["instrument", "datetime"], "left")
