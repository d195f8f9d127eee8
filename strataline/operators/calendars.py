"""Calendars: distinct times with a running index, shifts, resampling, densify."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataline.functions import timeofday as T


def calendar_of(panel: DataFrame) -> DataFrame:
    """Distinct datetimes with a 0-based index.

    The index is built per month and shifted by the months before it, so only
    the month totals (a few hundred rows) are ordered in one task.
    """
    days = panel.select("datetime").distinct().withColumn("_m", F.date_trunc("month", "datetime"))
    months = days.groupBy("_m").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)
    shift = months.select("_m", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy("_m").orderBy("datetime")
    return days.join(shift, "_m").select(
        "datetime", (F.col("_shift") + F.row_number().over(inside) - 1).cast("bigint").alias("idx"))


def slice_calendar(cal: DataFrame, start=None, end=None) -> DataFrame:
    c = F.col("datetime")
    cond = (c >= F.lit(start) if start is not None else F.lit(True)) & (c <= F.lit(end) if end is not None else F.lit(True))
    return cal.where(cond)


def locate(cal: DataFrame, start, end) -> DataFrame:
    """One row: first calendar time >= start, last <= end, and their indexes."""
    c = F.col("datetime")
    lo, hi = c >= F.lit(start), c <= F.lit(end)
    return cal.agg(F.min(F.when(lo, c)).alias("start"), F.max(F.when(hi, c)).alias("end"),
                   F.min(F.when(lo, F.col("idx"))).alias("start_idx"), F.max(F.when(hi, F.col("idx"))).alias("end_idx"))


def shift_dates(dates: DataFrame, cal: DataFrame, k: int, align: str | None = None, clip: bool = True,
                column: str = "datetime", out: str = "shifted") -> DataFrame:
    """Calendar date k steps away; off-calendar dates align left or right first (else they give NULL)."""
    c = cal.select(F.col("datetime").alias("_d"), F.col("idx").alias("_i"))
    last = c.agg(F.max("_i").alias("m")).first()["m"]
    ids = dates.select(F.col(column).alias("_d")).distinct()
    exact = ids.join(c, "_d", "left")
    if align is not None:
        both = ids.select("_d", F.lit(None).cast("bigint").alias("_i"), F.lit(1).alias("_q")).unionByName(
            c.withColumn("_q", F.lit(0)))
        near = _nearest(both, align)
        beyond = F.lit(-1) if align == "left" else F.lit(last + 1)
        exact = near.where("_q = 1").select("_d", F.coalesce("_i", beyond).alias("_i"))
    at = F.col("_i") + k
    at = F.greatest(F.lit(0), F.least(F.lit(last), at)) if clip else at
    target = exact.select(F.col("_d").alias(column), F.when(F.col("_i").isNotNull(), at).alias("_t"))
    back = c.select(F.col("_i").alias("_t"), F.col("_d").alias(out))
    return dates.join(target.join(back, "_t", "left").drop("_t"), column, "left")


def _nearest(both: DataFrame, align: str) -> DataFrame:
    """Index of the closest calendar day before or after, via month blocks and their summaries."""
    b = both.withColumn("_m", F.date_trunc("month", "_d"))
    last = align == "left"
    per = b.groupBy("_m").agg((F.max("_i") if last else F.min("_i")).alias("_far"))
    w = Window.orderBy("_m")
    far = F.last("_far", True).over(w.rowsBetween(Window.unboundedPreceding, -1)) if last else \
        F.first("_far", True).over(w.rowsBetween(1, Window.unboundedFollowing))
    carry = per.select("_m", far.alias("_carry"))
    inside = Window.partitionBy("_m").orderBy("_d", "_q")
    near = F.last("_i", True).over(inside.rowsBetween(Window.unboundedPreceding, 0)) if last else \
        F.first("_i", True).over(Window.partitionBy("_m").orderBy("_d", F.desc("_q")).rowsBetween(0, Window.unboundedFollowing))
    return b.join(carry, "_m").withColumn("_i", F.coalesce(near, F.col("_carry")))


def resample_calendar(cal: DataFrame, freq: str, count: int = 1, region: str = "cn") -> DataFrame:
    """Every count-th day / first day of week / first day of month, or session minute bars."""
    if freq == "minute":
        return cal.select(T.session_bucket(F.col("datetime"), count, region).alias("datetime")).distinct()
    days = calendar_of(cal.select(F.date_trunc("day", "datetime").cast("timestamp_ntz").alias("datetime")))
    if freq == "day":
        kept = days
    else:
        unit = {"week": "week", "month": "month"}[freq]
        firsts = days.groupBy(F.date_trunc(unit, "datetime").alias("_u")).agg(F.min("datetime").alias("datetime"))
        kept = calendar_of(firsts.select("datetime"))
    return kept.where(F.col("idx") % count == 0).select("datetime")


def minutes_from_days(days: DataFrame, every: int = 1,
                      sessions=(("09:30:00", "11:29:00"), ("13:00:00", "14:59:00"))) -> DataFrame:
    """Expand calendar days into session minutes, both session ends included."""
    day = F.date_trunc("day", "datetime").cast("timestamp_ntz")
    parts = []
    for a, b in sessions:
        lo = day + F.expr(f"INTERVAL '{a}' HOUR TO SECOND")
        hi = day + F.expr(f"INTERVAL '{b}' HOUR TO SECOND")
        parts.append(F.sequence(lo, hi, F.expr(f"INTERVAL {every} MINUTE")))
    return days.select(F.explode(F.array_distinct(F.concat(*parts))).alias("datetime")).distinct()


def calendar_by_participation(panel: DataFrame, threshold: float = 0.5, minimum: int = 10) -> DataFrame:
    """Dates on which enough of the instruments listed by then have a row."""
    per_day = panel.groupBy("datetime").agg(F.count_distinct("instrument").alias("n"))
    born = panel.groupBy("instrument").agg(F.min("datetime").alias("datetime")).groupBy("datetime").agg(
        F.count(F.lit(1)).alias("new"))
    daily = per_day.join(born, "datetime", "left")
    # listed-by-then counts accumulate over the date table, which is one row per date
    month = daily.withColumn("_m", F.date_trunc("month", "datetime"))
    totals = month.groupBy("_m").agg(F.coalesce(F.sum("new"), F.lit(0)).alias("_t"))
    carry = totals.select("_m", F.coalesce(F.sum("_t").over(
        Window.orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_c"))
    inside = Window.partitionBy("_m").orderBy("datetime").rowsBetween(Window.unboundedPreceding, 0)
    listed = F.col("_c") + F.coalesce(F.sum("new").over(inside), F.lit(0))
    out = month.join(carry, "_m").withColumn("listed", listed.cast("bigint"))
    need = F.greatest(F.floor(F.col("listed") * threshold), F.lit(minimum))
    return out.where(F.col("n") >= need).select("datetime", "n", "listed")


def calendar_rows(spans: DataFrame, cal: DataFrame) -> DataFrame:
    """(instrument, datetime, idx) for every calendar time inside each span.

    Spans are cut into days and meet the calendar by equality on the day, so no
    range join is needed and no row carries more than its days.
    """
    days = spans.select("instrument", "start", "end", F.explode(F.sequence(
        F.to_date("start"), F.to_date("end"), F.expr("INTERVAL 1 DAY"))).alias("_day"))
    c = cal.withColumn("_day", F.to_date("datetime"))
    return days.join(c, "_day").where(F.col("datetime").between(F.col("start"), F.col("end"))).select(
        "instrument", "datetime", "idx")


def densify(panel: DataFrame, cal: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """Give every instrument a row on each calendar time of its own life (or of given spans)."""
    if spans is None:
        spans = panel.groupBy("instrument").agg(F.min("datetime").alias("start"), F.max("datetime").alias("end"))
    full = calendar_rows(spans, cal).select("instrument", "datetime")
    return full.join(panel, ["instrument", "datetime"], "left").select(*panel.columns)
