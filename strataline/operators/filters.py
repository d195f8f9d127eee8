"""Row selection: names, rules, spans, segments and trailing ranges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataline.operators.calendars import calendar_of, calendar_rows
from strataline.plans import expr as E
from strataline.plans.evaluate import Panel, features, with_columns


def clip_spans(universe: DataFrame, start, end) -> DataFrame:
    """Membership spans cut to a range, empty ones removed."""
    a, b = F.greatest("start", F.lit(start).cast("timestamp_ntz")), F.least("end", F.lit(end).cast("timestamp_ntz"))
    return universe.withColumns({"start": a, "end": b}).where(F.col("start") <= F.col("end"))


def instruments_in(universe: DataFrame, start, end) -> DataFrame:
    return clip_spans(universe, start, end).select("instrument").distinct()


def spans_from_flags(flags: DataFrame, flag: str, nan_is_true: bool = False) -> DataFrame:
    """Runs of true rows per instrument as spans; expects one row per calendar time with ``idx``."""
    on = F.coalesce(F.col(flag), F.lit(nan_is_true))
    rows = flags.where(on).select("instrument", "datetime", "idx")
    ranked = with_columns(Panel(rows), {"_pos": E.POS})
    return ranked.groupBy("instrument", (F.col("idx") - F.col("_pos")).alias("_run")).agg(
        F.min("datetime").alias("start"), F.max("datetime").alias("end")).drop("_run")


def _membership(universe: DataFrame, cal: DataFrame) -> DataFrame:
    """One row per (instrument, calendar time) inside a span."""
    return calendar_rows(universe, cal).distinct()


def filter_by_name(universe: DataFrame, cal: DataFrame, pattern: str, fstart=None, fend=None) -> DataFrame:
    """Spans of instruments whose name matches from its start; outside the filter period spans pass."""
    grid = _membership(universe, cal)
    ok = F.col("instrument").rlike(f"^(?:{pattern})")
    return spans_from_flags(grid.withColumn("_on", ok | ~_in_period(fstart, fend)), "_on")


def _in_period(fstart, fend) -> Column:
    t, c = F.col("datetime"), F.lit(True)
    if fstart is not None:
        c = c & (t >= F.lit(fstart).cast("timestamp_ntz"))
    if fend is not None:
        c = c & (t <= F.lit(fend).cast("timestamp_ntz"))
    return c


def filter_by_rule(universe: DataFrame, cal: DataFrame, panel: Panel, rule: E.Expr, fstart=None, fend=None,
                   keep: bool = False, missing: bool = False) -> DataFrame:
    """Spans where the rule holds.

    An instrument without any panel row counts as all ``keep``; a calendar time
    without a rule value counts as ``missing``.
    """
    grid = _membership(universe, cal)
    rules = features(panel, {"_rule": rule})
    known = rules.select("instrument").distinct().withColumn("_known", F.lit(True))
    j = grid.join(rules, ["instrument", "datetime"], "left").join(known, "instrument", "left")
    on = F.when(F.col("_known").isNull(), F.lit(keep)).otherwise(F.coalesce("_rule", F.lit(missing)))
    return spans_from_flags(j.withColumn("_on", on | ~_in_period(fstart, fend)), "_on")


def filter_chain(universe: DataFrame, steps: list) -> DataFrame:
    """Apply span-to-span filters in order."""
    return reduce(lambda u, f: f(u), steps, universe)


def full_history(panel: DataFrame, start, end) -> DataFrame:
    """Keep instruments whose data starts by ``start`` and reaches ``end``."""
    lives = panel.groupBy("instrument").agg(F.min("datetime").alias("a"), F.max("datetime").alias("b"))
    ok = lives.where((F.col("a") <= F.lit(start).cast("timestamp_ntz")) & (F.col("b") >= F.lit(end).cast("timestamp_ntz")))
    return panel.join(ok.select("instrument"), "instrument", "left_semi")


def drop_missing(panel: DataFrame, columns: list[str]) -> DataFrame:
    """Rows where a column is NULL go; a NaN is no missing value here."""
    return panel.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns]))


def drop_columns(panel: DataFrame, columns: list[str]) -> DataFrame:
    return panel.drop(*columns)


def keep_columns(panel: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """Within ``group`` keep only ``columns``; columns outside the group stay."""
    return panel.select(*[c for c in panel.columns if c not in group or c in columns])


def cut_edges(panel: Panel, first: int = 0, last: int = 0) -> DataFrame:
    """Drop the first and last rows of every instrument."""
    sizes = panel.df.groupBy("instrument").agg(F.count(F.lit(1)).alias("_n"))
    placed = with_columns(panel, {"_pos": E.POS}).join(sizes, "instrument")
    return placed.where((F.col("_pos") > first) & (F.col("_pos") <= F.col("_n") - last)).drop("_pos", "_n")


def select_time(panel: DataFrame, at=None, start=None, end=None, times: list | None = None,
                instruments: list | None = None) -> DataFrame:
    """Index selection by a time, a closed range, a list of times or instruments."""
    t, c = F.col("datetime"), F.lit(True)
    if at is not None:
        c = c & (t == F.lit(at).cast("timestamp_ntz"))
    if times is not None:
        c = c & t.isin([F.lit(x).cast("timestamp_ntz") for x in times])
    if instruments is not None:
        c = c & F.col("instrument").isin(instruments)
    return panel.where(c & _in_period(start, end))


def trailing_dates(panel: DataFrame, current, periods: int) -> DataFrame:
    """Rows of the last ``periods`` distinct times up to ``current``."""
    upto = panel.where(F.col("datetime") <= F.lit(current).cast("timestamp_ntz"))
    dates = upto.select("datetime").distinct().orderBy(F.desc("datetime")).limit(periods)
    return upto.join(dates, "datetime", "left_semi")


def with_segment(panel: DataFrame, segments: dict[str, tuple]) -> DataFrame:
    """Name of the first segment holding the row; rows outside all segments drop."""
    pick = None
    for name, (a, b) in segments.items():
        hit = _in_period(a, b)
        pick = F.when(hit, F.lit(name)) if pick is None else pick.when(hit, F.lit(name))
    return panel.withColumn("segment", pick).where(F.col("segment").isNotNull())


def split_by_date(panel: DataFrame, date) -> tuple[DataFrame, DataFrame]:
    """Rows up to and including ``date``, and rows after it."""
    d = F.lit(date).cast("timestamp_ntz")
    return panel.where(F.col("datetime") <= d), panel.where(F.col("datetime") > d)


def split_by_count(panel: DataFrame, left: int) -> tuple[DataFrame, DataFrame]:
    """Rows of the first ``left`` distinct dates, and the rest."""
    cal = calendar_of(panel).where(F.col("idx") < left).select("datetime")
    return panel.join(cal, "datetime", "left_semi"), panel.join(cal, "datetime", "left_anti")


def tradability(panel: Panel, threshold: float | None = None, buy: E.Expr | None = None, sell: E.Expr | None = None) -> DataFrame:
    """``limit_buy`` / ``limit_sell`` flags from a change threshold or two expressions; no close means suspended."""
    suspended = E.is_null(E.field("close"))
    if threshold is not None:
        buy, sell = E.field("change") >= threshold, E.field("change") <= -threshold
    out = {"limit_buy": suspended if buy is None else buy | suspended,
           "limit_sell": suspended if sell is None else sell | suspended}
    return with_columns(panel, out)


def tradability_over(flags: DataFrame, freq: str) -> DataFrame:
    """Coarser step: limited only when every row of the step is."""
    step = F.window("datetime", freq)["start"].cast("timestamp_ntz").alias("datetime")
    return flags.groupBy("instrument", step).agg(F.bool_and("limit_buy").alias("limit_buy"),
                                                 F.bool_and("limit_sell").alias("limit_sell"))
