"""Point-in-time facts: what was known about each period on each day.

Facts are rows (instrument, date, period, value): the value of a fiscal period
as published on a date, revisions included.  All work is proportional to the
number of publications: expressions over periods are evaluated once per
publication day and carried forward to the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataline.functions import timeofday as T
from strataline.plans import expr as E
from strataline.plans.evaluate import Frame, Panel, _column, _replace, stage, with_columns


def as_published(facts: DataFrame, period: int | None = None) -> DataFrame:
    """Each fact with the date its next revision replaces it (missing while current)."""
    if period is not None:
        facts = facts.where(F.col("period") == period)
    w = Window.partitionBy("instrument", "period").orderBy("date")
    return facts.withColumn("until", F.lead("date").over(w))


def series_at_publications(facts: DataFrame, periods: int | None, quarterly: bool = True) -> DataFrame:
    """For every publication day the last ``periods`` periods (None: all) as known then.

    Rows: instrument, day, period_idx, value; unpublished periods in between
    are rows with a missing value.  Each day reaches its periods by equality
    on the period, so an instrument's history is never paired with itself.
    """
    idx = T.period_index(F.col("period"), quarterly).cast("bigint")
    days = facts.groupBy("instrument", "date").agg(F.max(idx).alias("_top"), F.min(idx).alias("_low"))
    known = with_columns(Panel(days.withColumnRenamed("date", "datetime")),
                         {"top": E.max_(E.field("_top"), 0), "low": E.min_(E.field("_low"), 0)})
    first = F.col("low") if periods is None else F.greatest(F.col("low"), F.col("top") - periods + 1)
    spans = known.select("instrument", F.col("datetime").alias("day"), F.explode(F.sequence(
        first.cast("bigint"), F.col("top").cast("bigint"))).alias("period_idx"))
    rev = as_published(facts).select("instrument", idx.alias("period_idx"), "date", "until", "value")
    hit = spans.join(rev, ["instrument", "period_idx"]).where(
        (F.col("date") <= F.col("day")) & (F.col("until").isNull() | (F.col("day") < F.col("until"))))
    return spans.join(hit.select("instrument", "day", "period_idx", "value"), ["instrument", "day", "period_idx"], "left")


def evaluate_at_publications(facts: DataFrame, inner: E.Expr, quarterly: bool = True) -> DataFrame:
    """Inner expression over the periods known on each publication day; its value at the newest period."""
    if inner.ahead > 0:
        raise ValueError("a point-in-time expression cannot look ahead")
    running = _by_changes(facts, inner, quarterly)
    if running is not None:
        return running
    reach = None if inner.unbounded else int(inner.back) + 1
    s = series_at_publications(facts, reach, quarterly)
    ev = stage(s, {"_v": inner}, Frame(["instrument", "day"], "period_idx"))
    return ev.groupBy("instrument", "day").agg(F.max_by("_v", "period_idx").alias("value"))


def _by_changes(facts: DataFrame, inner: E.Expr, quarterly: bool) -> DataFrame | None:
    """Sums and counts over all periods from what each revision changes in them; None for other expressions.

    A revision adds its value and takes back the one that it replaces, so the work is one row per revision, however many
    periods there are.  What surrounds the sums is evaluated at the newest period.
    """
    nodes = list(inner.nodes())
    sums = {n.key: n for n in nodes if n.kind == "acc"}
    if not sums or any(n.kind not in ("field", "const", "map", "acc") for n in nodes) or inner.fields() != {"value"} \
            or any(n.params[0] not in ("sum", "count") or n.args[0].unbounded for n in sums.values()):
        return None
    outer = _replace(inner, {k: f"_acc{i}" for i, k in enumerate(sums)})
    values = facts.select("instrument", "period", "date", *[_column(n.args[0], {}).cast("double").alias(f"_x{i}") for i, n in enumerate(sums.values())])
    w = Window.partitionBy("instrument", "period").orderBy("date")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    seen = lambda c: c.isNotNull().cast("double")
    changes = []
    for i in range(len(sums)):
        old = F.lag(f"_x{i}").over(w)
        changes += [(zero(F.col(f"_x{i}")) - zero(old)).alias(f"_s{i}"), (seen(F.col(f"_x{i}")) - seen(old)).alias(f"_n{i}")]
    names = [f"_{k}{i}" for i in range(len(sums)) for k in "sn"]
    days = values.select("instrument", "date", *changes).groupBy("instrument", F.col("date").alias("datetime")).agg(*[F.sum(c).alias(c) for c in names])
    total = with_columns(Panel(days), {f"_t{c}": E.sum_(E.field(c), 0) for c in names})
    acc = [F.when(F.col(f"_t_n{i}") > 0, F.col(f"_t_s{i}")).alias(f"_acc{i}") if n.params[0] == "sum" else F.col(f"_t_n{i}").cast("long").alias(f"_acc{i}")
           for i, n in enumerate(sums.values())]
    known = total.select("instrument", F.col("datetime").alias("day"), *acc)
    if "value" in outer.fields():
        known = known.join(series_at_publications(facts, 1, quarterly).select("instrument", "day", "value"), ["instrument", "day"])
    return known.select("instrument", "day", _column(outer, {}).alias("value"))


def carry_to_calendar(events: DataFrame, grid: DataFrame, day: str = "day", value: str = "value") -> DataFrame:
    """Latest event value on or before each (instrument, datetime) of ``grid``: union and running last, no range join."""
    g = grid.select("instrument", "datetime", F.lit(None).cast("double").alias("_v"), F.lit(1).alias("_kind"))
    e = events.select("instrument", F.col(day).cast("timestamp_ntz").alias("datetime"), F.col(value).cast("double").alias("_v"), F.lit(0).alias("_kind"))
    # one row per key and kind; struct keeps a published missing value apart from "no event"
    u = g.unionByName(e).groupBy("instrument", "datetime").agg(
        F.max(F.when(F.col("_kind") == 1, 1)).alias("_grid"),
        F.max(F.when(F.col("_kind") == 0, F.struct(F.lit(1).alias("k"), F.col("_v").alias("v")))).alias("_e"))
    seen = with_columns(Panel(u), {"_s": E.ffill(E.field("_e"))})
    return seen.where("_grid = 1").select("instrument", "datetime", F.col("_s.v").alias(value))


def point_in_time(facts: DataFrame, grid: DataFrame, inner: E.Expr | None = None, quarterly: bool = True) -> DataFrame:
    """Value of an expression over periods as known on each grid day."""
    events = evaluate_at_publications(facts, inner if inner is not None else E.field("value"), quarterly)
    return carry_to_calendar(events, grid)


def period_value(facts: DataFrame, grid: DataFrame, period: int) -> DataFrame:
    """Value of one named period as known on each grid day; missing before its first publication."""
    return carry_to_calendar(facts.where(F.col("period") == period), grid, day="date")


def latest_facts(facts: DataFrame) -> DataFrame:
    """Latest revision of every period."""
    return facts.groupBy("instrument", "period").agg(F.max_by("value", "date").alias("value"), F.max("date").alias("date"))
