"""Top-k, deduplication, unions, replacement and membership changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataline.operators.orderstats import ordered_place, top_rows
from strataline.plans import expr as E
from strataline.plans.evaluate import Panel, with_columns


def ordered_result(panel: DataFrame, swap: bool = False) -> DataFrame:
    """Final ordering for a sink."""
    return panel.orderBy("datetime", "instrument") if swap else panel.orderBy("instrument", "datetime")


def quantile_members(df: DataFrame, column: str, q: float, top: bool = True) -> DataFrame:
    """Per date the ``int(n * q)`` largest (or smallest) rows; ties go to the first instrument."""
    placed = ordered_place(df, ["datetime"], column, ["instrument"], "_place", "_n", descending=top)
    return placed.where(F.col("_place") <= F.floor(F.col("_n") * F.lit(q))).drop("_place", "_n")


def top_k(df: DataFrame, column: str, k: int, top: bool = True) -> DataFrame:
    order = F.col(column).desc() if top else F.col(column).asc()
    return top_rows(df.where(F.col(column).isNotNull()), ["datetime"], [order, F.col("instrument")], k)


def top_by_size(df: DataFrame, column: str, k: int) -> DataFrame:
    """Per date the k largest absolute scores with their direction."""
    sized = df.withColumn("_abs", F.abs(column))
    return top_k(sized, "_abs", k).withColumn("direction", F.signum(column)).drop("_abs")


def keep_first(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in ``order`` (a mergeable aggregate, safe for hot keys)."""
    rest = [c for c in df.columns if c not in key]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*key).agg(first.alias("_f")).select(*key, *[F.col(f"_f.{c}").alias(c) for c in rest])


def concat_keep_newest(parts: list[DataFrame], key: list[str]) -> DataFrame:
    """Stack rolling results; for duplicate keys keep the part that starts latest."""
    tagged = []
    for i, p in enumerate(parts):
        start = p.agg(F.min("datetime")).first()[0]
        tagged.append((start, i, p))
    tagged.sort(key=lambda x: (x[0] is None, x[0], x[1]))
    stacked = reduce(DataFrame.unionByName, [p.withColumn("_part", F.lit(n)) for n, (_, _, p) in enumerate(tagged)])
    rest = [c for c in parts[0].columns if c not in key]
    return stacked.groupBy(*key).agg(F.max_by(F.struct(*rest), "_part").alias("_f")).select(
        *key, *[F.col(f"_f.{c}").alias(c) for c in rest])


def replace_range(old: DataFrame, new: DataFrame) -> DataFrame:
    """Drop the new data's date range from the old data, then append."""
    lo, hi = new.agg(F.min("datetime"), F.max("datetime")).first()
    if lo is None:
        return old
    kept = old.where(~F.col("datetime").between(F.lit(lo), F.lit(hi)))
    return kept.unionByName(new)


def membership_changes(snapshots: DataFrame, cal: DataFrame) -> DataFrame:
    """Add/remove events between consecutive membership snapshots.

    ``snapshots`` has (instrument, datetime).  An add is dated the calendar day
    after the previous snapshot, a remove the last snapshot that still had it.
    """
    dates = snapshots.select("datetime").distinct()
    grid = cal.select(F.col("datetime").alias("_d"), F.col("idx").alias("_i"))
    seq = dates.join(grid, dates["datetime"] == grid["_d"]).select("datetime", "_i")
    w = Window.orderBy("datetime")  # one row per snapshot date
    links = seq.select("datetime", F.lag("datetime").over(w).alias("prev"), F.lag("_i").over(w).alias("prev_i"),
                       F.lead("datetime").over(w).alias("next"))
    here = snapshots.join(links, "datetime")
    before = snapshots.select("instrument", F.col("datetime").alias("prev"))
    after = snapshots.select("instrument", F.col("datetime").alias("next"))
    last = cal.agg(F.max("idx")).first()[0]
    adds = here.where(F.col("prev").isNotNull()).join(before, ["instrument", "prev"], "left_anti").select(
        "instrument", F.least(F.col("prev_i") + 1, F.lit(last)).alias("_i"))
    adds = adds.join(grid, "_i").select("instrument", F.col("_d").alias("datetime"), F.lit("add").alias("type"))
    removes = here.where(F.col("next").isNotNull()).join(after, ["instrument", "next"], "left_anti").select(
        "instrument", "datetime", F.lit("remove").alias("type"))
    return adds.unionByName(removes)


def spans_from_changes(changes: DataFrame, current: DataFrame, open_start, open_end) -> DataFrame:
    """Change events and today's members to membership spans.

    Every remove closes a span and every add opens one; a span without its add
    starts at ``open_start``, a current member's last span ends at ``open_end``.
    """
    ends = current.select("instrument", F.lit(open_end).cast("timestamp_ntz").alias("datetime"), F.lit("remove").alias("type"))
    events = changes.unionByName(ends)
    w = Window.partitionBy("instrument").orderBy("datetime", F.when(F.col("type") == "remove", 0).otherwise(1))
    prev_type, prev_date = F.lag("type").over(w), F.lag("datetime").over(w)
    closed = events.select("instrument", "type", F.col("datetime").alias("end"), prev_type.alias("_pt"), prev_date.alias("_pd"))
    return closed.where("type = 'remove'").select(
        "instrument", F.when(F.col("_pt") == "add", F.col("_pd")).otherwise(F.lit(open_start).cast("timestamp_ntz")).alias("start"), "end")


def append_quotes(quotes: DataFrame, extra: DataFrame, price_columns: list[str]) -> DataFrame:
    """Stack extra quotes under quotes; absent columns get defaults."""
    for p in price_columns:
        if p not in extra.columns:
            extra = extra.withColumn(p, F.col("close"))
    for name, value in (("factor", 1.0), ("limit_buy", False), ("limit_sell", False)):
        if name not in extra.columns:
            extra = extra.withColumn(name, F.lit(value))
    return quotes.unionByName(extra, allowMissingColumns=True)


def sum_vectors(parts: list[DataFrame], key: list[str], value: str, fill: float | None = None) -> DataFrame:
    """Add labelled vectors over the union of their labels.

    Without ``fill`` a label missing from any part gives a missing sum.
    """
    stacked = reduce(DataFrame.unionByName, [p.select(*key, value) for p in parts])
    n = F.count(value)
    total = F.sum(value) + (0.0 if fill is None else fill) * (F.lit(len(parts)) - n)
    return stacked.groupBy(*key).agg((F.when(n == len(parts), F.sum(value)) if fill is None else total).alias(value))


def side_by_side(parts: dict[str, DataFrame], key: list[str], value: str) -> DataFrame:
    """Labelled vectors as columns over the union of their labels."""
    stacked = reduce(DataFrame.unionByName, [p.select(*key, F.col(value).alias("_v"), F.lit(n).alias("_n"))
                                             for n, p in parts.items()])
    return stacked.groupBy(*key).agg(*[F.max(F.when(F.col("_n") == n, F.col("_v"))).alias(n) for n in parts])
