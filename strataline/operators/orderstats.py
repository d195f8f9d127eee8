"""Exact ranks and quantiles inside groups of any size.

Small groups use an ordinary window.  When one group is too large for a task,
values are first reduced to (group, value) counts, spread over literal value
ranges, ranked inside each range and shifted by the ranges before it, so no
task ever sees a whole group and ties never pile up.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataline.plans.sizing import row_limit, settle, skew_proof, split_points, with_range_bucket


def value_counts(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value) -> _cnt rows, _before smaller rows, _total non-missing rows; hot-group safe."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_cnt"))
    typed = settle(counts.withColumn("_key", F.col(value).cast("double")))
    parts = math.ceil(typed.count() / max(1, row_limit(df) // 4))
    ranged = with_range_bucket(typed, "_key", split_points(typed, "_key", parts), "_rng")
    per_range = ranged.groupBy(*by, "_rng").agg(F.sum("_cnt").alias("_n"))
    w = Window.partitionBy(*by).orderBy("_rng")
    shift = per_range.select(
        *by, "_rng",
        F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_shift"),
        F.sum("_n").over(Window.partitionBy(*by)).alias("_total"))
    inside = Window.partitionBy(*by, "_rng").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(shift, [*by, "_rng"]).select(
        *by, value, "_cnt",
        (F.col("_shift") + F.coalesce(F.sum("_cnt").over(inside), F.lit(0))).alias("_before"), "_total")


def average_rank(df: DataFrame, by: list[str], value: str, out: str, pct: bool = False,
                 hot: bool | None = None) -> DataFrame:
    """Average-tie ascending rank of ``value`` in its group; missing stays missing."""
    if hot is None:
        hot = skew_proof(df)
    if not hot:
        v = F.col(value)
        r = (F.rank().over(Window.partitionBy(*by).orderBy(v.asc_nulls_last()))
             + (F.count(v).over(Window.partitionBy(*by, value)) - 1) / F.lit(2.0))
        if pct:
            r = r / F.count(v).over(Window.partitionBy(*by))
        return df.withColumn(out, F.when(v.isNotNull(), r))
    stats = value_counts(df, by, value)
    r = F.col("_before") + (F.col("_cnt") + 1) / F.lit(2.0)
    ranks = stats.select(*by, value, (r / F.col("_total") if pct else r).alias(out))
    return df.join(ranks, [*by, value], "left").select(*df.columns, out)


def group_quantiles(df: DataFrame, by: list[str], value: str, qs: dict[str, float],
                    hot: bool | None = None) -> DataFrame:
    """One row per group with exact linear-interpolation quantiles."""
    if hot is None:
        hot = skew_proof(df)
    if not hot:
        aggs = [F.percentile(value, F.lit(q)).alias(name) for name, q in qs.items()]
        return df.groupBy(*by).agg(*aggs)
    keyed = df if by else df.withColumn("_all", F.lit(0))
    keys = by or ["_all"]
    s = value_counts(keyed.select(*keys, value), keys, value)

    def at(index):
        inside = (F.col("_before") <= index) & (index < F.col("_before") + F.col("_cnt"))
        return F.max(F.when(inside, F.col(value)))

    out = []
    for name, q in qs.items():
        place = (F.col("_total") - 1) * F.lit(float(q))
        lo = F.floor(place)
        hi = F.least(lo + 1, F.col("_total") - 1)
        low, high = at(lo), at(hi)
        frac = F.max(place - lo)
        out.append((low + (high - low) * frac).alias(name))
    res = s.groupBy(*keys).agg(*out)
    return res if by else res.drop("_all")


def top_rows(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """First k rows per group; Spark trims each map partition to k before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def ordered_place(df: DataFrame, by: list[str], value: str, tiebreak: list[str], place: str, total: str,
                  descending: bool = False, hot: bool | None = None) -> DataFrame:
    """1-based unique position by (value, tiebreak) and group size, over non-missing values."""
    rows = df.where(F.col(value).isNotNull())
    if hot is None:
        hot = skew_proof(df)
    if not hot:
        order = [F.col(value).desc() if descending else F.col(value), *tiebreak]
        return rows.withColumn(place, F.row_number().over(Window.partitionBy(*by).orderBy(*order))) \
                   .withColumn(total, F.count(F.lit(1)).over(Window.partitionBy(*by)))
    signed = rows.withColumn("_v", -F.col(value) if descending else F.col(value))
    s = value_counts(signed.select(*by, "_v"), by, "_v")
    tie = Window.partitionBy(*by, "_v").orderBy(*tiebreak)
    return (signed.join(s, [*by, "_v"])
            .withColumn(place, F.col("_before") + F.row_number().over(tie))
            .withColumnRenamed("_total", total).select(*df.columns, place, total))


def places(df: DataFrame, by: list[str], specs: dict[str, tuple[str, bool]], tiebreak: list[str], total: tuple[str, str] | None = None,
           hot: bool | None = None) -> DataFrame:
    """All rows with several unique positions at once, ``out: (value, descending)``, missing where the value is; and, as ``total``
    (out, value), the group's number of non-missing values.

    The positions of a report share one exchange; no order is joined back.
    """
    if hot is None:
        hot = skew_proof(df)
    if not hot:
        group = Window.partitionBy(*by)
        cols = {}
        for out, (value, descending) in specs.items():
            first = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
            cols[out] = F.when(F.col(value).isNotNull(), F.row_number().over(group.orderBy(first, *tiebreak)))
        if total:
            cols[total[0]] = F.count(total[1]).over(group)
        return df.withColumns(cols)
    for out, (value, descending) in specs.items():
        placed = ordered_place(df.select(*by, *tiebreak, value), by, value, tiebreak, out, "_of", descending, hot=True)
        df = df.join(placed.select(*by, *tiebreak, out), [*by, *tiebreak], "left")
    return df.join(df.groupBy(*by).agg(F.count(total[1]).alias(total[0])), by) if total else df
