"""Building and reading panels: bars from ticks, Parquet/CSV scans, alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def bars_from_ticks(ticks: DataFrame, unit: str, price: str = "value", size: str | None = None,
                    in_order: bool = False) -> DataFrame:
    """OHLCV bars per (instrument, truncated time); partial aggregation makes hot instruments safe.

    ``in_order``: volumes are added up in the order of time, so that they have the same last bit however the ticks are split;
    for bars whose ticks fit a task.
    """
    amount = F.sum(price if size is None else size)
    if in_order:
        v = F.col(price if size is None else size).cast("double")
        ticked = F.array_sort(F.collect_list(F.when(v.isNotNull(), F.struct(F.col("datetime").alias("t"), v.alias("v")))))
        amount = F.when(F.size(ticked) > 0, F.aggregate(ticked, F.lit(0.0), lambda s, x: s + x["v"]))
    vwap = F.avg(price) if size is None else F.sum(F.col(price) * F.col(size)) / F.sum(size)
    return ticks.groupBy("instrument", F.date_trunc(unit, "datetime").cast("timestamp_ntz").alias("datetime")).agg(
        F.min_by(price, "datetime").alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
        F.max_by(price, "datetime").alias("close"), amount.alias("volume"), vwap.alias("vwap"))


def read_raw(spark: SparkSession, path: str, fmt: str = "parquet", schema=None, include: list[str] | None = None,
             exclude: list[str] | None = None, symbol: str = "symbol", date: str = "date") -> DataFrame:
    """Raw bars from CSV or Parquet with chosen fields; the key columns are renamed."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)
    fields = [c for c in df.columns if c not in (symbol, date)]
    if include:
        fields = [c for c in fields if c in include]
    if exclude:
        fields = [c for c in fields if c not in exclude]
    return df.select(F.col(symbol).alias("instrument"),
                     F.col(date).cast("timestamp_ntz").alias("datetime"), *fields)


def clean(df: DataFrame) -> DataFrame:
    """NaN to NULL in every floating column, so that missing has one form."""
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c)
                       for c, t in df.dtypes])


def outer_align(parts: dict[str, DataFrame], key=("instrument", "datetime")) -> DataFrame:
    """Full-outer alignment of several panels; columns are prefixed with their group name."""
    out = None
    for group, df in parts.items():
        named = df.select(*key, *[F.col(c).alias(f"{group}__{c}") for c in df.columns if c not in key])
        out = named if out is None else out.join(named, list(key), "full")
    return out


def nest(parts: list[DataFrame], how: str = "left", key=("instrument", "datetime")) -> DataFrame:
    """Horizontal merge where a later panel replaces columns of the same name."""
    out = parts[0]
    for df in parts[1:]:
        dup = [c for c in out.columns if c in df.columns and c not in key]
        out = out.drop(*dup).join(df, list(key), how)
    return out


def market_hours(df: DataFrame, sessions=(("09:15", "11:30"), ("13:00", "15:00"))) -> DataFrame:
    """Ticks inside trading sessions, both ends included."""
    def minute(t):
        return int(t[:2]) * 3600 + int(t[3:]) * 60
    s = F.hour("datetime") * 3600 + F.minute("datetime") * 60 + F.second("datetime")
    frac = s + F.expr("extract(second from datetime) - second(datetime)").cast("double")
    ok = F.lit(False)
    for a, b in sessions:
        ok = ok | ((frac >= minute(a)) & (frac <= minute(b)))
    return df.where(ok)
