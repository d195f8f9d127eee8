"""A panel store of three Parquet tables: calendar, universe spans, features.

Everything here is a DataFrame job: full and incremental loads, upserts, the
bitemporal fact table, the partitioned sink with its manifest, and the decoder
for binary series files.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.operators.calendars import calendar_of, densify
from strataline.operators.setops import keep_first


def full_load(raw: DataFrame, order=None) -> dict[str, DataFrame]:
    """Calendar, universe and calendar-aligned features from raw bars."""
    rest = [c for c in raw.columns if c not in ("instrument", "datetime")]
    one = keep_first(raw, ["instrument", "datetime"], order or [F.col(c) for c in rest])
    cal = calendar_of(one)
    spans = one.groupBy("instrument").agg(F.min("datetime").alias("start"), F.max("datetime").alias("end"))
    return {"calendar": cal, "universe": spans, "features": densify(one, cal, spans)}


def new_instruments(stored: DataFrame, raw: DataFrame) -> DataFrame:
    """Rows of instruments the store does not have yet."""
    return raw.join(stored.select("instrument").distinct(), "instrument", "left_anti")


def newer_rows(universe: DataFrame, raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows after each instrument's stored end (all rows if new) and the extended universe."""
    j = raw.join(universe.select("instrument", F.col("end").alias("_end")), "instrument", "left")
    fresh = j.where(F.col("_end").isNull() | (F.col("datetime") > F.col("_end"))).select(*raw.columns)
    seen = fresh.groupBy("instrument").agg(F.min("datetime").alias("start"), F.max("datetime").alias("end"))
    spans = universe.select("instrument", "start", "end").unionByName(seen).groupBy("instrument").agg(
        F.min("start").alias("start"), F.max("end").alias("end"))
    return fresh, spans


def overlay(old: DataFrame, new: DataFrame, columns: list[str], keep_old_on_null: bool = True) -> DataFrame:
    """Upsert: new values over old ones by key."""
    key = ["instrument", "datetime"]
    a = old.select(*key, *[F.col(c).alias(f"_o_{c}") for c in columns])
    b = new.select(*key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_n_{c}") for c in columns])
    j = a.join(b, key, "full")
    pick = (lambda c: F.coalesce(f"_n_{c}", f"_o_{c}")) if keep_old_on_null else \
        (lambda c: F.when(F.col("_hit"), F.col(f"_n_{c}")).otherwise(F.col(f"_o_{c}")))
    return j.select(*key, *[pick(c).alias(c) for c in columns])


def append_facts(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Bitemporal append: per (instrument, field) only publications after the last stored date."""
    last = stored.groupBy("instrument", "field").agg(F.max("date").alias("_last"))
    fresh = new.join(last, ["instrument", "field"], "left").where(
        F.col("_last").isNull() | (F.col("date") > F.col("_last"))).select(*stored.columns)
    return stored.unionByName(fresh)


def save_partitioned(df: DataFrame, path: str, interval: str, symbol: str = "instrument", by_symbol: bool = True) -> DataFrame:
    """Write by symbol, interval and date; return the manifest (range and rows per symbol and interval).

    With many symbols that makes many small files: ``by_symbol=False`` writes by interval and date only, with the rows
    of a symbol next to each other.
    """
    out = df.withColumn("symbol", F.regexp_replace(symbol, "/", "-")).withColumn("interval", F.lit(interval)) \
            .withColumn("date", F.to_date("datetime"))
    if by_symbol:
        laid, folders = out.repartition("symbol", "date").sortWithinPartitions("symbol", "date", "datetime"), ["symbol", "interval", "date"]
    else:
        laid, folders = out.repartitionByRange("date", "symbol").sortWithinPartitions("date", "symbol", "datetime"), ["interval", "date"]
    laid.write.mode("overwrite").partitionBy(*folders).parquet(path)
    return manifest(out)


def read_partitioned(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """What :func:`save_partitioned` wrote; folder names such as 1d are text, not numbers."""
    return spark.read.schema(f"{columns}, symbol string, interval string, date date").parquet(path)


def manifest(df: DataFrame) -> DataFrame:
    return df.groupBy("symbol", "interval").agg(F.min("datetime").alias("start_timestamp"), F.max("datetime").alias("end_timestamp"),
                                                F.count(F.lit(1)).alias("row_count"))


def write_bucketed(df: DataFrame, name: str, buckets: int) -> None:
    """Table bucketed and sorted by key: later windows and joins by instrument need no exchange."""
    df.write.mode("overwrite").bucketBy(buckets, "instrument").sortBy("instrument", "datetime").saveAsTable(name)


def replace_dates(new: DataFrame, path: str) -> None:
    """Overwrite only the date partitions that ``new`` touches."""
    new.withColumn("date", F.to_date("datetime")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy("date").parquet(path)


def read_series_files(spark: SparkSession, path: str, cal: DataFrame) -> DataFrame:
    """Binary series files (a start index, then little-endian float32 values) as panel rows.

    Files are named <field>.<freq>.bin inside a folder per instrument.  The
    decoding is a small Arrow step; the calendar is reached by index.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").option("recursiveFileLookup", True).load(path)

    def decode(batches):
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"]):
                values = np.frombuffer(content, dtype="<f4")
                if len(values) < 2:
                    continue
                parts = p.rstrip("/").split("/")
                body = values[1:].astype("float64")
                yield pd.DataFrame({"instrument": parts[-2].upper(), "field": parts[-1].split(".")[0],
                                    "idx": np.arange(len(body), dtype="int64") + int(values[0]),
                                    "value": [None if np.isnan(v) else float(v) for v in body]})

    rows = files.select("path", "content").mapInPandas(decode, "instrument string, field string, idx long, value double")
    return rows.join(cal, "idx").select("instrument", "datetime", "field", "value")
