"""Incremental forms of the panel jobs as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strataline.functions.scalar import null_div
from strataline.plans import expr as E
from strataline.plans.evaluate import Panel, features
from strataline.sources.store import replace_dates


def stream_bars(ticks: DataFrame, freq: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling OHLCV bars per instrument; rows older than the watermark are dropped."""
    w = F.window("datetime", freq)
    return ticks.withWatermark("datetime", late).groupBy(w, "instrument").agg(
        F.min_by("value", "datetime").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
        F.max_by("value", "datetime").alias("close"), F.sum("value").alias("volume"), F.avg("value").alias("vwap")).select(
        "instrument", F.col("window.start").cast("timestamp_ntz").alias("datetime"), "open", "high", "low", "close", "volume", "vwap")


def stream_intensity(ticks: DataFrame, flag: str, span: str, step: str, late: str = "10 minutes") -> DataFrame:
    """Share of flagged rows over sliding windows."""
    w = F.window("datetime", span, step)
    return ticks.withWatermark("datetime", late).groupBy(w, "instrument").agg(
        null_div(F.sum(F.col(flag).cast("double")), F.count(F.lit(1)).cast("double")).alias("intensity")).select(
        "instrument", F.col("window.start").cast("timestamp_ntz").alias("datetime"), "intensity")


PIECE = 50_000     # rows that a group gives back at a time


def _carry(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    # of a trigger's rows only two arrays are kept, and the result is made in pieces
    parts = [(b["datetime"].to_numpy(), b["value"].to_numpy(float)) for b in batches]
    times, values = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    del parts
    order = np.argsort(times, kind="stable")
    last = state.get[0] if state.exists else None
    last = np.nan if last is None else last
    state.update((float(values[order[-1]]),))
    for lo in range(0, len(order), PIECE):
        at = order[lo:lo + PIECE]
        value = values[at]
        prev = np.concatenate([[last], value[:-1]])
        with np.errstate(all="ignore"):
            change = np.where(~np.isnan(prev) & (prev != 0), value / prev - 1, np.nan)
        last = value[-1]
        yield pd.DataFrame({"instrument": key[0], "datetime": times[at], "value": value, "previous": prev, "change": change})


def stream_changes(ticks: DataFrame) -> DataFrame:
    """Every tick with its instrument's previous value, which survives between batches as state.

    A group holds one trigger's ticks of one instrument; bound the trigger
    with the source's rate options.
    """
    return ticks.select("instrument", "datetime", "value").groupBy("instrument").applyInPandasWithState(
        _carry, "instrument string, datetime timestamp_ntz, value double, previous double, change double", "last double",
        "append", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> dict:
    """Process what is available into Parquet; returns counts of input and late rows."""
    q = (stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    late = sum(op.numRowsDroppedByWatermark for p in q.recentProgress for op in p.stateOperators)
    return {"rows": sum(p.numInputRows for p in q.recentProgress), "late": late}


def route_late(stream: DataFrame, path: str, checkpoint: str, late: str = "10 minutes"):
    """Each batch's rows to ``path``/on_time, or to ``path``/late where they are older than the newest row of all earlier
    batches less the allowance ``late``.

    Nothing is dropped.  A batch writes three folders of its own (its rows, its late rows, its newest time) and reads only the
    earlier batches' times, so a batch that is run again after a failure replaces what it wrote.
    """
    def apply(batch: DataFrame, number: int):
        spark = batch.sparkSession
        seen = spark.read.schema("newest timestamp, batch long").parquet(f"{path}/times") if number else None
        newest = seen.where(F.col("batch") < number).agg(F.max("newest")).first()[0] if number else None
        old = F.lit(False) if newest is None else F.coalesce(F.col("datetime") < F.lit(newest) - F.expr(f"INTERVAL {late}"), F.lit(False))
        batch = batch.persist()
        for part, rows in (("on_time", batch.where(~old)), ("late", batch.where(old)), ("times", batch.agg(F.max(F.col("datetime").cast("timestamp")).alias("newest")))):
            rows.write.mode("overwrite").parquet(f"{path}/{part}/batch={number}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def refresh_dates(bars: Panel, exprs: dict[str, E.Expr], changed: DataFrame, lookahead_days: int) -> DataFrame:
    """Feature rows of the dates that changed bars can influence, recomputed from full history.

    A changed bar reaches ``lookahead_days`` ahead; through accumulators (exponential means, fills, windows from the
    first row) it reaches every later date.
    """
    lo, hi = changed.agg(F.min("datetime"), F.max("datetime")).first()
    out = features(bars, exprs).where(F.col("datetime") >= F.date_trunc("day", F.lit(lo)))
    if any(e.unbounded for e in exprs.values()):
        return out
    return out.where(F.to_date("datetime") <= F.to_date(F.lit(hi) + F.expr(f"INTERVAL {lookahead_days} DAYS")))


def refresh_stream(changes: DataFrame, bars: Callable[[], Panel], exprs: dict[str, E.Expr], path: str, checkpoint: str, lookahead_days: int):
    """Each batch of late or new rows recomputes its dates and replaces only their partitions."""
    def apply(batch: DataFrame, _):
        if not batch.isEmpty():
            replace_dates(refresh_dates(bars(), exprs, batch, lookahead_days), path)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
