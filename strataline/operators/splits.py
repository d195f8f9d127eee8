"""Walk-forward splits, ensembles and model jobs."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.functions import scalar as S
from strataline.operators.setops import concat_keep_newest
from strataline.operators.signals import ic_by_date


def calendar_list(cal: DataFrame) -> list:
    """The calendar as a driver list: one entry per date."""
    return [r[0] for r in cal.select("datetime").distinct().orderBy("datetime").collect()]


def align_segment(cal: list, seg: tuple) -> tuple[int, int]:
    """Calendar indexes of a segment: start rounds up, end rounds down; a missing end is the last date."""
    a = 0 if seg[0] is None else bisect_left(cal, seg[0])
    b = len(cal) - 1 if seg[1] is None else bisect_right(cal, seg[1]) - 1
    return a, b


def rolling_splits(cal: list, segments: dict[str, tuple], step: int, expanding: bool = True, trunc_days: int | None = None,
                   train: str = "train", test: str = "test") -> list[dict[str, tuple]]:
    """Rolling train/valid/test ranges.

    The first test range is ``step`` dates long; every following split moves
    all ranges by ``step`` (an expanding train keeps its start).  Test ranges
    end with the given test segment and the calendar.  ``trunc_days`` cuts the
    other ranges that many dates before the test start.
    """
    idx = {k: align_segment(cal, v) for k, v in segments.items()}
    last = idx[test][1]
    out, k = [], 0
    while True:
        cur = {}
        for name, (a, b) in idx.items():
            if name == test:
                a2 = a + k * step
                cur[name] = (a2, min(a2 + step - 1, last, len(cal) - 1))
            else:
                grow = k * step
                cur[name] = (a if (name == train and expanding) else a + grow, b + grow)
        if cur[test][0] > last or cur[test][0] >= len(cal):
            return out
        if trunc_days is not None:
            limit = cur[test][0] - trunc_days
            cur = {n: (v if n == test else (v[0], min(v[1], limit))) for n, v in cur.items()}
        out.append({n: (cal[v[0]], cal[max(v[0], min(v[1], len(cal) - 1))]) for n, v in cur.items()})
        k += 1


def horizon_variants(horizons: list[int], price: str = "close") -> dict[str, tuple]:
    """Label and needed truncation for each horizon: name -> (label expression, truncation days)."""
    from strataline.plans.featuresets import forward_label

    return {f"label_{h}": (forward_label(price, h), h + 1) for h in horizons}


def splits_table(spark: SparkSession, splits: list[dict[str, tuple]]) -> DataFrame:
    rows = [(i, n, a, b) for i, s in enumerate(splits) for n, (a, b) in s.items()]
    return spark.createDataFrame(rows, "split int, segment string, start timestamp_ntz, end timestamp_ntz")


def assign_splits(panel: DataFrame, splits: list[dict[str, tuple]]) -> DataFrame:
    """One row per (row, split, segment) holding it; ranges are literals, so nothing is joined."""
    hits = [F.when(F.col("datetime").between(F.lit(a), F.lit(b)), F.struct(F.lit(i).alias("split"), F.lit(n).alias("segment")))
            for i, s in enumerate(splits) for n, (a, b) in s.items()]
    return panel.withColumn("_s", F.explode(F.array_compact(F.array(*hits)))).select(*panel.columns, "_s.split", "_s.segment")


def rolling_ensemble(parts: list[DataFrame]) -> DataFrame:
    """Stack rolling predictions, newest model wins."""
    return concat_keep_newest(parts, ["instrument", "datetime"])


def average_ensemble(preds: DataFrame, model: str = "model", score: str = "score") -> DataFrame:
    """Per-date z-score of each model, then the mean over models."""
    st = preds.groupBy(model, "datetime").agg(F.avg(score).alias("_m"), F.stddev_samp(score).alias("_s"))
    z = preds.join(st, [model, "datetime"]).withColumn("_z", S.safe_div(F.col(score) - F.col("_m"), F.col("_s")))
    return z.groupBy("instrument", "datetime").agg(F.avg("_z").alias(score))


def reduce_groups(results: DataFrame, keys: list[str], value: str, how: str = "mean") -> DataFrame:
    """Results grouped by key and reduced."""
    fn = {"mean": F.avg, "sum": F.sum, "max": F.max, "min": F.min}[how]
    return results.groupBy(*keys).agg(fn(value).alias(value))


def _trainable(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Rows with a known label and no infinite value."""
    ok = F.col(label).isNotNull()
    for c in [*features, label]:
        ok = ok & ~S.is_inf(F.col(c))
    return df.where(ok)


def _assembled(df: DataFrame, features: list[str]):
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip").transform(df)


def fit_linear(df: DataFrame, features: list[str], label: str = "label", kind: str = "ols", alpha: float = 0.0, weight: str | None = None,
               strict: bool = False):
    """OLS, ridge or lasso on distributed rows; ``alpha`` has the usual least-squares meaning.

    Rows with an infinite value are left out.  ``strict``: they are not; squares with them have no least sum, so there is no model (None).
    """
    from pyspark.ml.regression import LinearRegression

    if strict:
        off = reduce(lambda a, b: a | b, [S.is_inf(F.col(c)) | F.isnan(c) for c in [*features, label]])
        if df.where(F.col(label).isNotNull() & off).limit(1).count():
            return None
    rows = _assembled(_trainable(df, features, label), features)
    reg, mix = 0.0, 0.0
    if kind == "ridge":
        # the library averages the loss and measures the L2 term on a standardised label
        n, spread = rows.agg(F.count(F.lit(1)), F.stddev_pop(label)).first()
        reg = alpha / max(n, 1) * (spread or 1.0)
    elif kind == "lasso":
        reg, mix = alpha, 1.0
    lr = LinearRegression(featuresCol="_x", labelCol=label, predictionCol="score", regParam=reg, elasticNetParam=mix, standardization=False)
    return (lr.setWeightCol(weight) if weight else lr).fit(rows)


def fit_boosted_trees(df: DataFrame, features: list[str], label: str = "label", rounds: int = 20, depth: int = 5, rate: float = 0.1, seed: int = 0):
    from pyspark.ml.regression import GBTRegressor

    gbt = GBTRegressor(featuresCol="_x", labelCol=label, predictionCol="score", maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed)
    return gbt.fit(_assembled(_trainable(df, features, label), features))


def predict(model, df: DataFrame, features: list[str]) -> DataFrame:
    """Adds ``score``; NaN without a model."""
    rows = _assembled(df, features)
    return (rows.withColumn("score", F.lit(float("nan"))) if model is None else model.transform(rows)).drop("_x")


def similarity_matrix(preds: DataFrame, segments: dict[str, tuple], fill: str = "max") -> DataFrame:
    """Rank IC of each training segment's model by date, overlap masked, row-centred, gaps filled with the row maximum or zero.

    ``preds``: (segment, instrument, datetime, score, label).
    """
    ic = ic_by_date(preds, ("segment", "datetime")).select("segment", "datetime", F.col("rank_ic").alias("v"))
    own = reduce(lambda a, b: a | b, [(F.col("segment") == n) & F.col("datetime").between(F.lit(a).cast("timestamp_ntz"), F.lit(b).cast("timestamp_ntz"))
                                      for n, (a, b) in segments.items()])
    masked = ic.withColumn("v", F.when(~own, F.col("v")))
    row = masked.groupBy("datetime").agg(F.avg("v").alias("_m"), *[F.max(F.when(F.col("segment") == n, F.col("v"))).alias(n) for n in segments])
    cols = [F.col(n) - F.col("_m") for n in segments]
    top = F.greatest(*cols) if len(cols) > 1 else cols[0]
    gap = top if fill == "max" else F.lit(0.0)
    return row.select("datetime", *[F.coalesce(c, gap, F.lit(0.0)).alias(n) for n, c in zip(segments, cols)])
