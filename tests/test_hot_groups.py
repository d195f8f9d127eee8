"""The skew-proof plans give the same rows as the ordinary ones."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strataline.operators import orderstats as OS
from strataline.operators import portfolio as PF
from strataline.operators import processors as P
from strataline.operators import quality as Q
from strataline.operators import sequence as SQ
from strataline.operators import signals as G
from strataline.plans.evaluate import Panel


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    parts = []
    for day, n in (("2024-01-01", 400), ("2024-01-02", 30), ("2024-01-03", 100)):
        parts.append(pd.DataFrame({"instrument": [f"s{i:03d}" for i in range(n)], "datetime": pd.Timestamp(day),
                                   "score": np.round(rng.normal(0, 1, n), 1), "label": rng.normal(0, 1, n)}))
    pdf = pd.concat(parts, ignore_index=True)
    pdf.loc[pdf.index % 17 == 0, "score"] = np.nan
    pdf.loc[pdf.index % 3 == 0, "score"] = 0.5  # one value holds a third of all rows
    df = spark.createDataFrame(pdf).withColumn("datetime", F.col("datetime").cast("timestamp_ntz"))
    return df.withColumn("score", F.when(~F.isnan("score"), F.col("score"))).cache()


def rows(df):
    return df.toPandas().sort_values(list(df.columns[:2])).reset_index(drop=True)[sorted(df.columns)]


def same(spark, make):
    spark.conf.unset("strataline.maxRowsPerTask")
    want = rows(make())
    spark.conf.set("strataline.maxRowsPerTask", "60")
    spark.conf.set("strataline.skewProof", "true")
    try:
        got = rows(make())
    finally:
        spark.conf.unset("strataline.maxRowsPerTask")
        spark.conf.unset("strataline.skewProof")
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-9)


CASES = {
    "average_rank": lambda d: OS.average_rank(d, ["datetime"], "score", "r"),
    "pct_rank": lambda d: OS.average_rank(d, ["datetime"], "score", "r", pct=True),
    "quantiles": lambda d: OS.group_quantiles(d, ["datetime"], "score", {"a": 0.1, "m": 0.5, "z": 0.97}),
    "place": lambda d: OS.ordered_place(d, ["datetime"], "score", ["instrument"], "p", "n", descending=True),
    "date_zscore": lambda d: P.DateZScore(["score", "label"]).transform(d),
    "date_robust": lambda d: P.DateZScore(["score", "label"], "robust").transform(d),
    "date_rank": lambda d: P.DateRank(["score", "label"]).transform(d),
    "date_fill": lambda d: P.DateFill(["score"]).transform(d),
    "robust_fit": lambda d: P.RobustZScore(["score", "label"]).fit(d).transform(d),
    "section": lambda d: P.SectionNorm(["KMID", "RSQR5"]).transform(d.withColumnsRenamed({"score": "KMID", "label": "RSQR5"})),
    "block_robust": lambda d: P.BlockNorm({"a": ["score", "label"]}, robust=True).fit(d).transform(d),
    "loss_weight": lambda d: P.weight_by_loss(d.where("score is not null"), ["score", "label"], "label", 1),
    "ic": lambda d: G.ic_by_date(d),
    "precision": lambda d: G.long_short_precision(d),
    "group_returns": lambda d: G.group_returns(d),
    "turnover": lambda d: G.turnover(d),
    "bins": lambda d: PF.bin_groups(d.select("instrument", "datetime", F.col("label").alias("value")), d, 4),
}


@pytest.mark.parametrize("name", CASES)
def test_hot_dates(spark, skewed, name):
    same(spark, lambda: CASES[name](skewed))


@pytest.fixture(scope="module")
def long_series(spark):
    rng = np.random.default_rng(5)
    n = 500
    pdf = pd.DataFrame({"instrument": "hot", "datetime": pd.date_range("2024-01-01", periods=n, freq="D"), "close": 100 + rng.normal(0, 1, n).cumsum() * 0.1,
                        "volume": rng.integers(0, 5, n).astype(float)})
    small = pdf.head(20).assign(instrument="cold")
    return spark.createDataFrame(pd.concat([pdf, small])).withColumn("datetime", F.col("datetime").cast("timestamp_ntz")).cache()


SERIES = {
    "change": lambda d: Q.with_change(Panel(d)),
    "repair": lambda d: Q.repair_units(Panel(d.withColumn("close", F.when(F.dayofmonth("datetime") == 3, F.col("close") * 100).otherwise(F.col("close"))))),
    "fill": lambda d: Q.fill_both_ways(Panel(d.withColumn("close", F.when(F.col("volume") > 2, F.col("close")))), ["close"]),
    "sequence": lambda d: SQ.sequences(d, ["close"], 4, fill="ffill").withColumn("sequence", F.col("sequence").cast("string")),
    "pnl": lambda d: PF.signal_pnl(d.withColumns({"signal": F.when(F.col("volume") > 2, "BUY").otherwise("SELL"), "position_size": F.lit(0.4)}), 1.0, 0.001),
    "risk": lambda d: PF.risk_analysis(d.withColumn("ret", (F.col("close") - 100) / 1000), freq="day"),
}


@pytest.mark.parametrize("name", SERIES)
def test_hot_instrument(spark, long_series, name):
    same(spark, lambda: SERIES[name](long_series))


def test_loss_weights_never_rank_in_one_task(spark, monkeypatch):
    """Ranks over all rows are made in value ranges, whether or not the session declares hot groups."""
    asked, rank = [], P.average_rank
    monkeypatch.setattr(P, "average_rank", lambda *a, hot=None, **k: (asked.append(hot), rank(*a, hot=hot, **k))[1])
    df = spark.createDataFrame([(str(i), float(i % 7), float(i % 5)) for i in range(40)], "instrument string, a double, b double")
    assert P.weight_by_loss(df, ["a", "b"], "b", 1).count() == 40
    assert len(asked) == 4 and all(asked)
