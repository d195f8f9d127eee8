"""Evaluation of predictions against labels, per date and summarised."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.functions import scalar as S
from strataline.operators.calendars import calendar_of
from strataline.operators.orderstats import average_rank, ordered_place, places
from strataline.operators.setops import quantile_members
from strataline.plans import expr as E
from strataline.plans.evaluate import Panel, with_columns
from strataline.plans.sizing import skew_proof


def join_label(pred: DataFrame, label: DataFrame, how: str = "inner") -> DataFrame:
    """Scores with their future returns on the common key; a key that is NULL meets itself, as any other."""
    keys = ["instrument", "datetime"]
    other = label.select(*[F.col(c).alias(f"__{c}" if c in keys else c) for c in label.columns])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys])
    both = pred.join(other, same, how)
    return both.select(*[F.coalesce(c, f"__{c}").alias(c) for c in keys], *[c for c in both.columns if c not in (*keys, "__instrument", "__datetime")])


def ic_by_date(df: DataFrame, by: tuple[str, ...] = ("datetime",), score: str = "score", label: str = "label") -> DataFrame:
    """Pearson and Spearman correlation of the pairs where both sides exist."""
    pairs = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    keys = list(by)
    hot = skew_proof(pairs)
    ranked = average_rank(average_rank(pairs, keys, score, "_rs", hot=hot), keys, label, "_rl", hot=hot)
    return ranked.groupBy(*keys).agg(S.pair_corr(F.col(score), F.col(label)).alias("ic"), S.pair_corr(F.col("_rs"), F.col("_rl")).alias("rank_ic"))


def ic_summary(ic: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean IC, ICIR and their rank forms."""
    def ratio(c):
        return S.null_div(F.avg(c), F.stddev_samp(c))
    return ic.groupBy(*by).agg(F.avg("ic").alias("ic"), ratio("ic").alias("icir"), F.avg("rank_ic").alias("rank_ic"), ratio("rank_ic").alias("rank_icir"))


def _sides(df, q, score):
    return {side: quantile_members(df, score, q, top) for side, top in (("long", True), ("short", False))}


def long_short_precision(df: DataFrame, q: float = 0.2, demean: bool = False, score: str = "score", label: str = "label") -> DataFrame:
    """Share of positive labels in the top quantile and of negative labels in the bottom one."""
    if demean:
        means = df.groupBy("datetime").agg(F.avg(label).alias("_m"))
        df = df.join(means, "datetime").withColumn(label, F.col(label) - F.col("_m")).drop("_m")
    s = _sides(df, q, score)
    hit = {"long": F.col(label) > 0, "short": F.col(label) < 0}
    parts = [v.groupBy("datetime").agg(F.avg(hit[k].cast("double")).alias(k)) for k, v in s.items()]
    return parts[0].join(parts[1], "datetime", "full")


def long_short_return(df: DataFrame, q: float = 0.2, score: str = "score", label: str = "label") -> DataFrame:
    """(mean top label - mean bottom label) / 2 and the date's average label."""
    s = _sides(df, q, score)
    parts = [v.groupBy("datetime").agg(F.avg(label).alias(k)) for k, v in s.items()]
    avg = df.groupBy("datetime").agg(F.avg(label).alias("average"))
    j = avg.join(parts[0], "datetime", "left").join(parts[1], "datetime", "left")
    return j.select("datetime", ((F.col("long") - F.col("short")) / 2).alias("long_short"), "average")


def annualised(df: DataFrame, columns: list[str], scale: float = 252.0) -> DataFrame:
    """Annual return and information ratio of per-date returns."""
    aggs = []
    for c in columns:
        aggs += [(F.avg(c) * scale).alias(f"{c}_ann"), S.null_div(F.avg(c) * F.sqrt(F.lit(scale)), F.stddev_samp(c)).alias(f"{c}_ir")]
    return df.agg(*aggs)


def signal_report(df: DataFrame, q: float = 0.2) -> DataFrame:
    """One row: IC, ICIR, rank forms, mean long and short precision, long-short and average returns.

    Everything comes from one ranked panel: each date is aggregated once, each part of the report over its own rows.
    """
    x = df.select("instrument", "datetime", "score", "label", F.when(F.col("label").isNotNull(), F.col("score")).alias("_s"),
                  F.when(F.col("score").isNotNull(), F.col("label")).alias("_l"))
    x = average_rank(average_rank(x, ["datetime"], "_s", "_rs"), ["datetime"], "_l", "_rl")
    x = places(x, ["datetime"], {"_hi": ("score", True), "_lo": ("score", False)}, ["instrument"], total=("_n", "score"))
    label, k = F.col("label"), F.floor(F.col("_n") * F.lit(q))
    long, short = F.col("_hi") <= k, F.col("_lo") <= k
    by = x.groupBy("datetime").agg(
        S.pair_corr(F.col("_s"), F.col("_l")).alias("ic"), S.pair_corr(F.col("_rs"), F.col("_rl")).alias("rank_ic"),
        F.avg(F.when(long, (label > 0).cast("double"))).alias("_lp"), F.avg(F.when(short, (label < 0).cast("double"))).alias("_sp"),
        ((F.avg(F.when(long, label)) - F.avg(F.when(short, label))) / 2).alias("_ls"), F.avg(label).alias("_avg"))
    ratio = lambda c: S.null_div(F.avg(c), F.stddev_samp(c))
    return by.agg(F.avg("ic").alias("ic"), ratio("ic").alias("icir"), F.avg("rank_ic").alias("rank_ic"), ratio("rank_ic").alias("rank_icir"),
                  F.avg("_lp").alias("long_precision"), F.avg("_sp").alias("short_precision"), F.avg("_ls").alias("long_short_return"), F.avg("_avg").alias("average_return"))


def prediction_autocorr(df: DataFrame, lag: int = 1, score: str = "score") -> DataFrame:
    """Correlation of each date's cross-section with that of ``lag`` dates earlier."""
    cal = calendar_of(df)
    x = df.join(cal, "datetime").select("instrument", "datetime", "idx", F.col(score).alias("_a"))
    y = x.select("instrument", (F.col("idx") + lag).alias("idx"), F.col("_a").alias("_b"))
    return x.join(y, ["instrument", "idx"], "left").groupBy("datetime").agg(S.pair_corr(F.col("_a"), F.col("_b")).alias("autocorr"))


def rank_autocorr(df: DataFrame, lag: int = 1, score: str = "score") -> DataFrame:
    """Correlation of each date's score ranks with the ranks, on the same date, of the scores ``lag`` rows earlier."""
    both = with_columns(Panel(df.select("instrument", "datetime", score)), {"_prev": E.ref(E.field(score), lag)})
    ranked = average_rank(average_rank(both, ["datetime"], score, "_r", pct=True), ["datetime"], "_prev", "_last", pct=True)
    return ranked.groupBy("datetime").agg(S.pair_corr(F.col("_r"), F.col("_last")).alias("autocorr"))


def group_returns(df: DataFrame, groups: int = 5, score: str = "score", label: str = "label") -> DataFrame:
    """Mean label of equal score groups per date (group 1 highest), long-short and long-average; remainder rows are left out."""
    placed = ordered_place(df, ["datetime"], score, ["instrument"], "_p", "_n", descending=True)
    size = F.floor(F.col("_n") / groups)
    g = F.when(size > 0, F.floor((F.col("_p") - 1) / size) + 1)
    tagged = placed.withColumn("_g", g)
    wide = tagged.groupBy("datetime").agg(
        *[F.avg(F.when(F.col("_g") == i, F.col(label))).alias(f"group{i}") for i in range(1, groups + 1)], F.avg(label).alias("average"))
    return wide.withColumns({"long_short": F.col("group1") - F.col(f"group{groups}"), "long_average": F.col("group1") - F.col("average")})


def cumulative(df: DataFrame, columns: list[str]) -> DataFrame:
    """Running sums over dates of per-date columns."""
    one = df.withColumn("instrument", F.lit("all"))
    return with_columns(Panel(one), {f"cum_{c}": E.sum_(E.field(c), 0) for c in columns}).drop("instrument")


def turnover(df: DataFrame, groups: int = 5, lag: int = 1, score: str = "score") -> DataFrame:
    """1 - share of the top (bottom) group that was also top (bottom) by the lagged score; all four orders in one exchange."""
    last = with_columns(Panel(df.select("instrument", "datetime", score)), {"_last": E.ref(E.field(score), lag)}).withColumn("_one", F.lit(1))
    specs = {f"{side}_{c}": (c, side == "top") for side in ("top", "bottom") for c in (score, "_last")}
    x = places(last, ["datetime"], specs, ["instrument"], total=("_n", "_one")).withColumn("_k", F.floor(F.col("_n") / groups))

    def gone(side):
        kept = F.count_if((F.col(f"{side}_{score}") <= F.col("_k")) & (F.col(f"{side}__last") <= F.col("_k")))
        return S.null_div(F.first("_k") - kept, F.first("_k").cast("double")).alias(side)
    return x.groupBy("datetime").agg(gone("top"), gone("bottom"))


def monthly_ic(ic: DataFrame) -> DataFrame:
    """Mean IC per month; months without any date between the first and the last are rows with a missing value."""
    m = ic.groupBy(F.date_trunc("month", "datetime").cast("timestamp_ntz").alias("month")).agg(F.avg("ic").alias("ic"))
    span = m.agg(F.min("month").alias("a"), F.max("month").alias("b"))
    grid = span.select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 MONTH"))).alias("month"))
    return grid.join(m, "month", "left")


def threshold_signals(df: DataFrame, buy: float, sell: float, low: float, high: float, score: str = "score") -> DataFrame:
    """BUY above, SELL below (strict), size = score clipped to [low, high]."""
    s = F.col(score)
    sig = F.when(s > buy, "BUY").when(s < sell, "SELL").otherwise("HOLD")
    return df.withColumns({"signal": sig, "position_size": S.clip(s, low, high)})


def scaled_signals(df: DataFrame, buy: float, sell: float, max_position: float, score: str = "score") -> DataFrame:
    """BUY and SELL at the thresholds included, size = position between them times the maximum."""
    s = F.col(score)
    sig = F.when(s >= buy, "BUY").when(s <= sell, "SELL").otherwise("HOLD")
    return df.withColumns({"signal": sig, "position_size": S.clip((s - sell) / (buy - sell), 0, 1) * max_position})


def feature_stats(df: DataFrame, column: str) -> DataFrame:
    """Per date: distinct and missing counts and shares, infinities, mean, std, skewness, kurtosis."""
    x = F.col(column)
    finite = F.when(~S.is_inf(x), x)
    n = F.count(F.lit(1))
    return df.groupBy("datetime").agg(
        F.count_distinct(x).alias("n_distinct"), (F.count_distinct(x) / n).alias("distinct_ratio"),
        F.count_if(S.is_inf(x)).alias("n_inf"), F.count_if(x.isNull()).alias("n_missing"), (F.count_if(x.isNull()) / n).alias("missing_ratio"),
        F.avg(finite).alias("mean"), F.stddev_samp(finite).alias("std"), S.sample_skew(F.skewness(finite), F.count(finite)).alias("skew"),
        S.sample_kurt(F.kurtosis(finite), F.count(finite)).alias("kurt"))


def feature_autocorr(df: DataFrame, columns: list[str], lag: int = 1) -> DataFrame:
    """Per date and feature: correlation, over the instruments, of its values with those ``lag`` rows earlier; infinities left out."""
    finite = df.select("instrument", "datetime", *[F.when(~S.is_inf(F.col(c)), F.col(c)).alias(c) for c in columns])
    both = with_columns(Panel(finite), {f"_p{i}": E.ref(E.field(c), lag) for i, c in enumerate(columns)})
    wide = both.groupBy("datetime").agg(*[S.pair_corr(F.col(c), F.col(f"_p{i}")).alias(f"_c{i}") for i, c in enumerate(columns)])
    return wide.select("datetime", F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_c{i}").alias("autocorr")) for i, c in enumerate(columns)])))
