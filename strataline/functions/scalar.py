"""Null-safe scalar building blocks on plain Columns.

Missing values are NULL everywhere in this package: NaN is turned into NULL at
the scan and after every function that can produce it; +/-infinity is a value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def nan_to_null(c: Column) -> Column:
    return F.nanvl(c, F.lit(None).cast("double"))


def ieee_div(a: Column, b: Column) -> Column:
    """IEEE division, 0/0 is NaN; never raises under ANSI mode."""
    return F.coalesce(F.try_divide(a, b), F.when(b == 0, F.signum(a) * F.lit(INF)))


def safe_div(a: Column, b: Column) -> Column:
    """IEEE division with 0/0 as NULL."""
    return nan_to_null(ieee_div(a, b))


def null_div(a: Column, b: Column) -> Column:
    """Division that is NULL whenever the denominator is zero."""
    return F.try_divide(a, b)


def pair_corr(a: Column, b: Column) -> Column:
    """Aggregate correlation of complete pairs; NULL for flat or single pairs, where the built-in one raises."""
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return nan_to_null(F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(x)) * F.sqrt(F.var_pop(y))))


def safe_log(x: Column) -> Column:
    return F.when(x > 0, F.log(x)).when(x == 0, F.lit(-INF))


def safe_pow(a: Column, b: Column) -> Column:
    return nan_to_null(F.pow(a, b))


def both_max(a: Column, b: Column) -> Column:
    """Larger of two values, NULL when either is NULL."""
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def both_min(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def is_inf(x: Column) -> Column:
    return F.coalesce(F.abs(x) == F.lit(INF), F.lit(False))


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.when(x < lo, F.lit(float(lo))).when(x > hi, F.lit(float(hi))).otherwise(x)


def sample_skew(pop_skew: Column, n: Column) -> Column:
    """Bias-corrected skewness from the population form."""
    n = n.cast("double")
    return F.when(n >= 3, nan_to_null(pop_skew) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurt(pop_excess: Column, n: Column) -> Column:
    """Bias-corrected excess kurtosis from the population form."""
    n = n.cast("double")
    return F.when(
        n >= 4,
        ((n + 1) * nan_to_null(pop_excess) + 6) * (n - 1) / ((n - 2) * (n - 3)),
    )


def sorted_quantile(arr: Column, q: float) -> Column:
    """Linear-interpolation quantile of an ascending, NULL-free array column."""
    n = F.size(arr)
    at = (n - 1) * F.lit(float(q))
    lo = F.floor(at).cast("int")
    low = F.get(arr, lo)
    high = F.get(arr, F.least(lo + 1, n - 1))
    return F.when(n > 0, low + (high - low) * (at - lo))
