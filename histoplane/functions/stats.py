"""Statistics on aggregated rows: tails of the t, hypergeometric and normal distributions, and step-up adjustment."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            total *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * total


@F.pandas_udf(T.DoubleType())
def student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided tail of Student's t."""
    return pd.Series([None if pd.isna(a) or pd.isna(n) else incomplete_beta(n / 2, 0.5, n / (n + a * a)) for a, n in zip(t, df)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    """Two-sided tail of the normal distribution."""
    return pd.Series([None if pd.isna(x) else math.erfc(abs(x) / math.sqrt(2)) for x in z], dtype="float64")


@F.pandas_udf(T.DoubleType())
def hypergeometric_p(k: pd.Series, size: pd.Series, query: pd.Series, universe: pd.Series) -> pd.Series:
    """Probability of an overlap of at least k."""

    def log_choose(n, r):
        return math.lgamma(n + 1) - math.lgamma(r + 1) - math.lgamma(n - r + 1)

    def tail(k, s, q, g):
        return min(1.0, math.fsum(math.exp(log_choose(s, j) + log_choose(g - s, q - j) - log_choose(g, q)) for j in range(max(k, q + s - g), min(s, q) + 1)))

    return pd.Series([tail(*map(int, x)) for x in zip(k, size, query, universe)], dtype="float64")


def benjamini_hochberg(df: DataFrame, p: str, by: list[str], tie: list[str], out: str) -> DataFrame:
    """Adds ``out``: p adjusted within the groups ``by``; null p-values stay null and don't count."""
    known = F.col(p).isNotNull()
    up = Window.partitionBy(*by, known).orderBy(p, *tie)
    down = Window.partitionBy(*by, known).orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = df.withColumn("_rank", F.row_number().over(up)).withColumn("_m", F.count(p).over(Window.partitionBy(*by)))
    return ranked.withColumn(out, F.when(known, F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_rank")).over(down)))).drop("_rank", "_m")


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
