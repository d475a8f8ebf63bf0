"""Distribution functions in plain Python, and the same as batch functions on columns."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship


def gamma_q(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function: series below a + 1, continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - front * total)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or tiny)
        c = (b + an / c) or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_sf(x: float, df: int) -> float:
    """NaN without a degree of freedom."""
    return math.nan if df < 1 else 1.0 if x <= 0 else gamma_q(df / 2, x / 2)


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def normal_ppf(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def ks_two_sided(d: float, n: int, m: int) -> float:
    """The chance of a two-sample statistic of at least d, exactly: lattice paths that stay within it."""
    limit = d * n * m - 1e-9 * max(1.0, d * n * m)
    row = [1.0 if j * n < limit or limit <= 0 and j == 0 else 0.0 for j in range(m + 1)]
    row[0] = 1.0
    for j in range(1, m + 1):
        row[j] = row[j - 1] if abs(j * n) < limit else 0.0
    for i in range(1, n + 1):
        scale = i / (i + m)
        row[0] = row[0] * scale if abs(i * m) < limit else 0.0
        for j in range(1, m + 1):
            row[j] = row[j] * scale + row[j - 1] if abs(i * m - j * n) < limit else 0.0
    return min(1.0, max(0.0, 1 - row[m]))


def ks_asymptotic(x: float, tolerance: float = 1e-10) -> float:
    """P(K < x) of Kolmogorov's limit distribution."""
    if x <= 0:
        return 0.0
    if x < 1:
        z = -(math.pi**2) / (8 * x * x)
        return math.sqrt(2 * math.pi) / x * sum(math.exp((2 * k - 1) ** 2 * z) for k in range(1, 20))
    total, k = 1.0, 1
    while (term := 2 * (-1) ** k * math.exp(-2 * k * k * x * x)) and abs(term) > tolerance:
        total += term
        k += 1
    return total


def kendall(x: list[float], y: list[float]) -> tuple[float, float]:
    """Tau-b and its normal two-sided p-value."""
    n = len(x)
    s = tx = ty = 0
    for i in range(n):
        for j in range(i):
            a, b = (x[i] > x[j]) - (x[i] < x[j]), (y[i] > y[j]) - (y[i] < y[j])
            s += a * b
            tx += a == 0
            ty += b == 0
    pairs = n * (n - 1) / 2
    under = math.sqrt((pairs - tx) * (pairs - ty))
    tau = s / under if under else float("nan")
    z = 3 * tau * math.sqrt(n * (n - 1)) / math.sqrt(2 * (2 * n + 5)) if n > 1 else 0.0
    return tau, math.erfc(abs(z) / math.sqrt(2))


def chi2_pvalue(spark: SparkSession, x: Column | str, df: Column | str) -> Column:
    """χ² survival of a column, in Arrow batches; null stays null."""
    ship(spark)

    @F.pandas_udf("double")
    def sf(v: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) or pd.isna(b) else chi2_sf(float(a), int(b)) for a, b in zip(v, d)], dtype="float64")

    return sf(x, df)


def kolmogorov_one_sided(d: float, n: int) -> float:
    """The probability that the one-sided one-sample statistic stays below d."""
    if d <= 0 or d >= 1:
        return float(d >= 1)
    total = 0.0
    for j in range(math.floor(n * (1 - d)) + 1):
        choose = math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1)
        rest = 1 - d - j / n
        if rest > 0 or n == j:
            total += math.exp(choose + ((n - j) * math.log(rest) if n > j else 0.0) + (j - 1) * math.log(d + j / n))
    return 1 - d * total


def sphere_points(spark: SparkSession, n: int) -> DataFrame:
    """(k, x, y, z): n points spread evenly over the unit sphere along a golden spiral."""
    turn = F.col("k") * (math.pi * (3 - math.sqrt(5)))
    y = (F.col("k") * 2 + 1) / n - 1
    r = F.sqrt(1 - y * y)
    return spark.range(n).toDF("k").select("k", (F.cos(turn) * r).alias("x"), y.alias("y"), (F.sin(turn) * r).alias("z"))
