"""Ordered work without a window over all rows: rows are dealt to ranges of the ordering column, and what a range needs of
those before it comes from one row a range."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a range, about, and ranges at most.
PER_PART, MOST = 65_536, 256


def with_range(df: DataFrame, order: str, per_part: int = PER_PART) -> DataFrame:
    """`df` with __range, 0 and up in the order of a numeric column: between its quantiles; nulls come first."""
    parts = min(df.count() // per_part + 1, MOST)
    found = df.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], 10_000)).first()[0] if parts > 1 else []
    bounds = sorted(set(found or []))

    def range_of(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high + 1) // 2
        return F.when(F.col(order) >= F.lit(bounds[middle - 1]), range_of(middle, high)).otherwise(range_of(low, middle - 1))

    return df.withColumn("__range", range_of(0, len(bounds)))


def totals_before(df: DataFrame, order: str, sums: dict[str, str], per_part: int = PER_PART) -> DataFrame:
    """`df`, whose values of `order` are distinct, with for each entry of `sums` (new column: column) the sum over all rows before."""
    rows = with_range(df, order, per_part)
    held = rows.groupBy("__range").agg(*[F.sum(c).alias(f"__t{i}") for i, c in enumerate(sums.values())])
    earlier = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)  # MOST rows at most
    offsets = held.select("__range", *[F.coalesce(F.sum(f"__t{i}").over(earlier), F.lit(0)).alias(f"__o{i}") for i in range(len(sums))])
    w = W.partitionBy("__range").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    made = {to: F.coalesce(F.sum(c).over(w), F.lit(0)) + F.col(f"__o{i}") for i, (to, c) in enumerate(sums.items())}
    return rows.join(F.broadcast(offsets), "__range").withColumns(made).drop("__range", *[f"__o{i}" for i in range(len(sums))])


def max_before(rows: DataFrame, by: Sequence[str], value: str, to: str) -> DataFrame:
    """`rows`, which have __range, with the largest `value` of the group's earlier ranges; null in its first."""
    held = rows.groupBy(*by, "__range").agg(F.max(value).alias("__m"))
    earlier = W.partitionBy(*by).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)  # a group has MOST rows at most
    offsets = held.select(*[F.col(b).alias(f"__k{i}") for i, b in enumerate(by)], F.col("__range").alias("__r"), F.max("__m").over(earlier).alias(to))
    same = F.col("__range") == F.col("__r")
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"__k{i}"))
    return rows.join(offsets, same).drop("__r", *[f"__k{i}" for i in range(len(by))])
