"""Interval operators: overlap joins by bins, merging, runs, complements and coordinate maps. Spans are half open."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranges import PER_PART, max_before, with_range

from ..session import ship


def overlaps(a_start: Column, a_stop: Column, b_start: Column, b_stop: Column) -> Column:
    """Overlap as the feature store has it: an empty span counts where it touches the other's ends."""
    proper = (a_start < b_stop) & (a_stop > b_start)
    empty = (a_start == a_stop) & (a_start >= b_start) & (a_stop <= b_stop)
    return proper | empty


def bin_width(df: DataFrame, start: str = "start", stop: str = "stop", q: float = 0.9) -> int:
    """A width that most spans fit in, from one approximate quantile."""
    found = df.agg(F.percentile_approx(F.col(stop) - F.col(start), q, F.lit(1000))).first()[0]
    return max(1, int(found or 1))


def interval_join(a: DataFrame, b: DataFrame, by: Sequence[str] = (), width: int | None = None, prefix: str = "right_") -> DataFrame:
    """Pairs of overlapping spans, columns start and stop on both sides; equality of `by` columns too.

    Each span goes to the bins it touches and pairs meet by bin, so the join is a hash or merge join; a pair that
    shares several bins counts in the first one only. Empty spans touch the bin they lie in.
    """
    width = width or bin_width(a.select("start", "stop").unionByName(b.select("start", "stop")))
    bins = lambda s, e: F.sequence(F.floor(s / width), F.floor(F.greatest(s, e - 1) / width))
    left = a.withColumn("__bin", F.explode(bins(F.col("start"), F.col("stop"))))
    right = b.toDF(*[prefix + c for c in b.columns])
    s, e = F.col(prefix + "start"), F.col(prefix + "stop")
    right = right.withColumn("__rbin", F.explode(bins(s, e)))
    on = F.col("__bin") == F.col("__rbin")
    for k in by:
        on = on & left[k].eqNullSafe(right[prefix + k])
    pairs = left.join(right, on).filter((F.col("start") < e) & (F.col("stop") > s))
    first = F.floor(F.greatest(F.col("start"), s) / width)
    return pairs.filter(F.col("__bin") == first).drop("__bin", "__rbin")


def intersect(a: DataFrame, b: DataFrame, by: Sequence[str] = (), width: int | None = None) -> DataFrame:
    """What overlapping pairs share: (by…, start, stop)."""
    pairs = interval_join(a.select(*by, "start", "stop"), b.select(*by, "start", "stop"), by, width)
    return pairs.select(*by, F.greatest("start", "right_start").alias("start"), F.least("stop", "right_stop").alias("stop"))


def minus(a: DataFrame, b: DataFrame, by: Sequence[str] = (), width: int | None = None) -> DataFrame:
    """Each span of `a` shortened at its end by the total of its overlaps with `b`; none of it left: gone."""
    rows = a.select(*by, "start", "stop").withColumn("__row", F.monotonically_increasing_id())
    shared = interval_join(rows, b.select(*by, "start", "stop"), by, width)
    lost = shared.groupBy("__row").agg(F.sum(F.least("stop", "right_stop") - F.greatest("start", "right_start")).alias("__lost"))
    cut = rows.join(lost, "__row", "left").withColumn("stop", F.col("stop") - F.coalesce("__lost", F.lit(0)))
    return cut.filter("stop > start").select(*by, "start", "stop")


def merge(df: DataFrame, by: Sequence[str] = (), start: str = "start", stop: str = "stop", per_part: int = PER_PART) -> DataFrame:
    """Overlapping and touching spans as one: a new one opens only beyond the furthest stop so far.

    A group's spans are merged within ranges of `start`, and the first and last of each range stitched, so no task holds a
    large group.
    """
    rows = max_before(with_range(df, start, per_part), by, stop, "__earlier")
    order = W.partitionBy(*by, "__range").orderBy(start, stop)
    before = F.greatest(F.max(stop).over(order.rowsBetween(W.unboundedPreceding, -1)), F.col("__earlier"))
    opened = rows.withColumn("__new", F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0))
    island = opened.withColumn("__island", F.sum("__new").over(order.rowsBetween(W.unboundedPreceding, 0)))  # 0: goes on from an earlier range
    parts = island.groupBy(*by, "__range", "__island").agg(F.min(start).alias(start), F.max(stop).alias(stop))
    last = F.max("__island").over(W.partitionBy(*by, "__range"))
    parts = parts.withColumn("__ends", (F.col("__island") == last) | (F.col("__island") == 0))
    chain = parts.filter("__ends").withColumn("__chain", F.sum((F.col("__island") > 0).cast("int")).over(W.partitionBy(*by).orderBy("__range", "__island")))  # two rows a range
    joined = chain.groupBy(*by, "__chain").agg(F.min(start).alias(start), F.max(stop).alias(stop))
    names = [*by, start, stop]
    return joined.select(names).unionByName(parts.filter("NOT __ends").select(names))


def gaps(df: DataFrame, by: Sequence[str] = (), length: Column | None = None, per_part: int = PER_PART) -> DataFrame:
    """What the spans leave free, from 0 to `length` (a constant within each group) or to the last stop."""
    merged = max_before(with_range(merge(df, by, per_part=per_part), "start", per_part), by, "stop", "__earlier")
    order = W.partitionBy(*by, "__range").orderBy("start")
    inner = merged.select(*by, F.coalesce(F.lag("stop").over(order), F.col("__earlier"), F.lit(0)).alias("start"), F.col("start").alias("stop"))
    if length is not None:
        ends = df.groupBy(*by).agg(F.max("stop").alias("start"), F.max(length).alias("stop"))
        inner = inner.unionByName(ends)
    return inner.filter("stop > start")


def run_starts(df: DataFrame, order: str, value: str, by: Sequence[str] = (), digits: int | None = None) -> DataFrame:
    """Rows at which the (rounded) value differs from the one before."""
    v = F.round(value, digits) if digits is not None else F.col(value)
    w = W.partitionBy(*by).orderBy(order)
    rows = df.withColumn("__v", v).withColumn("__before", F.lag("__v").over(w)).withColumn("__first", F.row_number().over(w) == 1)
    return rows.filter(F.col("__first") | ~F.col("__v").eqNullSafe(F.col("__before"))).drop("__v", "__before", "__first")


def merge_by_value(df: DataFrame, value: str = "value", by: Sequence[str] = (), digits: int | None = None) -> DataFrame:
    """Neighbouring spans with one (rounded) value as one."""
    v = F.round(value, digits) if digits is not None else F.col(value)
    w = W.partitionBy(*by).orderBy("start", "stop")
    rows = df.withColumn("__v", v).withColumn("__new", F.when(F.col("__v").eqNullSafe(F.lag("__v").over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1))
    rows = rows.withColumn("__run", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy(*by, "__run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min_by(value, "start").alias(value)).drop("__run")


def true_spans(df: DataFrame, pos: str, flag: str, by: Sequence[str] = ()) -> DataFrame:
    """Runs of true flags as (by…, start, length)."""
    w = W.partitionBy(*by).orderBy(pos)
    held = df.filter(F.col(flag)).withColumn("__island", F.col(pos) - F.row_number().over(w))
    return held.groupBy(*by, "__island").agg(F.min(pos).alias("start"), F.count(F.lit(1)).alias("length")).drop("__island")


def independent(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """A set of spans that don't overlap, taken longest first, ties by start: greedy within a group, which one task holds."""
    ship(df.sparkSession)

    def pick(g: pd.DataFrame) -> pd.DataFrame:
        g = g.assign(__n=g["stop"] - g["start"]).sort_values(["__n", "start"], ascending=[False, True], kind="stable").drop(columns="__n")
        starts: list[int] = []
        stops: list[int] = []
        kept = []
        for i, (s, e) in enumerate(zip(g["start"], g["stop"])):
            at = bisect_left(starts, s)
            if (at == 0 or stops[at - 1] <= s) and (at == len(starts) or starts[at] >= e):
                starts.insert(at, s)
                stops.insert(at, e)
                kept.append(i)
        return g.iloc[kept]

    return df.groupBy(*by).applyInPandas(pick, df.schema)


# arrays of spans
def spans_covering(spans: Column) -> Column:
    return F.struct(F.array_min(F.transform(spans, lambda s: s["start"])).alias("start"), F.array_max(F.transform(spans, lambda s: s["stop"])).alias("stop"))


def spans_merged(spans: Column) -> Column:
    """An array of spans, overlapping and touching ones as one, in order."""
    kind = "array<struct<start:bigint,stop:bigint>>"
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].cast("long").alias("start"), s["stop"].cast("long").alias("stop"))))

    def step(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        grown = F.struct(last["start"].alias("start"), F.greatest(last["stop"], s["stop"]).alias("stop"))
        rest = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(last["stop"] >= s["start"], F.array_append(rest, grown)).otherwise(F.array_append(acc, s))

    return F.aggregate(ordered, F.array().cast(kind), step)


def spans_shadow(spans: Column, length: Column) -> Column:
    """What the spans leave free of 0 … length."""
    merged = spans_merged(spans)
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(merged, lambda s: s["stop"]))
    stops = F.concat(F.transform(merged, lambda s: s["start"]), F.array(length.cast("long")))
    return F.filter(F.zip_with(starts, stops, lambda a, b: F.struct(a.alias("start"), b.alias("stop"))), lambda s: s["stop"] > s["start"])


def spans_reversed(spans: Column, length: Column) -> Column:
    """The spans as seen from the other strand, in order."""
    return F.array_sort(F.transform(spans, lambda s: F.struct((length - s["stop"]).alias("start"), (length - s["start"]).alias("stop"))))


def spans_length(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda acc, s: acc + s["stop"] - s["start"])


def spans_scaled(spans: Column, factor: int) -> Column:
    return F.transform(spans, lambda s: F.struct((s["start"] * factor).alias("start"), (s["stop"] * factor).alias("stop")))


def spans_zeroed(spans: Column) -> Column:
    low = F.array_min(F.transform(spans, lambda s: s["start"]))
    return F.transform(spans, lambda s: F.struct((s["start"] - low).alias("start"), (s["stop"] - low).alias("stop")))


def spans_clipped(spans: Column, start: Column, stop: Column) -> Column:
    """The spans inside a view, relative to its start; those outside are lost."""
    inside = F.transform(spans, lambda s: F.struct((F.greatest(s["start"], start) - start).alias("start"), (F.least(s["stop"], stop) - start).alias("stop")))
    return F.filter(inside, lambda s: s["stop"] > s["start"])


def spans_slice(seq: Column, spans: Column) -> Column:
    """The spans' text, joined."""
    return F.array_join(F.transform(spans, lambda s: F.substring(seq, s["start"].cast("int") + 1, (s["stop"] - s["start"]).cast("int"))), "")


def absolute_position(rel: Column, start: Column, step: Column, offset: Column) -> Column:
    return offset + start + rel * step


def relative_position(abs_pos: Column, start: Column, step: Column, offset: Column) -> Column:
    return F.floor((abs_pos - offset - start) / step)


def strand(value: Column) -> Column:
    """-1, 0 or 1 for -, nothing and +."""
    text = F.lower(value.cast("string"))
    return F.when(text.isin("-", "-1"), -1).when(text.isin("+", "1"), 1).otherwise(0)
