"""Algebra of gap maps and feature maps, as column expressions.

A gap map is array<struct<pos, length>>: runs of gaps before the places `pos` of the ungapped sequence, in order. A feature
map is array<struct<start, stop>>, half open and in order; what it doesn't cover is lost.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.moltype import let
from ..functions.sequence import running
from .intervals import spans_merged, spans_shadow

GAPS, SPANS = "array<struct<pos:int,length:int>>", "array<struct<start:bigint,stop:bigint>>"


def gaps_of_segments(segments: Column, aligned_length: Column) -> Column:
    """The gap map of a sequence whose ungapped stretches lie at these places of an alignment."""
    gaps = spans_shadow(segments, aligned_length)

    def mapped(g: Column) -> Column:
        before = running(F.transform(g, lambda x: (x["stop"] - x["start"]).cast("int")))
        return F.zip_with(g, before, lambda x, n: F.struct((x["start"] - n).cast("int").alias("pos"), (x["stop"] - x["start"]).cast("int").alias("length")))

    return let(gaps, mapped).cast(GAPS)


def gap_align_coordinates(gaps: Column) -> Column:
    """The gaps' spans in alignment coordinates."""
    before = running(F.transform(gaps, lambda g: g["length"]))
    return F.zip_with(gaps, before, lambda g, n: F.struct((g["pos"] + n).cast("long").alias("start"), (g["pos"] + n + g["length"]).cast("long").alias("stop"))).cast(SPANS)


def merged_gaps(a: Column, b: Column) -> Column:
    """The gaps of two maps of one sequence: lengths at the same place add up."""
    both = F.concat(a, b)
    places = F.array_sort(F.array_distinct(F.transform(both, lambda g: g["pos"])))
    length = lambda p: F.aggregate(F.filter(both, lambda g: g["pos"] == p), F.lit(0), lambda acc, g: acc + g["length"])
    return F.transform(places, lambda p: F.struct(p.alias("pos"), length(p).alias("length"))).cast(GAPS)


def shared_spans(a: Column, b: Column) -> Column:
    """What two maps have in common, in order: of gap spans, the gaps that two rows share."""
    pairs = F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.struct(F.greatest(x["start"], y["start"]).alias("start"), F.least(x["stop"], y["stop"]).alias("stop")))))
    return F.array_sort(F.filter(pairs, lambda s: s["stop"] > s["start"]))


def minus_spans(a: Column, b: Column, length: Column) -> Column:
    """What of `a` isn't in `b`; both within 0 … length."""
    return shared_spans(a, spans_shadow(b, length))


def align_to_gaps(spans: Column, gaps: Column) -> Column:
    """Gap spans in alignment coordinates of the map `gaps`, as a gap map of the sequence: what remains of its gaps."""
    def seq_place(at: Column) -> Column:
        before = F.transform(gap_align_coordinates(gaps), lambda g: F.greatest(F.least(g["stop"], at) - g["start"], F.lit(0).cast("long")))
        return at - F.aggregate(before, F.lit(0).cast("long"), lambda acc, x: acc + x)

    return F.transform(spans, lambda s: F.struct(seq_place(s["start"]).cast("int").alias("pos"), (s["stop"] - s["start"]).cast("int").alias("length"))).cast(GAPS)


def minus_gaps(gaps: Column, other: Column, length: Column) -> Column:
    """The map without the gaps that `other` (spans in alignment coordinates) covers."""
    return align_to_gaps(minus_spans(gap_align_coordinates(gaps), other, length), gaps)


def seq_feature_map(spans: Column, gaps: Column) -> Column:
    """Alignment spans as spans of the sequence: letters before their ends."""
    ends = lambda at: at - F.aggregate(F.transform(gap_align_coordinates(gaps), lambda g: F.greatest(F.least(g["stop"], at) - g["start"], F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda acc, x: acc + x)
    return F.transform(spans, lambda s: F.struct(ends(s["start"]).alias("start"), ends(s["stop"]).alias("stop")))


def joined_segments(seq: Column, segments: Column) -> Column:
    """The gapped row of some stretches of a gapped row, one after the other in their order of places."""
    return F.array_join(F.transform(F.array_sort(segments), lambda s: F.substring(seq, s["start"].cast("int") + 1, (s["stop"] - s["start"]).cast("int"))), "")


def inverse(spans: Column) -> Column:
    """For a map of places of a parent, which places of the map each stretch of the parent becomes: (start, stop) of the
    parent with (to_start, to_stop) of the map, by the parent's order. Spans that overlap have no inverse: null."""
    offsets = running(F.transform(spans, lambda s: (s["stop"] - s["start"]).cast("int")))
    rows = F.array_sort(F.zip_with(spans, offsets, lambda s, n: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), n.cast("long").alias("to_start"), (n + s["stop"] - s["start"]).cast("long").alias("to_stop"))))
    covered = F.aggregate(F.transform(spans_merged(spans), lambda s: s["stop"] - s["start"]), F.lit(0).cast("long"), lambda acc, x: acc + x)
    whole = F.aggregate(F.transform(spans, lambda s: s["stop"] - s["start"]), F.lit(0).cast("long"), lambda acc, x: acc + x)
    return F.when(covered == whole, rows)
