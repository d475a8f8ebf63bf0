"""A feature store as a DataFrame: records, matching, hierarchy, counts, and features bound to sequences."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.moltype import DNA
from ..session import ship
from .intervals import interval_join, overlaps, spans_clipped, spans_covering, spans_merged, spans_shadow, spans_slice, strand

_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])
SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("seqid", "source", "biotype", "name", "parent_id")]
    + [T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("strand", T.ByteType()), T.StructField("spans", T.ArrayType(_SPAN))]
    + [T.StructField("attributes", T.StringType()), T.StructField("on_alignment", T.BooleanType())]
)


def feature_rows(df: DataFrame) -> DataFrame:
    """Any table of features in the store's schema: spans sorted, start and stop from them, missing columns null."""
    have = set(df.columns)
    spans = F.array_sort(F.col("spans")) if "spans" in have else F.array(F.struct(F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop")))
    rows = df.withColumn("spans", spans.cast(SCHEMA["spans"].dataType))
    cover = spans_covering(F.col("spans"))
    rows = rows.withColumns({"start": cover["start"], "stop": cover["stop"], "strand": strand(F.col("strand")).cast("tinyint") if "strand" in have else F.lit(0).cast("tinyint")})
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMA])


def add_feature(store: DataFrame, **record) -> DataFrame:
    """The store with one more record; spans as pairs."""
    spans = sorted((int(a), int(b)) for a, b in record.pop("spans"))
    row = {f.name: record.get(f.name) for f in SCHEMA} | {"spans": spans, "start": spans[0][0], "stop": max(b for _, b in spans)}
    row["strand"] = {"+": 1, "1": 1, "-": -1, "-1": -1}.get(str(record.get("strand")), 0)
    return store.unionByName(store.sparkSession.createDataFrame([tuple(row[f.name] for f in SCHEMA)], SCHEMA))


def _matches(name: str, value) -> Column:
    c = F.col(name)
    if value is None:
        return F.lit(True)
    if isinstance(value, list | tuple | set):
        return c.isin(*value)
    if isinstance(value, str) and "%" in value:
        return c.ilike(value)
    return c == value


def matching(
    store: DataFrame,
    seqid=None,
    biotype=None,
    name=None,
    start: int | None = None,
    stop: int | None = None,
    strand: int | None = None,
    attributes: str | None = None,
    on_alignment: bool | None = None,
    allow_partial: bool = False,
) -> DataFrame:
    """Records that meet all conditions; `%` in a text matches as LIKE, without regard to case.

    With both ends of a range: features inside it, or with `allow_partial` those that overlap it. With one end: features
    that the point lies in.
    """
    keep = _matches("seqid", seqid) & _matches("biotype", biotype) & _matches("name", name)
    if attributes is not None:
        keep = keep & F.col("attributes").ilike(attributes if "%" in attributes else f"%{attributes}%")
    if strand is not None:
        keep = keep & (F.col("strand") == strand)
    if on_alignment is not None:
        keep = keep & (F.coalesce("on_alignment", F.lit(False)) == on_alignment)
    if start is not None and stop is not None:
        inside = (F.col("start") >= start) & (F.col("stop") <= stop)
        keep = keep & (overlaps(F.col("start"), F.col("stop"), F.lit(start), F.lit(stop)) if allow_partial else inside)
    elif start is not None or stop is not None:
        point = start if start is not None else stop
        keep = keep & (F.col("start") <= point) & (F.col("stop") > point)
    return store.filter(keep)


def num_matches(store: DataFrame, **conditions) -> DataFrame:
    return matching(store, **conditions).agg(F.count(F.lit(1)).alias("n"))


def subset(store: DataFrame, **conditions) -> DataFrame:
    return matching(store, **conditions)


def update(store: DataFrame, other: DataFrame, seqids: Sequence[str] | None = None) -> DataFrame:
    return store.unionByName(other if seqids is None else other.filter(F.col("seqid").isin(*seqids)), allowMissingColumns=True)


def compatible(a: DataFrame, b: DataFrame, symmetric: bool = True) -> bool:
    x, y = ({(f.name, f.dataType.simpleString()) for f in s.schema} for s in (a, b))
    return x == y if symmetric else y <= x


# counts
def count_distinct(store: DataFrame, by: Sequence[str], **conditions) -> DataFrame:
    return matching(store, **conditions).groupBy(*by).agg(F.count(F.lit(1)).alias("count"))


def biotype_counts(store: DataFrame) -> DataFrame:
    return store.filter("biotype IS NOT NULL AND biotype <> ''").groupBy("biotype").agg(F.count(F.lit(1)).alias("count"))


def describe(store: DataFrame) -> DataFrame:
    """(kind, key, count): by seqid, by biotype and in total, in one pass over grouping sets."""
    view = store.select("seqid", "biotype")
    kind = F.when(F.grouping_id("seqid", "biotype") == 1, "seqid").when(F.grouping_id("seqid", "biotype") == 2, "biotype").otherwise("total")
    sets = view.groupingSets([["seqid"], ["biotype"], []], "seqid", "biotype")
    return sets.agg(F.count(F.lit(1)).alias("count"), kind.alias("kind")).select("kind", F.coalesce("seqid", "biotype").alias("key"), "count")


# hierarchy
def children(store: DataFrame, of: DataFrame, substring: bool = False) -> DataFrame:
    """Records whose parent is one of `of` (column name). Parents are looked up as whole ids; `substring` finds names
    inside the parent text instead, which a nested-loop join must do, so `of` is meant to be a few rows then."""
    names = of.select(F.col("name").alias("__name")).filter("__name IS NOT NULL").distinct()
    if substring:
        return store.join(names, F.lower("parent_id").contains(F.lower("__name")), "inner").withColumnRenamed("__name", "parent")
    split = store.withColumn("parent", F.explode(F.split(F.regexp_replace("parent_id", " ", ""), ",")))
    return split.join(names, F.col("parent") == F.col("__name")).drop("__name")


def parents(store: DataFrame, of: DataFrame) -> DataFrame:
    """Of each record of `of` its parents: (child, …record); of records with one name the first by position."""
    wanted = of.select(F.col("name").alias("child"), F.explode(F.split(F.regexp_replace("parent_id", " ", ""), ",")).alias("__parent"))
    found = wanted.join(store, F.col("__parent") == store["name"])
    cols = [c for c in store.columns]
    first = F.min_by(F.struct(*cols), F.struct("start", "stop")).alias("r")
    return found.groupBy("child", "__parent").agg(first).select("child", "r.*")


def contained(store: DataFrame, by: Sequence[str] = ("seqid",), exclude_same: bool = True, width: int | None = None) -> DataFrame:
    """Pairs of records of one group where the right lies in the left (children by position); equal biotypes left out."""
    pairs = interval_join(store, store, by, width)
    inside = (F.col("right_start") >= F.col("start")) & (F.col("right_stop") <= F.col("stop"))
    return pairs.filter(inside & (F.col("biotype") != F.col("right_biotype")) if exclude_same else inside)


# bound to sequences
def features_of(seqs: DataFrame, store: DataFrame, allow_partial: bool = False) -> DataFrame:
    """Features of sequence views: `seqs` has name, seq, and optionally view_start; coordinates become the view's own."""
    rows = seqs if "view_start" in seqs.columns else seqs.withColumn("view_start", F.lit(0).cast("long"))
    rows = rows.withColumn("view_stop", F.col("view_start") + F.length("seq"))
    pairs = store.withColumnRenamed("name", "feature").join(rows, F.col("seqid") == rows["name"])
    within = (F.col("start") >= F.col("view_start")) & (F.col("stop") <= F.col("view_stop"))
    partial = (F.col("start") < F.col("view_stop")) & (F.col("stop") > F.col("view_start"))
    kept = pairs.filter(partial if allow_partial else within)
    return kept.withColumn("spans", spans_clipped(F.col("spans"), F.col("view_start"), F.col("view_stop")))


def get_slice(bound: DataFrame, complete: bool = False) -> DataFrame:
    """features_of() with `slice`: the spans' text joined (`complete`: the covering span), reverse complement on strand -1."""
    cover = spans_covering(F.col("spans"))
    spans = F.array(cover) if complete else F.col("spans")
    text = spans_slice(F.col("seq"), spans)
    return bound.withColumn("slice", F.when(F.col("strand") < 0, DNA.rc(text)).otherwise(text))


def as_one_span(store: DataFrame) -> DataFrame:
    return store.withColumn("spans", F.array(spans_covering(F.col("spans"))))


def shadow(store: DataFrame, length: Column) -> DataFrame:
    return store.withColumn("spans", spans_shadow(F.col("spans"), length))


def union_spans(store: DataFrame, by: Sequence[str]) -> DataFrame:
    """The features of each group as one set of merged spans. Groups are features of one thing, so few."""
    return store.groupBy(*by).agg(spans_merged(F.flatten(F.collect_list("spans"))).alias("spans"))


def is_annotated(seqs: DataFrame, store: DataFrame) -> DataFrame:
    return seqs.join(store, seqs["name"] == store["seqid"], "left_semi")


def masked(seqs: DataFrame, store: DataFrame, mask: str = "?", inverse: bool = False) -> DataFrame:
    """Sequences with the spans of their features (or with `inverse` all else) replaced by the mask, length kept."""
    spans = store.groupBy("seqid").agg(spans_merged(F.flatten(F.collect_list("spans"))).alias("__spans"))
    rows = seqs.join(spans, seqs["name"] == spans["seqid"], "left").drop("seqid")
    held = F.coalesce("__spans", F.array().cast("array<struct<start:bigint,stop:bigint>>"))
    held = spans_shadow(held, F.length("seq")) if inverse else held
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        stop = F.least(s["stop"], F.length("seq").cast("long"))
        plain = F.substring("seq", acc["at"].cast("int") + 1, (F.least(s["start"], F.length("seq").cast("long")) - acc["at"]).cast("int"))
        return F.struct(stop.alias("at"), F.concat(acc["out"], plain, F.repeat(F.lit(mask), (stop - s["start"]).cast("int"))).alias("out"))

    text = F.aggregate(held, start, step, lambda acc: F.concat(acc["out"], F.substring("seq", acc["at"].cast("int") + 1, F.length("seq"))))
    return rows.withColumn("seq", text).drop("__spans")


def annotate_matches(seqs: DataFrame, pattern: str, biotype: str, name: str, allow_multiple: bool = True) -> DataFrame:
    """Matches of a regular expression in sequences (name, seq) as features; offsets come from an Arrow batch function."""
    ship(seqs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rx = regex.compile(pattern)
        for f in frames:
            out = []
            for seqid, seq in zip(f["name"], f["seq"]):
                found = list(rx.finditer(seq or ""))
                out += [(seqid, biotype, name, m.start(), m.end()) for m in (found if allow_multiple else found[:1])]
            yield pd.DataFrame(out, columns=["seqid", "biotype", "name", "start", "stop"])

    return feature_rows(seqs.select("name", "seq").mapInPandas(run, "seqid string, biotype string, name string, start long, stop long"))


def projected(store: DataFrame, aln: DataFrame, target: str) -> DataFrame:
    """Features of aligned sequences (name, seq) in the coordinates of another row: sequence to column to sequence."""
    from ..functions.sequence import align_index, seq_index

    rows = aln.select(F.col("name").alias("__name"), F.col("seq").alias("__seq"))
    to = aln.filter(F.col("name") == target).select(F.col("seq").alias("__target"))
    both = store.join(rows, F.col("seqid") == F.col("__name")).crossJoin(F.broadcast(to.limit(1)))
    first = align_index("__seq", F.col("start").cast("int"))
    last = align_index("__seq", F.col("stop").cast("int") - 1)
    out = both.withColumns({"start": seq_index("__target", first).cast("long"), "stop": seq_index("__target", last + 1).cast("long")})
    spans = F.array(F.struct("start", "stop"))
    return out.withColumns({"seqid": F.lit(target), "spans": spans}).drop("__name", "__seq", "__target")


def write(store: DataFrame, path: str) -> None:
    """By sequence, sorted by start within files, so that ranges prune by file statistics."""
    store.repartitionByRange("seqid", "start").sortWithinPartitions("seqid", "start").write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def update_record_spans(store: DataFrame, changes: DataFrame) -> DataFrame:
    """The store with new spans for records named in `changes` (name, spans); start and stop follow them."""
    new = changes.select(F.col("name").alias("__n"), F.array_sort(F.col("spans").cast(SCHEMA["spans"].dataType)).alias("__s"))
    rows = store.join(new, F.col("name") == F.col("__n"), "left")
    cover = spans_covering(F.col("__s"))
    return rows.withColumns({"spans": F.coalesce("__s", "spans"), "start": F.coalesce(cover["start"], "start"), "stop": F.coalesce(cover["stop"], "stop")}).drop("__n", "__s")


def to_json(store: DataFrame) -> DataFrame:
    """One JSON text a record (value), for from_json of the same schema."""
    return store.select(F.to_json(F.struct(*[f.name for f in SCHEMA])).alias("value"))


def from_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.from_json("value", SCHEMA).alias("r")).select("r.*")
