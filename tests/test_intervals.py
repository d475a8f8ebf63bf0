from itertools import product

from pyspark.sql import functions as F

from strandline.operators import features as X
from strandline.operators import intervals as I


def spans(spark, data, by="s"):
    return spark.createDataFrame([(by, a, b) for a, b in data], "seqid string, start long, stop long")


def got(df):
    return sorted((r.start, r.stop) for r in df.collect())


def test_merge_joins_touching_spans(spark):
    assert got(I.merge(spans(spark, [(1, 5), (3, 8), (8, 9), (12, 15)]), ["seqid"])) == [(1, 9), (12, 15)]


def test_interval_join_equals_brute_force(spark):
    a = [(i, i + j) for i, j in product(range(0, 40, 7), (1, 5, 23))]
    b = [(i, i + j) for i, j in product(range(3, 50, 11), (2, 9, 30))]
    out = I.interval_join(spans(spark, a), spans(spark, b), ["seqid"], width=6)
    found = sorted((r.start, r.stop, r.right_start, r.right_stop) for r in out.collect())
    assert found == sorted((*x, *y) for x in a for y in b if x[0] < y[1] and x[1] > y[0])


def test_minus_shortens(spark):
    assert got(I.minus(spans(spark, [(0, 10), (20, 22)]), spans(spark, [(2, 5), (19, 30)]), ["seqid"])) == [(0, 7)]


def test_gaps(spark):
    s = spans(spark, [(2, 5), (7, 9)]).withColumn("length", F.lit(12).cast("long"))
    assert got(I.gaps(s, ["seqid"], F.col("length"))) == [(0, 2), (5, 7), (9, 12)]


def test_merge_by_value(spark):
    df = spark.createDataFrame([(20, 21, 0), (21, 22, 1), (22, 23, 1), (23, 24, 0)], "start long, stop long, value int")
    assert sorted(map(tuple, I.merge_by_value(df).select("start", "stop", "value").collect())) == [(20, 21, 0), (21, 23, 1), (23, 24, 0)]
    same = df.withColumn("value", F.lit(0))
    assert [(r.start, r.stop) for r in I.merge_by_value(same).collect()] == [(20, 24)]


def test_independent_takes_the_longest_first(spark):
    assert got(I.independent(spans(spark, [(0, 10), (9, 12), (12, 13), (1, 2)]), ["seqid"])) == [(0, 10), (12, 13)]


def test_span_arrays(spark):
    df = spark.sql("SELECT array(named_struct('start', 5L, 'stop', 8L), named_struct('start', 1L, 'stop', 3L), named_struct('start', 3L, 'stop', 4L)) AS s, 'ACGTACGTAC' AS seq")
    r = df.select(I.spans_merged(F.col("s")).alias("m"), I.spans_shadow(F.col("s"), F.lit(10)).alias("h"), I.spans_reversed(F.col("s"), F.lit(10)).alias("r"), I.spans_slice(F.col("seq"), F.array_sort("s")).alias("t")).first()
    assert [tuple(x) for x in r.m] == [(1, 4), (5, 8)]
    assert [tuple(x) for x in r.h] == [(0, 1), (4, 5), (8, 10)]
    assert [tuple(x) for x in r.r] == [(2, 5), (6, 7), (7, 9)]
    assert r.t == "CGTCGT"


def store(spark):
    s = spark.createDataFrame([], X.SCHEMA)
    s = X.add_feature(s, seqid="s1", biotype="gene", name="g1", spans=[(2, 8)], strand="+")
    s = X.add_feature(s, seqid="s1", biotype="CDS", name="c1", spans=[(6, 8), (2, 4)], parent_id="g1", strand="-")
    return X.add_feature(s, seqid="s2", biotype="gene", name="g10", spans=[(0, 3)], parent_id="g1, g2")


def test_feature_store(spark):
    s = store(spark)
    names = lambda df: sorted(r.name for r in df.collect())
    assert names(X.matching(s, biotype="GENE%")) == ["g1", "g10"]
    assert names(X.matching(s, start=1, stop=8)) == ["c1", "g1"]
    assert names(X.matching(s, start=7, stop=20)) == []
    assert names(X.matching(s, start=7, stop=20, allow_partial=True)) == ["c1", "g1"]
    assert names(X.matching(s, start=3)) == ["c1", "g1"]
    assert names(X.children(s, s.filter("name = 'g1'"))) == ["c1", "g10"]
    assert [r.name for r in X.parents(s, s.filter("name = 'c1'")).collect()] == ["g1"]
    assert {(r.kind, r.key): r["count"] for r in X.describe(s).collect()}[("total", None)] == 3
    assert X.num_matches(s, seqid=["s1"]).first().n == 2
    assert sorted((r.name, r.right_name) for r in X.contained(s).collect()) == [("c1", "g1"), ("g1", "c1")]


def test_bound_features(spark):
    seqs = spark.createDataFrame([("s1", "AACCGGTTAA"), ("s2", "ACGT")], "name string, seq string")
    out = {r.feature: r["slice"] for r in X.get_slice(X.features_of(seqs, store(spark))).collect()}
    assert out == {"g1": "CCGGTT", "c1": "AAGG", "g10": "ACG"}
    masked = {r.name: r.seq for r in X.masked(seqs, store(spark).filter("biotype = 'CDS'")).collect()}
    assert masked == {"s1": "AA??GG??AA", "s2": "ACGT"}
    found = X.annotate_matches(seqs, "GG|CG", "motif", "m")
    assert sorted((r.seqid, r.start, r.stop) for r in found.collect()) == [("s1", 3, 5), ("s1", 4, 6), ("s2", 1, 3)] or sorted((r.seqid, r.start, r.stop) for r in found.collect()) == [("s1", 3, 5), ("s2", 1, 3)]
