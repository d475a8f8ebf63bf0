"""Feature and interval operators over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features as X
from ..operators import intervals as I
from ..session import table
from .registry import register
from .views import SPAN_SQL, spans

LOW, HIGH = 1704067200, 1706745600


def store(spark: SparkSession, d: str) -> DataFrame:
    return X.feature_rows(spans(spark, d).drop("value"))


@register("features_within", f"WITH {SPAN_SQL}, b AS (SELECT min(start) + 100000 AS lo, min(start) + 900000 AS hi FROM f) SELECT seqid, biotype, name, start, stop FROM f, b WHERE start >= lo AND stop <= hi")
def features_within(spark: SparkSession, d: str) -> DataFrame:
    s = store(spark, d)
    lo = s.agg(F.min("start")).first()[0]
    return X.matching(s, start=lo + 100000, stop=lo + 900000).select("seqid", "biotype", "name", "start", "stop")


@register("features_overlapping", f"WITH {SPAN_SQL}, b AS (SELECT min(start) + 100000 AS lo, min(start) + 900000 AS hi FROM f) SELECT seqid, biotype, name, start, stop FROM f, b WHERE start < hi AND stop > lo AND biotype LIKE 'C%' OR start < hi AND stop > lo AND biotype LIKE 'c%'")
def features_overlapping(spark: SparkSession, d: str) -> DataFrame:
    s = store(spark, d)
    lo = s.agg(F.min("start")).first()[0]
    return X.matching(s, biotype="C%", start=lo + 100000, stop=lo + 900000, allow_partial=True).select("seqid", "biotype", "name", "start", "stop")


@register("features_at_point", f"WITH {SPAN_SQL}, b AS (SELECT min(start) + 500000 AS p FROM f) SELECT seqid, name, start, stop FROM f, b WHERE start <= p AND stop > p")
def features_at_point(spark: SparkSession, d: str) -> DataFrame:
    s = store(spark, d)
    return X.matching(s, start=s.agg(F.min("start")).first()[0] + 500000).select("seqid", "name", "start", "stop")


@register("features_num_matches", f"WITH {SPAN_SQL} SELECT count(*) AS n FROM f WHERE seqid IN ('1', '2', '3')")
def features_num_matches(spark: SparkSession, d: str) -> DataFrame:
    return X.num_matches(store(spark, d), seqid=["1", "2", "3"])


@register("features_biotype_counts", f"WITH {SPAN_SQL} SELECT biotype, count(*) AS count FROM f WHERE biotype <> '' GROUP BY ALL")
def features_biotype_counts(spark: SparkSession, d: str) -> DataFrame:
    return X.biotype_counts(store(spark, d))


@register("features_count_distinct", f"WITH {SPAN_SQL} SELECT seqid, biotype, count(*) AS count FROM f GROUP BY ALL")
def features_count_distinct(spark: SparkSession, d: str) -> DataFrame:
    return X.count_distinct(store(spark, d), ["seqid", "biotype"])


@register("features_describe", f"WITH {SPAN_SQL} SELECT 'seqid' AS kind, seqid AS key, count(*) AS count FROM f GROUP BY ALL UNION ALL SELECT 'biotype', biotype, count(*) FROM f GROUP BY ALL UNION ALL SELECT 'total', NULL, count(*) FROM f")
def features_describe(spark: SparkSession, d: str) -> DataFrame:
    return X.describe(store(spark, d))


@register("features_children", "SELECT l_orderkey || '.' || l_linenumber AS name, o_orderkey::VARCHAR AS parent FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority LIKE '1%'")
def features_children(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.concat_ws(".", "l_orderkey", "l_linenumber").alias("name"), F.col("l_orderkey").cast("string").alias("parent_id"))
    of = table(spark, d, "orders").filter(F.col("o_orderpriority").startswith("1")).select(F.col("o_orderkey").cast("string").alias("name"))
    return X.children(lines, of).select("name", "parent")


@register("features_contained", f"WITH {SPAN_SQL} SELECT a.name, b.name AS right_name FROM f a JOIN f b ON a.seqid = b.seqid AND b.start >= a.start AND b.stop <= a.stop AND a.biotype <> b.biotype")
def features_contained(spark: SparkSession, d: str) -> DataFrame:
    return X.contained(store(spark, d)).select("name", "right_name")


@register("features_subset_update", f"WITH {SPAN_SQL} SELECT name, seqid FROM f WHERE biotype = 'click' UNION ALL SELECT name, seqid FROM f WHERE seqid IN ('5', '6')")
def features_subset_update(spark: SparkSession, d: str) -> DataFrame:
    s = store(spark, d)
    return X.update(X.subset(s, biotype="click"), s, ["5", "6"]).select("name", "seqid")


MERGE_SQL = """m AS (SELECT seqid, start, stop, max(stop) OVER (PARTITION BY seqid ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM f),
i AS (SELECT seqid, start, stop, sum(CASE WHEN before IS NULL OR start > before THEN 1 ELSE 0 END) OVER (PARTITION BY seqid ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM m),
g AS (SELECT seqid, min(start) AS start, max(stop) AS stop FROM i GROUP BY seqid, island)"""


@register("intervals_merge", f"WITH {SPAN_SQL}, {MERGE_SQL} SELECT * FROM g")
def intervals_merge(spark: SparkSession, d: str) -> DataFrame:
    return I.merge(spans(spark, d).select("seqid", "start", "stop"), ["seqid"])


@register("intervals_gaps", f"WITH {SPAN_SQL}, {MERGE_SQL}, h AS (SELECT seqid, coalesce(lag(stop) OVER (PARTITION BY seqid ORDER BY start), 0) AS start, start AS stop FROM g) SELECT * FROM h WHERE stop > start")
def intervals_gaps(spark: SparkSession, d: str) -> DataFrame:
    return I.gaps(spans(spark, d).select("seqid", "start", "stop"), ["seqid"])


@register("intervals_intersect", f"WITH {SPAN_SQL} SELECT a.seqid, greatest(a.start, b.start) AS start, least(a.stop, b.stop) AS stop FROM f a JOIN f b ON a.seqid = b.seqid AND a.biotype = 'click' AND b.biotype = 'view' AND a.start < b.stop AND a.stop > b.start")
def intervals_intersect(spark: SparkSession, d: str) -> DataFrame:
    s = spans(spark, d)
    return I.intersect(s.filter("biotype = 'click'"), s.filter("biotype = 'view'"), ["seqid"])


@register("intervals_minus", f"""WITH {SPAN_SQL}, a AS (SELECT * FROM f WHERE biotype = 'click'), b AS (SELECT * FROM f WHERE biotype = 'view'),
l AS (SELECT a.name, sum(least(a.stop, b.stop) - greatest(a.start, b.start)) AS lost FROM a JOIN b ON a.seqid = b.seqid AND a.start < b.stop AND a.stop > b.start GROUP BY a.name)
SELECT seqid, start, (stop - coalesce(lost, 0))::BIGINT AS stop FROM a LEFT JOIN l USING (name) WHERE stop - coalesce(lost, 0) > start""")
def intervals_minus(spark: SparkSession, d: str) -> DataFrame:
    s = spans(spark, d)
    return I.minus(s.filter("biotype = 'click'"), s.filter("biotype = 'view'"), ["seqid"])


@register("intervals_run_starts", f"WITH {SPAN_SQL}, r AS (SELECT *, round(value, 0) AS v FROM f), w AS (SELECT *, lag(v) OVER x AS before, row_number() OVER x AS rn FROM r WINDOW x AS (PARTITION BY seqid ORDER BY start, name)) SELECT seqid, name FROM w WHERE rn = 1 OR v IS DISTINCT FROM before")
def intervals_run_starts(spark: SparkSession, d: str) -> DataFrame:
    s = spans(spark, d).withColumn("at", F.struct("start", "name"))
    return I.run_starts(s, "at", "value", ["seqid"], digits=0).select("seqid", "name")


@register("intervals_merge_by_value", """WITH o AS (SELECT l_orderkey, l_linenumber AS start, l_linenumber + 1 AS stop, max(l_returnflag) AS value FROM lineitem GROUP BY ALL),
n AS (SELECT *, CASE WHEN lag(value) OVER w IS NOT DISTINCT FROM value AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS fresh FROM o WINDOW w AS (PARTITION BY l_orderkey ORDER BY start, stop)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY l_orderkey ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS run FROM n)
SELECT l_orderkey, min(start) AS start, max(stop) AS stop, arg_min(value, start) AS value FROM r GROUP BY l_orderkey, run""")
def intervals_merge_by_value(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("value"))
    rows = lines.select("l_orderkey", F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + 1).alias("stop"), "value")
    return I.merge_by_value(rows, "value", ["l_orderkey"])


@register("intervals_independent")
def intervals_independent(spark: SparkSession, d: str) -> DataFrame:
    return I.independent(spans(spark, d).select("seqid", "name", "start", "stop"), ["seqid"])


@register("intervals_true_spans", f"WITH {SPAN_SQL}, p AS (SELECT seqid, row_number() OVER (PARTITION BY seqid ORDER BY start, name) AS pos, value > 50 AS hot FROM f), h AS (SELECT seqid, pos, pos - row_number() OVER (PARTITION BY seqid ORDER BY pos) AS island FROM p WHERE hot) SELECT seqid, min(pos) AS start, count(*) AS length FROM h GROUP BY seqid, island")
def intervals_true_spans(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    rows = spans(spark, d).withColumn("pos", F.row_number().over(W.partitionBy("seqid").orderBy("start", "name")).cast("long")).withColumn("hot", F.col("value") > 50)
    return I.true_spans(rows, "pos", "hot", ["seqid"])


@register("features_union_spans", f"WITH {SPAN_SQL}, {MERGE_SQL} SELECT seqid, count(*)::INTEGER AS n_spans, sum(stop - start)::BIGINT AS covered FROM g GROUP BY seqid")
def features_union_spans(spark: SparkSession, d: str) -> DataFrame:
    u = X.union_spans(store(spark, d), ["seqid"])
    return u.select("seqid", F.size("spans").alias("n_spans"), I.spans_length(F.col("spans")).alias("covered"))
