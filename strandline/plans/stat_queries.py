"""Tests, resampling, trees, models, apps and formats over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators import distance as D
from ..operators import models, tree
from ..operators import stats as T
from ..operators import table as O
from ..session import table
from ..sources import formats
from . import apps
from .registry import register
from .views import DNA_SQL, SPAN_SQL, alignment, dna, spans, vectors

_N = "n AS (SELECT l_returnflag AS row, l_linenumber AS col, count(*) AS n FROM lineitem GROUP BY ALL), e AS (SELECT *, sum(n) OVER (PARTITION BY row) * sum(n) OVER (PARTITION BY col) / sum(n) OVER () AS e FROM n)"


def crossed(spark: SparkSession, d: str) -> DataFrame:
    return O.category_counts(table(spark, d, "lineitem"), ["l_returnflag", "l_linenumber"]).toDF("row", "col", "n")


@register("stat_expected", f"WITH {_N} SELECT row, col, n, round(e, 6) AS expected FROM e")
def stat_expected(spark: SparkSession, d: str) -> DataFrame:
    return T.expected(crossed(spark, d)).withColumn("expected", F.round("expected", 6))


@register("stat_residuals", f"WITH {_N} SELECT row, col, round((n - e) / sqrt(e), 6) AS residual FROM e")
def stat_residuals(spark: SparkSession, d: str) -> DataFrame:
    return T.residuals(crossed(spark, d)).select("row", "col", F.round("residual", 6).alias("residual"))


@register("stat_chisq", f"WITH {_N} SELECT round(sum((n - e) ** 2 / e), 5) AS chisq, (count(DISTINCT row) - 1) * (count(DISTINCT col) - 1) AS df FROM e")
def stat_chisq(spark: SparkSession, d: str) -> DataFrame:
    return T.chisq_test(crossed(spark, d), pvalue=False).withColumn("chisq", F.round("chisq", 5))


@register("stat_chisq_pvalue", f"""WITH {_N}, c AS (SELECT sum((n - e) ** 2 / e) AS x, ((count(DISTINCT row) - 1) * (count(DISTINCT col) - 1))::BIGINT AS df FROM e)
SELECT round(x, 5) AS chisq, df, round(CASE df WHEN 1 THEN NULL ELSE exp(-x / 2) * list_sum(list_transform(range(df // 2), lambda k: (x / 2) ** k / gamma(k + 1))) END, 8) AS pvalue FROM c""")
def stat_chisq_pvalue(spark: SparkSession, d: str) -> DataFrame:
    """The tail has a closed form where the degrees of freedom are even, as here."""
    return T.chisq_test(crossed(spark, d)).select(F.round("chisq", 5).alias("chisq"), "df", F.round("pvalue", 8).alias("pvalue"))


@register("stat_g_independence", f"""WITH {_N}, q AS (SELECT (SELECT sum(1 / r) FROM (SELECT sum(n) AS r FROM n GROUP BY row)) AS ir, (SELECT sum(1 / c) FROM (SELECT sum(n) AS c FROM n GROUP BY col)) AS ic, (SELECT sum(n) FROM n) AS t),
g AS (SELECT 2 * sum(n * ln(n / e)) AS g, (count(DISTINCT row) - 1) * (count(DISTINCT col) - 1) AS df FROM e)
SELECT round(g / (1 + (t * ir - 1) * (t * ic - 1) / (6 * t * df)), 5) AS G, df FROM g, q""")
def stat_g_independence(spark: SparkSession, d: str) -> DataFrame:
    return T.g_independence(crossed(spark, d), pvalue=False).withColumn("G", F.round("G", 5))


@register("stat_g_fit", "WITH n AS (SELECT event_type, count(*) AS n FROM events GROUP BY ALL), e AS (SELECT *, avg(n) OVER () AS e FROM n) SELECT round(2 * sum(n * ln(n / e)) / (1 + (count(*) ** 2 - 1) / (6 * sum(n) * (count(*) - 1))), 5) AS G, count(*) - 1 AS df FROM e")
def stat_g_fit(spark: SparkSession, d: str) -> DataFrame:
    counts = O.category_counts(table(spark, d, "events"), "event_type")
    return T.g_fit(counts, pvalue=False).withColumn("G", F.round("G", 5))


@register("stat_permutation_pvalue")
def stat_permutation_pvalue(spark: SparkSession, d: str) -> DataFrame:
    return T.permutation_pvalue(O.category_counts(table(spark, d, "labels"), ["quality", "toxic"]).toDF("row", "col", "n"), 200)


@register("stat_jackknife_mean", "SELECT event_type, round(avg(value), 6) AS mean, round(avg(value), 6) AS pseudo_mean, round(stddev_samp(value) / sqrt(count(value)), 6) AS se FROM events GROUP BY ALL")
def stat_jackknife_mean(spark: SparkSession, d: str) -> DataFrame:
    out = T.jackknife_mean(table(spark, d, "events"), "value", ["event_type"])
    return out.select("event_type", *[F.round(c, 6).alias(c) for c in ("mean", "pseudo_mean", "se")])


@register("stat_ks", """WITH t AS (SELECT value, count(*) FILTER (event_type = 'click') AS a, count(*) FILTER (event_type = 'view') AS b FROM events WHERE event_type IN ('click', 'view') GROUP BY value),
s AS (SELECT sum(a) OVER (ORDER BY value) / sum(a) OVER () AS x, sum(b) OVER (ORDER BY value) / sum(b) OVER () AS y FROM t) SELECT round(max(abs(x - y)), 8) AS d FROM s""")
def stat_ks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").filter("event_type IN ('click', 'view')").withColumn("s", F.col("event_type") == "click")
    return T.ks_statistic(rows, "value", "s").select(F.round("d", 8).alias("d"))


@register("stat_mann_whitney", """WITH t AS (SELECT value, count(*) FILTER (event_type = 'click') AS a, count(*) FILTER (event_type = 'view') AS b FROM events WHERE event_type IN ('click', 'view') GROUP BY value),
s AS (SELECT a, b, coalesce(sum(b) OVER (ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM t) SELECT sum(a * (below + b / 2))::DOUBLE AS u, sum(a)::BIGINT AS n, sum(b)::BIGINT AS m FROM s""")
def stat_mann_whitney(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").filter("event_type IN ('click', 'view')").withColumn("s", F.col("event_type") == "click")
    return T.mann_whitney(rows, "value", "s").select("u", "n", "m")


@register("stat_kendall")
def stat_kendall(spark: SparkSession, d: str) -> DataFrame:
    return T.kendall_tau(table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.avg("c_acctbal").alias("x"), F.count(F.lit(1)).cast("double").alias("y")), "x", "y", ["c_nationkey"])


_SIG = "s AS (SELECT vec_id AS name, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"


@register("period_auto_corr", f"WITH {_SIG} SELECT name, list_transform(range(2, 9), lambda k: round(list_sum(list_transform(range(1, 65 - k), lambda i: v[i] * v[i + k])) / 64, 6) + 0.0) AS a FROM s")
def period_auto_corr(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("name"), F.col("embedding").cast("array<double>").alias("v"))
    return rows.select("name", F.transform(T.auto_corr(F.col("v"), 2, 8), lambda x: F.round(x, 6) + 0.0).alias("a"))  # no minus before a zero


@register("period_ipdft", f"WITH {_SIG} SELECT name, list_transform(range(2, 9), lambda p: round(sqrt(list_sum(list_transform(range(64), lambda i: v[i + 1] * cos(i * 2 * pi() / p))) ** 2 + list_sum(list_transform(range(64), lambda i: v[i + 1] * sin(i * 2 * pi() / p))) ** 2), 5)) AS a FROM s")
def period_ipdft(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("name"), F.col("embedding").cast("array<double>").alias("v"))
    return rows.select("name", F.transform(T.ipdft(F.col("v"), 2, 8), lambda x: F.round(x, 5)).alias("a"))


@register("period_goertzel", f"WITH {_SIG} SELECT name, round(sqrt(list_sum(list_transform(range(64), lambda i: v[i + 1] * cos(i * 2 * pi() / 3))) ** 2 + list_sum(list_transform(range(64), lambda i: v[i + 1] * sin(i * 2 * pi() / 3))) ** 2), 5) AS g FROM s")
def period_goertzel(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("name"), F.col("embedding").cast("array<double>").alias("v"))
    return rows.select("name", F.round(T.goertzel(F.col("v"), 3), 5).alias("g"))


@register("period_mismatch", f"WITH {DNA_SQL}, p AS (SELECT name, seq, unnest(range(1, length(seq) - 2)) AS i FROM seqs) SELECT name, round(avg((seq[i] <> seq[i + 3])::INTEGER), 8) AS f FROM p GROUP BY name")
def period_mismatch(spark: SparkSession, d: str) -> DataFrame:
    return dna(spark, d).select("name", F.round(T.mismatch_fraction(F.col("seq"), 3), 8).alias("f")).filter("f IS NOT NULL")


# trees
@register("tree_nj_of_labels")
def tree_nj_of_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d).join(table(spark, d, "embeddings").select(F.col("vec_id").alias("name"), "label"), "name")
    long = rows.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    means = long.groupBy(F.col("label").cast("string").alias("name")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda r: r["x"]).alias("v"))
    pairs = D.all_pairs(means, blocks=2).select("name1", "name2", V.euclidean("v1", "v2").alias("dist"))
    return tree.quick_trees(pairs)


@register("tree_tip_distances")
def tree_tip_distances(spark: SparkSession, d: str) -> DataFrame:
    return tree.tip_to_tip(tree.node_table(tree_nj_of_labels(spark, d).withColumn("tree_id", F.lit("labels"))))


@register("tree_upgma_of_nations")
def tree_upgma_of_nations(spark: SparkSession, d: str) -> DataFrame:
    means = table(spark, d, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("x"))
    rows = means.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("name"), "x", "n_regionkey")
    pairs = D.all_pairs(rows, blocks=2).filter("n_regionkey1 = n_regionkey2")
    return tree.quick_trees(pairs.select(F.col("n_regionkey1").alias("region"), "name1", "name2", F.abs(F.col("x1") - F.col("x2")).alias("dist")), ["region"], "upgma")


# models and alignment over families
def families(spark: SparkSession, d: str) -> DataFrame:
    """Each label's consensus and three of its parts' as a family of aligned sequences."""
    from ..operators.alignment import long_form

    rows = alignment(spark, d).join(table(spark, d, "embeddings").select(F.col("vec_id").alias("name"), "label"), "name")
    parts = long_form(rows.withColumn("name", F.concat_ws("_", "label", F.col("name") % 4))).withColumn("family", F.split("name", "_")[0])
    best = parts.groupBy("family", "name", "pos", "ch").agg(F.count(F.lit(1)).alias("n")).groupBy("family", "name", "pos").agg(F.max_by("ch", F.struct("n", "ch")).alias("c"))
    return best.groupBy("family", "name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "c"))), lambda x: x["c"]), "").alias("seq"))


@register("model_fits")
def model_fits(spark: SparkSession, d: str) -> DataFrame:
    return models.fit_models(families(spark, d), ["F81", "HKY85"], steps=20)


@register("model_hypothesis")
def model_hypothesis(spark: SparkSession, d: str) -> DataFrame:
    return models.hypothesis(models.fit_models(families(spark, d), ["F81", "HKY85"], steps=20), "F81", "HKY85")


@register("align_families_progressive")
def align_families_progressive(spark: SparkSession, d: str) -> DataFrame:
    return models.align_families(families(spark, d).withColumn("seq", F.translate("seq", "-", "")))


@register("align_pairs_local")
def align_pairs_local(spark: SparkSession, d: str) -> DataFrame:
    f = families(spark, d).withColumn("seq", F.translate("seq", "-", ""))
    pairs = D.all_pairs(f.select("name", "family", "seq"), blocks=2).filter("family1 = family2")
    return models.align_pairs(pairs.select("name1", "name2", "seq1", "seq2"), local=True).select("name1", "name2", "row1", "row2", "score")


# apps and formats
@register("app_not_completed", """WITH b AS (SELECT doc_id::VARCHAR AS id, CASE WHEN text IS NULL OR length(text) < 600 THEN 'FALSE' WHEN contains(text, '|') THEN 'BUG' END AS type FROM documents)
SELECT type, CASE type WHEN 'BUG' THEN 'count_words' ELSE 'min_length' END AS origin, CASE type WHEN 'BUG' THEN 'unexpected output value None' ELSE 'too short' END AS message, count(*) AS num, min(id) AS example FROM b WHERE type IS NOT NULL GROUP BY type""")
def app_not_completed(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    checked = apps.gate("min_length", F.length("text") >= 600, "too short") + apps.row_app("count_words", lambda t: str(len(t.split())) if "|" not in t else None, "text")
    return apps.summary_not_completed(checked(docs))


@register("app_gate_counts", "SELECT count(*) FILTER (length(text) >= 600) AS completed, count(*) FILTER (length(text) < 600) AS failed FROM documents")
def app_gate_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    done = apps.gate("min_length", F.length("text") >= 600, "too short")(docs)
    return done.agg(F.count_if(F.col("error").isNull()).alias("completed"), F.count_if(F.col("error").isNotNull()).alias("failed"))


@register("format_gff", f"WITH {SPAN_SQL} SELECT seqid, biotype, start, stop, name AS id FROM f")
def format_gff(spark: SparkSession, d: str) -> DataFrame:
    s = spans(spark, d)
    lines = s.select(F.concat_ws("\t", "seqid", F.lit("src"), "biotype", F.col("start") + 1, "stop", F.lit("."), F.lit("+"), F.lit("."), F.concat(F.lit("ID="), "name", F.lit(";Note=x"))).alias("value"))
    return formats.parse_gff(lines).select("seqid", "biotype", "start", "stop", "id")


@register("format_gff_merged", "SELECT l_orderkey::VARCHAR AS name, min(l_linenumber)::BIGINT AS start, max(l_linenumber)::BIGINT + 1 AS stop, count(DISTINCT l_linenumber)::INTEGER AS spans FROM lineitem GROUP BY ALL")
def format_gff_merged(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    lines = rows.select(F.concat_ws("\t", F.lit("s"), F.lit("src"), F.lit("line"), F.col("l_linenumber") + 1, F.col("l_linenumber") + 1, F.lit("."), F.lit("+"), F.lit("."), F.concat(F.lit("ID="), "l_orderkey")).alias("value"))
    return formats.merged_gff(formats.parse_gff(lines)).select("name", "start", "stop", F.size("spans").alias("spans"))


@register("format_blast_best_hits", """WITH h AS (SELECT l_orderkey::VARCHAR AS query, l_partkey::VARCHAR AS subject, l_discount AS e_value FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY e_value, subject) AS rank FROM h)
SELECT query, subject, e_value, rank::INTEGER AS rank FROM r WHERE rank <= 2""")
def format_blast_best_hits(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    lines = rows.select(F.concat_ws("\t", "l_orderkey", "l_partkey", *[F.lit("1")] * 8, "l_discount", F.lit("50")).alias("value"))
    return formats.best_hits(formats.parse_blast9(lines), 2).select("query", "subject", "e_value", "rank")
