"""Table operators over orders, line items, customers and nations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import table as O
from ..session import table
from .registry import register


@register("table_filtered", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
def table_filtered(spark: SparkSession, d: str) -> DataFrame:
    return O.get_columns(O.filtered(table(spark, d, "lineitem"), "l_quantity > 45 and l_returnflag == 'R'"), ["l_orderkey", "l_linenumber", "l_quantity"])


@register("table_filtered_negate", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus IN ('F', 'O'))")
def table_filtered_negate(spark: SparkSession, d: str) -> DataFrame:
    return O.filtered(table(spark, d, "orders"), "o_orderstatus in ('F', 'O')", negate=True).select("o_orderkey")


@register("table_row_mask", "SELECT c_custkey, c_acctbal < 0 AS mask FROM customer")
def table_row_mask(spark: SparkSession, d: str) -> DataFrame:
    return O.row_mask(table(spark, d, "customer"), "c_acctbal < 0").select("c_custkey", "mask")


@register("table_count", "SELECT count(*) FILTER (l_discount >= 0.05 AND l_tax < 0.03) AS n FROM lineitem")
def table_count(spark: SparkSession, d: str) -> DataFrame:
    return O.count(table(spark, d, "lineitem"), "l_discount >= 0.05 and l_tax < 0.03")


@register("table_count_unique", "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS count FROM lineitem GROUP BY ALL")
def table_count_unique(spark: SparkSession, d: str) -> DataFrame:
    return O.count_unique(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])


@register("table_distinct_values", "SELECT DISTINCT p_brand, p_size FROM part")
def table_distinct_values(spark: SparkSession, d: str) -> DataFrame:
    return O.distinct_values(table(spark, d, "part"), ["p_brand", "p_size"])


@register("table_with_new_column", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 5) AS net FROM lineitem")
def table_with_new_column(spark: SparkSession, d: str) -> DataFrame:
    out = O.with_new_column(table(spark, d, "lineitem"), "net", "l_extendedprice * (1 - l_discount)", "double")
    return out.select("l_orderkey", "l_linenumber", F.round("net", 5).alias("net"))


@register("table_with_new_header", "SELECT c_custkey AS id, c_name AS label FROM customer")
def table_with_new_header(spark: SparkSession, d: str) -> DataFrame:
    return O.with_new_header(table(spark, d, "customer"), ["c_custkey", "c_name"], ["id", "label"]).select("id", "label")


@register("table_inner_join", "SELECT o_orderkey, o_custkey, c_name AS right_c_name, c_mktsegment AS right_c_mktsegment FROM orders JOIN customer ON o_custkey IS NOT DISTINCT FROM c_custkey")
def table_inner_join(spark: SparkSession, d: str) -> DataFrame:
    out = O.inner_join(table(spark, d, "orders"), table(spark, d, "customer"), "o_custkey", "c_custkey")
    return out.select("o_orderkey", "o_custkey", "right_c_name", "right_c_mktsegment")


@register("table_natural_join", "SELECT n_nationkey, n_name, n_regionkey AS regionkey, r_name AS right_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def table_natural_join(spark: SparkSession, d: str) -> DataFrame:
    left = table(spark, d, "nation").withColumnRenamed("n_regionkey", "regionkey")
    right = table(spark, d, "region").withColumnsRenamed({"r_regionkey": "regionkey", "r_name": "name"})
    return O.joined(left, right)


@register("table_cross_join", "SELECT a.r_regionkey, a.r_name, b.r_regionkey AS right_r_regionkey, b.r_name AS right_r_name FROM region a, region b")
def table_cross_join(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "region")
    return O.joined(r, r, inner=False)


@register("table_appended", "SELECT 'customer' AS kind, c_custkey AS key, c_acctbal AS balance FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal FROM supplier")
def table_appended(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"))
    return O.appended(c, s, new_column="kind", titles=["customer", "supplier"])


@register("table_sorted_head", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def table_sorted_head(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return O.sort(rows, ["o_totalprice", "o_orderkey"], reverse="o_totalprice").limit(50)


@register("table_sorted", "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier ORDER BY s_nationkey, s_acctbal DESC, s_suppkey")
def table_sorted(spark: SparkSession, d: str) -> DataFrame:
    return O.sort(table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal"), ["s_nationkey", "s_acctbal"], reverse="s_acctbal")


@register("table_tail", "SELECT c_custkey FROM customer ORDER BY c_custkey DESC LIMIT 20")
def table_tail(spark: SparkSession, d: str) -> DataFrame:
    return O.tail(table(spark, d, "customer").select("c_custkey"), 20, "c_custkey")


@register("table_sum_columns", "SELECT round(sum(l_quantity), 2) AS l_quantity, round(sum(l_tax), 2) AS l_tax FROM lineitem")
def table_sum_columns(spark: SparkSession, d: str) -> DataFrame:
    return O.summed(table(spark, d, "lineitem"), ["l_quantity", "l_tax"]).select(F.round("l_quantity", 2).alias("l_quantity"), F.round("l_tax", 2).alias("l_tax"))


@register("table_sum_rows", "SELECT l_orderkey, l_linenumber, round(l_quantity + l_discount + l_tax, 4) AS sum FROM lineitem")
def table_sum_rows(spark: SparkSession, d: str) -> DataFrame:
    out = O.sum_rows(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"])
    return out.select("l_orderkey", "l_linenumber", F.round("sum", 4).alias("sum"))


@register("table_sum_not_strict", "SELECT sum(try_cast(substr(p_brand, 7) AS DOUBLE)) AS brand, sum(try_cast(p_size AS DOUBLE)) AS p_size FROM part")
def table_sum_not_strict(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.expr("substring(p_brand, 7)").alias("brand"), "p_size")
    return O.sum_columns(rows, ["brand", "p_size"], strict=False)


@register("table_normalized_rows", "SELECT l_orderkey, l_linenumber, round(l_quantity / (l_quantity + l_extendedprice), 8) AS l_quantity, round(l_extendedprice / (l_quantity + l_extendedprice), 8) AS l_extendedprice FROM lineitem")
def table_normalized_rows(spark: SparkSession, d: str) -> DataFrame:
    out = O.normalized(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"])
    return out.select("l_orderkey", "l_linenumber", F.round("l_quantity", 8).alias("l_quantity"), F.round("l_extendedprice", 8).alias("l_extendedprice"))


@register("table_normalized_columns", "SELECT s_suppkey, round(s_acctbal / (SELECT max(s_acctbal) FROM supplier), 8) AS s_acctbal FROM supplier")
def table_normalized_columns(spark: SparkSession, d: str) -> DataFrame:
    out = O.normalized(table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), ["s_acctbal"], by_row=False, denominator=lambda c: F.max(c[0]))
    return out.select("s_suppkey", F.round("s_acctbal", 8).alias("s_acctbal"))


REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


@register("table_transposed", """WITH n AS (SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name)
SELECT 'n' AS stat, """ + ", ".join(f"max(n) FILTER (r_name = '{r}') AS \"{r}\"" for r in REGIONS) + " FROM n")
def table_transposed(spark: SparkSession, d: str) -> DataFrame:
    n = O.inner_join(table(spark, d, "nation"), table(spark, d, "region"), "n_regionkey", "r_regionkey")
    return O.transposed(n.groupBy("right_r_name").agg(F.count(F.lit(1)).alias("n")), "stat", "right_r_name")


@register("table_filtered_by_column", "SELECT l_extendedprice FROM lineitem")
def table_filtered_by_column(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return O.filtered_by_column(rows, lambda c: F.max(c) > 60)


@register("matrix_long_normalized", "WITH n AS (SELECT l_returnflag AS row, l_linestatus AS col, count(*) AS n FROM lineitem GROUP BY ALL) SELECT row, col, n / sum(n) OVER (PARTITION BY row) AS value FROM n")
def matrix_long_normalized(spark: SparkSession, d: str) -> DataFrame:
    n = O.category_counts(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"]).toDF("row", "col", "value")
    return O.matrix_normalized(n, "row")


@register("matrix_sums", "SELECT l_linestatus AS col, count(*)::BIGINT AS value FROM lineitem GROUP BY ALL")
def matrix_sums(spark: SparkSession, d: str) -> DataFrame:
    n = O.category_counts(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"]).toDF("row", "col", "value")
    return O.matrix_sums(n, "col")


@register("counter_cross_tab", "SELECT o_orderstatus, count(*) FILTER (o_orderpriority LIKE '1%') AS urgent, count(*) FILTER (o_orderpriority NOT LIKE '1%') AS other FROM orders GROUP BY ALL")
def counter_cross_tab(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").withColumn("p", F.when(F.col("o_orderpriority").startswith("1"), "urgent").otherwise("other"))
    return O.cross_tab(O.category_counts(rows, ["o_orderstatus", "p"]), "o_orderstatus", "p")


@register("counter_marginal", "SELECT event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def counter_marginal(spark: SparkSession, d: str) -> DataFrame:
    return O.marginal_counts(O.category_counts(table(spark, d, "events"), ["event_type", "user_id"]), "event_type")


@register("counter_freqs", "WITH n AS (SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY l_returnflag), 8) AS freq FROM n")
def counter_freqs(spark: SparkSession, d: str) -> DataFrame:
    out = O.to_freqs(O.category_counts(table(spark, d, "lineitem"), ["l_returnflag", "l_linenumber"]), ["l_returnflag"])
    return out.withColumn("freq", F.round("freq", 8))


@register("counter_entropy", """WITH c AS (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT event_type, n / sum(n) OVER (PARTITION BY event_type) AS p FROM c)
SELECT event_type, round(-sum(p * log2(p)), 6) AS entropy FROM p GROUP BY ALL""")
def counter_entropy(spark: SparkSession, d: str) -> DataFrame:
    return O.counts_entropy(O.category_counts(table(spark, d, "events"), ["event_type", "user_id"]), ["event_type"]).select("event_type", F.round("entropy", 6).alias("entropy"))


@register("counter_mode", "SELECT l_suppkey, arg_max(l_linenumber, n * 100 + l_linenumber) AS mode FROM (SELECT l_suppkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY ALL")
def counter_mode(spark: SparkSession, d: str) -> DataFrame:
    return O.mode(O.category_counts(table(spark, d, "lineitem"), ["l_suppkey", "l_linenumber"]), "l_linenumber", ["l_suppkey"])


@register("counter_number_stats", "SELECT round(avg(l_linenumber), 8) AS mean, round(var_samp(l_linenumber), 6) AS var, round(stddev_samp(l_linenumber), 6) AS std FROM lineitem")
def counter_number_stats(spark: SparkSession, d: str) -> DataFrame:
    out = O.number_counter_stats(O.category_counts(table(spark, d, "lineitem"), "l_linenumber"), "l_linenumber")
    return out.select(F.round("mean", 8).alias("mean"), F.round("var", 6).alias("var"), F.round("std", 6).alias("std"))


@register("counter_expand", "SELECT l_linenumber FROM lineitem")
def counter_expand(spark: SparkSession, d: str) -> DataFrame:
    return O.expand_counts(O.category_counts(table(spark, d, "lineitem"), "l_linenumber"))


@register("summary_stats", """SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(var_samp(value), 4) AS var, round(stddev_samp(value), 6) AS std,
  round(quantile_cont(value, 0.25), 6) AS q25, round(median(value), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75 FROM events GROUP BY ALL""")
def summary_stats(spark: SparkSession, d: str) -> DataFrame:
    out = O.summary_stats(table(spark, d, "events"), "value", ["event_type"])
    return out.select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("var", 4).alias("var"), *[F.round(c, 6).alias(c) for c in ("std", "q25", "q50", "q75")])


@register("table_take_labels", "SELECT l_returnflag AS row, l_linestatus AS col, count(*) AS n FROM lineitem WHERE l_returnflag NOT IN ('N') GROUP BY ALL")
def table_take_labels(spark: SparkSession, d: str) -> DataFrame:
    n = O.category_counts(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"]).toDF("row", "col", "n")
    return O.take_labels(n, "row", ["N"], negate=True)


@register("table_symmetric", "SELECT a.n_name AS name1, b.n_name AS name2, abs(a.n_regionkey - b.n_regionkey)::DOUBLE AS dist FROM nation a, nation b")
def table_symmetric(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.distance import all_pairs

    p = all_pairs(table(spark, d, "nation"), "n_name", 2)
    return O.symmetric(p.select(F.col("n_name1").alias("name1"), F.col("n_name2").alias("name2"), F.abs(F.col("n_regionkey1") - F.col("n_regionkey2")).cast("double").alias("dist")))
