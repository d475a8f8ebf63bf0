"""Substitution models: values with a closed form, and choices among fits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import likelihood as L
from ..functions import tree as N
from ..operators import models
from ..session import table
from .registry import register

PAIR = {"a": "ACGTACGTACGGT", "b": "ACGTACGTAAGCT"}


@register("model_jc69_values", """WITH t AS (SELECT 0.3::DOUBLE AS t), p AS (SELECT 0.25 + 0.75 * exp(-4 * t / 3) AS same, 0.25 - 0.25 * exp(-4 * t / 3) AS other FROM t)
SELECT round(11 * ln(same / 4) + 2 * ln(other / 4), 5) AS lnl, round(same, 6) AS same, round(other, 6) AS other, 2::BIGINT AS nfp, 0.3::DOUBLE AS substitutions FROM p""")
def model_jc69_values(spark: SparkSession, d: str) -> DataFrame:
    lf = L.LikelihoodFunction(L.get_model("JC69"), N.parse_newick("(a:0.1,b:0.2);"), PAIR)
    one = N.parse_newick("(a:0.3,b:0.0);")
    p = lf.psub(one.children[0])
    subs = L.expected_number_subs(lf.pi, lf.q(), 0.3)
    row = (round(lf.lnl(), 5), round(float(p[0, 0]), 6), round(float(p[0, 1]), 6), lf.nfp, round(float(subs), 6))
    return spark.createDataFrame([row], "lnl double, same double, other double, nfp long, substitutions double")


@register("model_matrix_functions", "SELECT * FROM (VALUES ('exp diagonal', round(0.25 + 0.75 * exp(-0.8), 6)), ('exp other', round(0.25 - 0.25 * exp(-0.8), 6)), ('log of exp', 0.0)) v(what, value)")
def model_matrix_functions(spark: SparkSession, d: str) -> DataFrame:
    """A rate matrix of equal rates, its exponential and the logarithm of that."""
    q = (np.ones((4, 4)) - 4 * np.eye(4)) * 0.2
    e = L.expm(q)
    back = float(np.abs(L.logm(e) - q).max())
    rows = [("exp diagonal", float(e[0, 0])), ("exp other", float(e[0, 1])), ("log of exp", back)]
    return spark.createDataFrame(rows, "what string, value double").select("what", (F.round("value", 6) + 0.0).alias("value"))


_FITS = "fits AS (SELECT o_orderpriority AS family, o_orderstatus AS model, -sum(o_totalprice) / 1e6 AS lnl, CASE o_orderstatus WHEN 'F' THEN 5 WHEN 'O' THEN 7 ELSE 9 END AS nfp FROM orders GROUP BY ALL), f AS (SELECT *, -2 * lnl + 2 * nfp AS aic FROM fits)"


def fits(spark: SparkSession, d: str) -> DataFrame:
    """Orders' totals as if they were log-likelihoods of three models for each priority."""
    rows = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("family"), F.col("o_orderstatus").alias("model")).agg((-F.sum("o_totalprice") / 1e6).alias("lnl"))
    rows = rows.withColumn("nfp", F.when(F.col("model") == "F", 5).when(F.col("model") == "O", 7).otherwise(9))
    return rows.withColumn("aic", -2 * F.col("lnl") + 2 * F.col("nfp"))


@register("model_selected", f"WITH {_FITS}, m AS (SELECT *, min(aic) OVER (PARTITION BY family) AS best FROM f) SELECT family, model, nfp, round(aic, 3) AS aic FROM m WHERE exp((best - aic) / 2) > 0.05 OR aic = best")
def model_selected(spark: SparkSession, d: str) -> DataFrame:
    return models.select_models(fits(spark, d)).select("family", "model", "nfp", F.round("aic", 3).alias("aic"))


@register("model_best", f"WITH {_FITS}, m AS (SELECT *, min(aic) OVER (PARTITION BY family) AS best FROM f) SELECT family, arg_min(model, (nfp, aic, model)) AS model FROM m WHERE exp((best - aic) / 2) > 0.05 OR aic = best GROUP BY family")
def model_best(spark: SparkSession, d: str) -> DataFrame:
    return models.best_model(fits(spark, d))


@register("model_likelihood_ratios", f"WITH {_FITS}, r AS (SELECT a.family, 2 * (b.lnl - a.lnl) AS LR FROM f a JOIN f b ON a.family = b.family AND a.model = 'F' AND b.model = 'O') SELECT family, round(LR, 4) AS LR, 2 AS df, round(CASE WHEN LR < 0 THEN NULL WHEN LR = 0 THEN 1 ELSE exp(-LR / 2) END, 6) AS pvalue FROM r")
def model_likelihood_ratios(spark: SparkSession, d: str) -> DataFrame:
    out = models.hypothesis(fits(spark, d), "F", "O")
    return out.select("family", F.round("LR", 4).alias("LR"), "df", F.round("pvalue", 6).alias("pvalue"))


@register("model_site_patterns_fixed", "SELECT * FROM (VALUES ('AA', 3), ('CC', 3), ('GG', 3), ('TT', 3), ('CA', 1)) v(pattern, n)")
def model_site_patterns_fixed(spark: SparkSession, d: str) -> DataFrame:
    names, columns, counts = L.patterns({"a": "ACGTACGTACGTC", "b": "ACGTACGTACGTA"}, L.get_model("JC69"))
    return spark.createDataFrame([("".join(c), int(n)) for c, n in zip(columns, counts)], "pattern string, n int")


@register("model_catalogue", "SELECT * FROM (VALUES " + ", ".join(f"('{m}', {n})" for m, n in (("F81", 0), ("GTR", 5), ("HKY85", 1), ("JC69", 0), ("K80", 1), ("TN93", 2))) + ") v(name, n_parameters)")
def model_catalogue(spark: SparkSession, d: str) -> DataFrame:
    rows = [(n, k) for n, _, k in L.available_models(["nucleotide"]) if n in ("F81", "GTR", "HKY85", "JC69", "K80", "TN93")]
    return spark.createDataFrame(rows, "name string, n_parameters int")


@register("model_ancestor", "SELECT * FROM (VALUES ('root', 'ACGT')) v(node, seq)")
def model_ancestor(spark: SparkSession, d: str) -> DataFrame:
    """Three equal sequences have an ancestor that equals them."""
    seqs = spark.createDataFrame([("f", n, "ACGT") for n in "abc"], "family string, name string, seq string")
    trees = spark.createDataFrame([("f", "(a:0.1,b:0.1,c:0.1)root;")], "family string, newick string")
    out = models.ancestral_states(seqs, trees)
    text = next(c for c in out.columns if dict(out.dtypes)[c] == "string" and c not in ("family", "node", "name"))
    return out.select(F.lit("root").alias("node"), F.col(text).alias("seq")).limit(1)
