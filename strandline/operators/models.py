"""Alignment and model fitting over many families: rows (family, name, seq), one family to a task."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import chi2_sf
from ..session import ship


def align_pairs(pairs: DataFrame, a: str = "seq1", b: str = "seq2", local: bool = False, gap_open: float = 10, gap_extend: float = 2) -> DataFrame:
    """`pairs` with row1, row2 and score of each pair's alignment, in Arrow batches."""
    ship(pairs.sparkSession)

    @F.pandas_udf("row1 string, row2 string, score double")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        from ..functions.pairwise import align, dna_scores

        s = dna_scores()
        return pd.DataFrame([align(p or "", q or "", s, gap_open, gap_extend, local) for p, q in zip(x, y)], columns=["row1", "row2", "score"])

    return pairs.withColumn("__a", run(a, b)).select(*pairs.columns, "__a.*")


def _per_family(df: DataFrame, run, schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.groupBy("family").applyInPandas(run, schema)


def align_families(seqs: DataFrame, method: str = "progressive", ref: str | None = None) -> DataFrame:
    """Each family's sequences aligned: along a guide tree, or to a reference (a name, or the longest)."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        from ..functions.pairwise import align_to_ref, progressive

        data = dict(zip(g["name"], g["seq"]))
        made = progressive(data) if method == "progressive" else align_to_ref(data, ref)
        return pd.DataFrame([(g["family"].iloc[0], n, s) for n, s in sorted(made.items())], columns=["family", "name", "seq"])

    return _per_family(seqs, run, f"family {dict(seqs.dtypes)['family']}, name string, seq string")


def fit_models(seqs: DataFrame, models: Sequence[str], trees: DataFrame | None = None, steps: int = 60) -> DataFrame:
    """(family, model, lnl, nfp, n, aic, bic, newick): every model fitted to every family; families and models are dealt
    together, so a task fits one model. Without trees (family, newick) a neighbour-joining tree is made."""
    ship(seqs.sparkSession)
    rows = seqs if trees is None else seqs.join(trees, "family")
    rows = rows.withColumn("model", F.explode(F.array(*map(F.lit, models))))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        import math

        import numpy as np

        from ..functions.likelihood import LikelihoodFunction, get_model
        from ..functions.tree import nj, parse_newick

        data = dict(zip(g["name"], g["seq"]))
        names = sorted(data)
        if "newick" in g:
            tree = parse_newick(g["newick"].iloc[0])
        else:
            d = lambda x, y: sum(p != q for p, q in zip(x, y)) / max(1, min(len(x), len(y)))
            tree = nj(names, np.array([[d(data[a], data[b]) for b in names] for a in names]))
        model = get_model(g["model"].iloc[0])
        lf = LikelihoodFunction(model, tree, data).fit(steps)
        n, lnl = float(lf.counts.sum()), lf.lnl()
        out = (g["family"].iloc[0], model.name, lnl, lf.nfp, int(n), -2 * lnl + 2 * lf.nfp, -2 * lnl + lf.nfp * math.log(n) if n else math.nan, lf.tree.newick())
        return pd.DataFrame([out], columns=["family", "model", "lnl", "nfp", "n", "aic", "bic", "newick"])

    kind = dict(seqs.dtypes)["family"]
    return rows.groupBy("family", "model").applyInPandas(run, f"family {kind}, model string, lnl double, nfp int, n int, aic double, bic double, newick string")


def tabulate_stats(fits: DataFrame, seqs: DataFrame) -> DataFrame:
    """(family, model, table, edge, name, value): the statistics of fitted models on their alignments, lengths as fitted."""
    ship(fits.sparkSession)
    rows = seqs.join(fits.select("family", "model", "newick"), "family")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        from ..functions.likelihood import LikelihoodFunction, get_model
        from ..functions.tree import name_inner, parse_newick

        model = get_model(g["model"].iloc[0])
        lf = LikelihoodFunction(model, name_inner(parse_newick(g["newick"].iloc[0])), dict(zip(g["name"], g["seq"])))
        rows = [(g["family"].iloc[0], model.name, *r) for r in lf.statistics()]
        return pd.DataFrame(rows, columns=["family", "model", "table", "edge", "name", "value"])

    kind = dict(seqs.dtypes)["family"]
    return rows.groupBy("family", "model").applyInPandas(run, f"family {kind}, model string, table string, edge string, name string, value double")


def hypothesis(fits: DataFrame, null: str, alt: str) -> DataFrame:
    """(family, LR, df, pvalue) of two fitted models; p is 1 at LR 0 and null below."""
    ship(fits.sparkSession)
    a = fits.filter(F.col("model") == null).select("family", F.col("lnl").alias("l0"), F.col("nfp").alias("n0"))
    b = fits.filter(F.col("model") == alt).select("family", F.col("lnl").alias("l1"), F.col("nfp").alias("n1"))

    @F.pandas_udf("double")
    def p(lr: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([None if x < 0 else 1.0 if x == 0 else chi2_sf(float(x), int(d)) for x, d in zip(lr, df)], dtype="float64")

    out = a.join(b, "family").select("family", (2 * (F.col("l1") - F.col("l0"))).alias("LR"), (F.col("n1") - F.col("n0")).alias("df"))
    return out.withColumn("pvalue", p("LR", "df"))


def select_models(fits: DataFrame, stat: str = "aic", threshold: float = 0.05) -> DataFrame:
    """Models of a family whose relative likelihood exp((min - v) / 2) is over the threshold, and the best."""
    best = fits.groupBy("family").agg(F.min(stat).alias("__best"))
    return fits.join(best, "family").filter((F.exp((F.col("__best") - F.col(stat)) / 2) > threshold) | (F.col(stat) == F.col("__best"))).drop("__best")


def best_model(fits: DataFrame, stat: str = "aic", threshold: float = 0.05) -> DataFrame:
    """The selected model with the fewest parameters, the first by name of equals."""
    s = select_models(fits, stat, threshold)
    return s.groupBy("family").agg(F.min_by("model", F.struct("nfp", stat, "model")).alias("model"))


def bootstrap(seqs: DataFrame, null: str, alt: str, reps: int, seed: int = 1, steps: int = 40) -> DataFrame:
    """(family, rep, LR): the ratio on the data (rep 0) and on alignments simulated under the fitted null, a replicate to a task."""
    ship(seqs.sparkSession)
    rows = seqs.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps))))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        from ..functions.likelihood import LikelihoodFunction, get_model
        from ..functions.tree import nj

        data = dict(zip(g["name"], g["seq"]))
        rep, names = int(g["rep"].iloc[0]), sorted(data)
        d = lambda x, y: sum(p != q for p, q in zip(x, y)) / max(1, min(len(x), len(y)))
        tree = nj(names, np.array([[d(data[a], data[b]) for b in names] for a in names]))
        if rep:
            fitted = LikelihoodFunction(get_model(null), tree, data).fit(steps)
            data = fitted.simulate(int(fitted.counts.sum()), seed * 100_003 + rep)
        lnls = [LikelihoodFunction(get_model(m), tree.copy(), data).fit(steps).lnl() for m in (null, alt)]
        return pd.DataFrame([(g["family"].iloc[0], rep, 2 * (lnls[1] - lnls[0]))], columns=["family", "rep", "LR"])

    return rows.groupBy("family", "rep").applyInPandas(run, f"family {dict(seqs.dtypes)['family']}, rep int, LR double")


def bootstrap_pvalue(reps: DataFrame) -> DataFrame:
    seen = reps.filter("rep = 0").select("family", F.col("LR").alias("observed"))
    return reps.filter("rep > 0").join(seen, "family").groupBy("family", "observed").agg(F.avg((F.col("LR") >= F.col("observed")).cast("double")).alias("pvalue"))


def ancestral_states(seqs: DataFrame, trees: DataFrame, model: str = "F81") -> DataFrame:
    """(family, node, seq): the likeliest states of inner nodes."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        from ..functions.likelihood import LikelihoodFunction, get_model
        from ..functions.tree import name_inner, parse_newick

        lf = LikelihoodFunction(get_model(model), name_inner(parse_newick(g["newick"].iloc[0])), dict(zip(g["name"], g["seq"])))
        return pd.DataFrame([(g["family"].iloc[0], n, s) for n, s in lf.likely_ancestral().items()], columns=["family", "node", "seq"])

    return _per_family(seqs.join(trees, "family"), run, f"family {dict(seqs.dtypes)['family']}, node string, seq string")


def ml_distances(pairs: DataFrame, model: str = "F81") -> DataFrame:
    """`pairs` (seq1, seq2 aligned) with the distance of the greatest likelihood."""
    ship(pairs.sparkSession)

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        from ..functions.likelihood import ml_pair_distance

        return pd.Series([ml_pair_distance(x, y, model) for x, y in zip(a, b)])

    return pairs.withColumn("dist", run("seq1", "seq2"))


def site_patterns(aln: DataFrame) -> DataFrame:
    """(pattern, n): distinct columns with counts, names in order."""
    from .alignment import long_form

    cols = long_form(aln).groupBy("pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "ch"))), lambda x: x["ch"]), "").alias("pattern"))
    return cols.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
