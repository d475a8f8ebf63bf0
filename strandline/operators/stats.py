"""Contingency tests, information criteria, coevolution, periodicity and resampling over DataFrames."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.special import chi2_pvalue
from ..session import ship
from .ranges import PER_PART, totals_before


# contingency tables: (row, col, n), further keys in `by`
def expected(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """With `expected` from the margins. Labels of rows and columns are few, so the windows hold few rows."""
    row, column, grand = W.partitionBy(*by, "row"), W.partitionBy(*by, "col"), W.partitionBy(*by, F.lit(1))
    return counts.withColumn("expected", F.sum("n").over(row) * F.sum("n").over(column) / F.sum("n").over(grand))


def residuals(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return expected(counts, by).withColumn("residual", (F.col("n") - F.col("expected")) / F.sqrt("expected"))


def _df(_: Sequence[str]) -> Column:
    return (F.count_distinct("row") - 1) * (F.count_distinct("col") - 1)


def chisq_test(counts: DataFrame, by: Sequence[str] = (), pvalue: bool = True) -> DataFrame:
    """(by…, chisq, df, pvalue) of independence; counts must have all cells, zeros too."""
    e = expected(counts, by)
    out = e.groupBy(*by).agg(F.sum(F.pow(F.col("n") - F.col("expected"), 2) / F.col("expected")).alias("chisq"), _df(by).alias("df"))
    return out.withColumn("pvalue", chi2_pvalue(counts.sparkSession, "chisq", "df")) if pvalue else out


def g_independence(counts: DataFrame, by: Sequence[str] = (), williams: bool = True, pseudo_count: float = 0.0, pvalue: bool = True) -> DataFrame:
    """(by…, G, df, pvalue): 2 Σ o ln(o/e) over cells with counts, with Williams' correction."""
    rows = counts.withColumn("n", F.col("n") + pseudo_count) if pseudo_count else counts
    row, column, grand = W.partitionBy(*by, "row"), W.partitionBy(*by, "col"), W.partitionBy(*by, F.lit(1))
    e = rows.withColumns({"rs": F.sum("n").over(row), "cs": F.sum("n").over(column), "total": F.sum("n").over(grand), "rn": F.count(F.lit(1)).over(row), "cn": F.count(F.lit(1)).over(column)})
    term = F.when(F.col("n") > 0, F.col("n") * F.ln(F.col("n") * F.col("total") / (F.col("rs") * F.col("cs")))).otherwise(0.0)
    out = e.groupBy(*by).agg(
        (2 * F.sum(term)).alias("G"),
        _df(by).alias("df"),
        F.sum(F.col("total") / F.col("rs") / F.col("rn")).alias("qr"),
        F.sum(F.col("total") / F.col("cs") / F.col("cn")).alias("qc"),
        F.max("total").alias("total"),
    )
    q = 1 + (F.col("qr") - 1) * (F.col("qc") - 1) / (6 * F.col("total") * F.col("df")) if williams else F.lit(1.0)
    out = out.select(*by, (F.col("G") / q).alias("G"), "df")
    return out.withColumn("pvalue", chi2_pvalue(counts.sparkSession, "G", "df")) if pvalue else out


def g_fit(counts: DataFrame, by: Sequence[str] = (), williams: bool = True, pvalue: bool = True) -> DataFrame:
    """(by…, G, df, pvalue) of one-way counts against `expected` (a column), or against equal shares."""
    w = W.partitionBy(*by, F.lit(1))
    rows = counts if "expected" in counts.columns else counts.withColumn("expected", F.avg("n").over(w))
    term = F.when(F.col("n") > 0, F.col("n") * F.ln(F.col("n") / F.col("expected"))).otherwise(0.0)
    k = F.count(F.lit(1))
    q = 1 + (k * k - 1) / (6 * F.sum("n") * (k - 1)) if williams else F.lit(1.0)
    out = rows.groupBy(*by).agg((2 * F.sum(term) / q).alias("G"), (k - 1).alias("df"))
    return out.withColumn("pvalue", chi2_pvalue(counts.sparkSession, "G", "df")) if pvalue else out


def g_2_by_2(a: Column, b: Column, c: Column, d: Column, williams: bool = True) -> Column:
    """The G statistic of four counts."""
    n = a + b + c + d
    x = lambda v: F.when(v > 0, v * F.ln(v)).otherwise(0.0)
    g = 2 * (x(a) + x(b) + x(c) + x(d) + x(n) - x(a + b) - x(c + d) - x(a + c) - x(b + d))
    q = 1 + (n / (a + b) + n / (c + d) - 1) * (n / (a + c) + n / (b + d) - 1) / (6 * n)
    return g / q if williams else g


#: Cells of a contingency table that the driver takes.
MOST_CELLS = 1_000_000


def permutation_pvalue(counts: DataFrame, reps: int = 100, seed: int = 1) -> DataFrame:
    """(observed, pvalue): the share of random tables with these margins whose χ² is at least that observed; replicates are
    tasks. Tables are drawn cell by cell, row after row, so the work doesn't grow with the counts; more than MOST_CELLS
    cells are an error."""
    ship(counts.sparkSession)
    cells = counts.groupBy("row", "col").agg(F.sum("n").alias("n")).limit(MOST_CELLS + 1).toPandas()
    if len(cells) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} cells")
    table = cells.pivot_table(index="row", columns="col", values="n", aggfunc="sum", fill_value=0).to_numpy(dtype=np.int64)

    def chisq(m: np.ndarray) -> float:
        e = np.outer(m.sum(1), m.sum(0)) / m.sum()
        return float(((m - e) ** 2 / e).sum())

    seen = chisq(table)

    def run(frames):
        for f in frames:
            hits = []
            for r in f["id"]:
                random, left = np.random.default_rng([seed, int(r)]), table.sum(0)
                rows = []
                for n in table.sum(1):
                    rows.append(random.multivariate_hypergeometric(left, n, method="marginals"))
                    left = left - rows[-1]
                hits.append(chisq(np.array(rows)) >= seen - 1e-12)
            yield pd.DataFrame({"hit": hits})

    out = counts.sparkSession.range(reps).mapInPandas(run, "hit boolean")
    return out.agg(F.lit(seen).alias("observed"), F.avg(F.col("hit").cast("double")).alias("pvalue"))


# criteria
def aic(lnl: Column, nfp: Column, n: Column | None = None) -> Column:
    return -2 * lnl + 2 * nfp * (n / (n - nfp - 1) if n is not None else 1)


def bic(lnl: Column, nfp: Column, n: Column) -> Column:
    return -2 * lnl + nfp * F.ln(n)


def likelihood_ratio(null: Column, alt: Column) -> Column:
    return 2 * (alt - null)


# jackknife of means
def jackknife_mean(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by…, mean, pseudo_mean, se): every row left out once, from two sums."""
    n, s, s2 = F.count(value), F.sum(value), F.sum(F.col(value) * F.col(value))
    var = (s2 - s * s / n) / (n - 1)
    return df.groupBy(*by).agg((s / n).alias("mean"), (s / n).alias("pseudo_mean"), F.sqrt(var / n).alias("se"))


def jackknife(df: DataFrame, value: str, stat: Callable[[np.ndarray], float], by: Sequence[str]) -> DataFrame:
    """(by…, stat, jackknife, se) of any statistic, a group to a task."""
    ship(df.sparkSession)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        x = g[value].to_numpy(dtype=float)
        whole = stat(x)
        left = np.array([stat(np.delete(x, i)) for i in range(len(x))])
        pseudo = len(x) * whole - (len(x) - 1) * left
        out = {k: g[k].iloc[0] for k in by} | {"stat": whole, "jackknife": pseudo.mean(), "se": math.sqrt(pseudo.var(ddof=1) / len(x)) if len(x) > 1 else float("nan")}
        return pd.DataFrame([out])

    kinds = dict(df.dtypes)
    return df.groupBy(*by).applyInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in by) + ", stat double, jackknife double, se double")


# coevolution: columns of an alignment in long form (name, pos, ch)
def coevolution(long: DataFrame, letters: str = "TCAG", stat: str = "mi", rows: int = 2048, columns: int = 128) -> DataFrame:
    """(pos1, pos2, mi | nmi) of every pair of columns, over rows with letters in both.

    mi is H1 + H2 - H12 in bits; nmi divides it by H12. Joint counts come from products of 0/1 matrices, of some `rows`
    names and two blocks of `columns` each, so a task is bounded however long or wide the alignment is.
    """
    ship(long.sparkSession)
    ok = long.filter(F.col("ch").isin(*letters)).select("name", F.col("pos").cast("int").alias("pos"), (F.instr(F.lit(letters), F.col("ch")) - 1).alias("c"))
    sizes = ok.agg(F.approx_count_distinct("name").alias("n"), F.max("pos").alias("width")).first()
    parts, last, k = max(1, (sizes.n or 0) // rows + 1), (sizes.width or 0) // columns, len(letters)
    placed = ok.withColumn("part", F.pmod(F.xxhash64("name"), F.lit(parts)).cast("int")).withColumn("mine", F.floor(F.col("pos") / columns).cast("int"))
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.lit(last)), lambda o: F.struct(F.least("mine", o).alias("low"), F.greatest("mine", o).alias("high"))))
    dealt = placed.select("part", "name", "pos", "c", pair.alias("p")).select("part", "name", "pos", "c", "p.low", "p.high")

    def count(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        _, low, high = key
        _, names = np.unique(g["name"].to_numpy(), return_inverse=True)
        flat = np.zeros((names.max() + 1, (high - low + 1 if high == low else 2) * columns * k), dtype=np.float32)
        at = g["pos"].to_numpy() - low * columns
        at = np.where(g["pos"].to_numpy() >= high * columns, g["pos"].to_numpy() - high * columns + (columns if high > low else 0), at)
        flat[names, at * k + g["c"].to_numpy()] = 1
        left, right = flat[:, : columns * k], flat[:, -columns * k :]
        joint = (left.T @ right).astype(np.int64)
        i, j = np.nonzero(joint)
        p1, p2 = low * columns + i // k, high * columns + j // k
        ok = p1 < p2
        return pd.DataFrame({"pos1": p1[ok], "pos2": p2[ok], "c1": (i % k)[ok], "c2": (j % k)[ok], "n": joint[i, j][ok]})

    found = dealt.groupBy("part", "low", "high").applyInPandas(count, "pos1 int, pos2 int, c1 int, c2 int, n long")
    joint = found.groupBy("pos1", "pos2", "c1", "c2").agg(F.sum("n").alias("n"))
    w1, w2 = W.partitionBy("pos1", "pos2", "c1"), W.partitionBy("pos1", "pos2", "c2")
    cells = joint.withColumns({"n1": F.sum("n").over(w1), "n2": F.sum("n").over(w2)})
    total = F.sum("n")
    h = lambda over: F.log2(total) - F.sum(F.col("n") * F.log2(over)) / total
    out = cells.groupBy("pos1", "pos2").agg(h("n1").alias("h1"), h("n2").alias("h2"), h("n").alias("h12"))
    mi = F.greatest(F.col("h1") + F.col("h2") - F.col("h12"), F.lit(0.0))
    value = mi if stat == "mi" else F.when(F.col("h12") > 0, mi / F.col("h12")).otherwise(0.0)
    return out.select("pos1", "pos2", value.alias(stat))


# periodicity of a numeric signal, as array<double>
def auto_corr(signal: Column, low: int, high: int) -> Column:
    """array<double>: Σ x[i]·x[i+lag] / n for each lag from low to high."""
    n = F.size(signal)
    lags = F.sequence(F.lit(low), F.lit(high))
    return F.transform(lags, lambda lag: F.aggregate(F.zip_with(F.slice(signal, F.lit(1), F.greatest(n - lag, F.lit(0))), F.slice(signal, lag + 1, F.greatest(n - lag, F.lit(0))), lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v) / n)


def ipdft(signal: Column, low: int, high: int) -> Column:
    """array<double>: |Σ x[t]·exp(-2πi t/period)| for each whole period."""
    def power(period: Column) -> Column:
        part = lambda f: F.aggregate(F.transform(signal, lambda x, i: x * f(i * (2 * math.pi) / period)), F.lit(0.0), lambda acc, v: acc + v)
        re, im = part(F.cos), part(F.sin)
        return F.sqrt(re * re + im * im)

    return F.transform(F.sequence(F.lit(low), F.lit(high)), power)


def hybrid(signal: Column, low: int, high: int) -> Column:
    return F.zip_with(auto_corr(signal, low, high), ipdft(signal, low, high), lambda a, b: a * b)


def goertzel(signal: Column, period: float) -> Column:
    """Power at one period, by the second-order recursion."""
    coeff = 2 * math.cos(2 * math.pi / period)
    start = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
    step = lambda acc, x: F.struct((x + coeff * acc["a"] - acc["b"]).alias("a"), acc["a"].alias("b"))
    return F.aggregate(signal, start, step, lambda acc: F.sqrt(acc["a"] * acc["a"] + acc["b"] * acc["b"] - coeff * acc["a"] * acc["b"]))


def g_statistic(power: Column) -> Column:
    """Fisher's g: the largest share of the power."""
    return F.array_max(power) / F.aggregate(power, F.lit(0.0), lambda acc, v: acc + v)


def motif_signal(seq: Column, motifs: Sequence[str], k: int) -> Column:
    """1 where one of the motifs begins, else 0."""
    from ..functions.sequence import kmers

    return F.transform(kmers(seq, k), lambda w: F.when(w.isin(*motifs), 1.0).otherwise(0.0))


def mismatch_fraction(seq: Column, lag: int) -> Column:
    """The share of places whose character differs from that `lag` on."""
    n = F.length(seq) - lag
    pairs = F.zip_with(F.split(F.substring(seq, F.lit(1), n), ""), F.split(F.substring(seq, F.lit(lag + 1), n), ""), lambda a, b: F.when(a != b, 1.0).otherwise(0.0))
    return F.when(n > 0, F.aggregate(pairs, F.lit(0.0), lambda acc, v: acc + v) / n)


def block_bootstrap(df: DataFrame, key: str, signal: str, stat: Callable[[np.ndarray], float], block: int, reps: int, seed: int = 1) -> DataFrame:
    """(key, observed, pvalue): the share of block-resampled signals whose statistic is at least that observed."""
    ship(df.sparkSession)

    def run(frames):
        for f in frames:
            out = []
            for k, s in zip(f[key], f[signal]):
                x = np.asarray(s, dtype=float)
                seen = stat(x)
                r = np.random.default_rng(seed)
                hits = 0
                for _ in range(reps):
                    starts = r.integers(0, len(x), -(-len(x) // block))
                    at = (starts[:, None] + np.arange(block)).ravel()[: len(x)] % len(x)
                    hits += stat(x[at]) >= seen
                out.append((k, seen, hits / reps))
            yield pd.DataFrame(out, columns=[key, "observed", "pvalue"])

    return df.select(key, signal).mapInPandas(run, f"`{key}` {dict(df.dtypes)[key]}, observed double, pvalue double")


# two samples
def ks_statistic(df: DataFrame, value: str, sample: str, per_part: int = PER_PART) -> DataFrame:
    """(d, n, m): the largest distance of two samples' distribution functions (`sample`: a boolean), by distinct value."""
    t = df.groupBy(value).agg(F.count_if(F.col(sample)).alias("a"), F.count_if(~F.col(sample)).alias("b"))
    totals = F.broadcast(t.agg(F.sum("a").alias("n"), F.sum("b").alias("m")))
    run = totals_before(t, value, {"__a": "a", "__b": "b"}, per_part).crossJoin(totals).withColumn("d", F.abs((F.col("__a") + F.col("a")) / F.col("n") - (F.col("__b") + F.col("b")) / F.col("m")))
    return run.agg(F.max("d").alias("d"), F.max("n").alias("n"), F.max("m").alias("m"))


def mann_whitney(df: DataFrame, value: str, sample: str, per_part: int = PER_PART) -> DataFrame:
    """(u, n, m, z): U of the first sample with half counts for ties, by distinct value, and its normal score."""
    t = df.groupBy(value).agg(F.count_if(F.col(sample)).alias("a"), F.count_if(~F.col(sample)).alias("b"))
    run = totals_before(t, value, {"below": "b"}, per_part)
    out = run.agg(F.sum(F.col("a") * (F.col("below") + F.col("b") / 2)).alias("u"), F.sum("a").alias("n"), F.sum("b").alias("m"))
    n, m = F.col("n"), F.col("m")
    return out.withColumn("z", (F.col("u") - n * m / 2) / F.sqrt(n * m * (n + m + 1) / 12))


def kendall_tau(df: DataFrame, x: str, y: str, by: Sequence[str]) -> DataFrame:
    """(by…, tau, pvalue): tau-b of each group, a group to a task."""
    ship(df.sparkSession)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        from ..functions.special import kendall

        tau, p = kendall(g[x].tolist(), g[y].tolist())
        return pd.DataFrame([{k: g[k].iloc[0] for k in by} | {"tau": tau, "pvalue": p}])

    kinds = dict(df.dtypes)
    return df.groupBy(*by).applyInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in by) + ", tau double, pvalue double")


def theoretical_quantiles(n: int, dist: str = "normal") -> list[float]:
    """Quantiles at the n plotting positions."""
    from ..functions.special import normal_ppf

    a = 3 / 8 if n <= 10 else 0.5
    points = [(i - a) / (n + 1 - 2 * a) for i in range(1, n + 1)]
    return [normal_ppf(p) for p in points] if dist == "normal" else [-math.log(1 - p) for p in points] if dist == "exponential" else points
