"""Motif profiles in long form: (row, motif, n), (row, motif, p) and (row, motif, score)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.sequence import windows


def _row() -> WindowSpec:
    return W.partitionBy("row")


def to_freqs(counts: DataFrame, pseudocount: float = 0.0) -> DataFrame:
    """Proportions by row; the pseudocount goes to empty cells only."""
    n = F.when(F.col("n") == 0, F.lit(pseudocount)).otherwise(F.col("n").cast("double"))
    return counts.select("row", "motif", n.alias("n")).select("row", "motif", (F.col("n") / F.sum("n").over(_row())).alias("p"))


def full_grid(counts: DataFrame, motifs: str) -> DataFrame:
    """The counts with zeros for every motif (a letter of `motifs`) that a row lacks."""
    every = counts.select("row").distinct().select("row", F.explode(F.split(F.lit(motifs), "")).alias("motif"))
    return every.join(counts, ["row", "motif"], "left").select("row", "motif", F.coalesce("n", F.lit(0)).alias("n"))


def to_pssm(freqs: DataFrame, background: dict[str, float] | None = None) -> DataFrame:
    """log2 of the proportion over the background's (equal shares by default); a zero proportion scores as log2 1 = 0."""
    n = F.count(F.lit(1)).over(_row())
    bg = F.create_map(*[F.lit(x) for kv in background.items() for x in kv])[F.col("motif")] if background else 1 / n
    logp = F.when(F.col("p") > 0, F.log2("p")).otherwise(0.0)
    return freqs.select("row", "motif", (logp - F.log2(bg)).alias("score"))


def motif_totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("motif").agg(F.sum("n").alias("n"))


def row_totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("row").agg(F.sum("n").alias("n"))


def entropy_terms(freqs: DataFrame) -> DataFrame:
    return freqs.select("row", "motif", F.when(F.col("p") > 0, -F.col("p") * F.log2("p")).otherwise(0.0).alias("term"))


def entropy(freqs: DataFrame) -> DataFrame:
    return entropy_terms(freqs).groupBy("row").agg(F.sum("term").alias("entropy"))


def information(freqs: DataFrame) -> DataFrame:
    """log2 of the number of motifs less the entropy."""
    term = F.when(F.col("p") > 0, -F.col("p") * F.log2("p")).otherwise(0.0)
    return freqs.groupBy("row").agg((F.log2(F.count(F.lit(1))) - F.sum(term)).alias("information"))


def relative_entropy(freqs: DataFrame, background: dict[str, float] | None = None) -> DataFrame:
    """Of the background against each row: Σ b · (log2 b - log2 p), zero proportions as log2 1."""
    n = F.count(F.lit(1)).over(_row())
    b = F.create_map(*[F.lit(x) for kv in background.items() for x in kv])[F.col("motif")] if background else 1 / n
    term = b * (F.log2(b) - F.when(F.col("p") > 0, F.log2("p")).otherwise(0.0))
    return freqs.select("row", term.alias("t")).groupBy("row").agg(F.sum("t").alias("relative_entropy"))


def pairwise_jsd(freqs: DataFrame) -> DataFrame:
    """(row1, row2, jsd): rows meet by motif, so a pair's terms are one sum; H(mean) - mean H."""
    h = lambda p: F.when(p > 0, -p * F.log2(p)).otherwise(0.0)
    a = freqs.select(F.col("row").alias("row1"), "motif", F.col("p").alias("p1"))
    b = freqs.select(F.col("row").alias("row2"), "motif", F.col("p").alias("p2"))
    term = h((F.col("p1") + F.col("p2")) / 2) - (h(F.col("p1")) + h(F.col("p2"))) / 2
    return a.join(b, "motif").filter("row1 < row2").groupBy("row1", "row2").agg(F.greatest(F.sum(term), F.lit(0.0)).alias("jsd"))


def pairwise_jsm(freqs: DataFrame) -> DataFrame:
    return pairwise_jsd(freqs).select("row1", "row2", F.sqrt("jsd").alias("jsm"))


def score_seqs(seqs: DataFrame, pssm: DataFrame) -> DataFrame:
    """(name, start, score): the PSSM (a few rows, read to the driver as a map) at each place where it fits whole.

    Characters that aren't motifs add nothing; sequences shorter than the PSSM have no places.
    """
    cells = {(int(r["row"]), r["motif"]): float(r["score"]) for r in pssm.select("row", "motif", "score").collect()}
    width = max(p for p, _ in cells) + 1
    table = F.create_map(*[F.lit(x) for (p, m), s in cells.items() for x in (f"{p}{m}", s)])
    rows = seqs.select("name", F.posexplode(windows("seq", width, 1)).alias("start", "word"))
    scores = F.transform(F.split("word", ""), lambda c, i: F.coalesce(table[F.concat(i.cast("string"), c)], F.lit(0.0)))
    return rows.select("name", "start", F.aggregate(scores, F.lit(0.0), lambda acc, x: acc + x).alias("score"))


def ic_score(column_freqs: DataFrame, background: dict[str, float] | None = None, states: int = 4) -> DataFrame:
    """Σ over columns and motifs of f · log2(f / p)."""
    p: Column = F.create_map(*[F.lit(x) for kv in background.items() for x in kv])[F.col("motif")] if background else F.lit(1 / states)
    return column_freqs.agg(F.sum(F.when(F.col("p") > 0, F.col("p") * F.log2(F.col("p") / p)).otherwise(0.0)).alias("ic_score"))


def simulate_seq(freqs: DataFrame, seed: int = 0) -> DataFrame:
    """One character per row, by a hash of row and seed against the running sum of the proportions."""
    w = W.partitionBy("row").orderBy("motif")
    u = F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(1_000_003)) / 1_000_003
    acc = freqs.withColumn("__c", F.sum("p").over(w)).filter(F.col("__c") > u - 1e-12)
    one = acc.groupBy("row").agg(F.min_by("motif", "__c").alias("c"))
    return one.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "c"))), lambda x: x["c"]), "").alias("seq"))


def uniform_information(states: int) -> float:
    return math.log2(states)
