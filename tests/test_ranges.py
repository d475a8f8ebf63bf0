"""Ordered operators whose rows are dealt to ranges, against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import intervals, ranges, stats


@pytest.mark.parametrize("per_part", [5, 10_000])
def test_merge_and_gaps(spark, per_part):
    r = np.random.default_rng(1)
    rows = [(str(k), int(a), int(a + n)) for k in range(3) for a, n in zip(r.integers(0, 900, 60), r.integers(1, 30, 60))] + [("0", 10, 700), (None, 1, 3), (None, 3, 9)]
    df = spark.createDataFrame(rows, "seqid string, start long, stop long")

    def plain(spans):
        out = []
        for a, b in sorted(spans):
            if out and a <= out[-1][1]:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
        return out

    want = {k: plain([x[1:] for x in rows if x[0] == k]) for k in {x[0] for x in rows}}
    got: dict = {}
    for x in intervals.merge(df, ["seqid"], per_part=per_part).collect():
        got.setdefault(x.seqid, []).append([x.start, x.stop])
    assert {k: sorted(v) for k, v in got.items()} == want
    assert sorted([x.start, x.stop] for x in intervals.merge(df, per_part=per_part).collect()) == plain([x[1:] for x in rows])
    free = sorted((x.start, x.stop) for x in intervals.gaps(df.filter("seqid = '1'"), ["seqid"], per_part=per_part).collect())
    ends = [0, *[b for _, b in want["1"]]]
    assert free == [(a, b) for a, b in zip(ends, [a for a, _ in want["1"]]) if b > a]
    assert intervals.merge(df.limit(0), ["seqid"]).count() == 0


@pytest.mark.parametrize("per_part", [7, 10_000])
def test_two_samples(spark, per_part):
    r = np.random.default_rng(2)
    x, y = r.integers(0, 60, 90), r.integers(10, 70, 70)
    df = spark.createDataFrame([(float(v), True) for v in x] + [(float(v), False) for v in y], "v double, s boolean")
    out = stats.mann_whitney(df, "v", "s", per_part).first()
    assert out.u == sum((a > b) + 0.5 * (a == b) for a in x for b in y) and (out.n, out.m) == (90, 70)
    d = max(abs(np.mean(x <= v) - np.mean(y <= v)) for v in range(80))
    assert abs(stats.ks_statistic(df, "v", "s", per_part).first().d - d) < 1e-12


def test_totals_before(spark):
    df = spark.range(40).select(F.col("id").cast("double").alias("v"), F.col("id").alias("a"))
    assert [r.t for r in ranges.totals_before(df, "v", {"t": "a"}, 6).orderBy("v").collect()] == [i * (i - 1) // 2 for i in range(40)]


def test_coevolution_by_blocks(spark):
    r = np.random.default_rng(3)
    seqs = ["".join(r.choice(list("ACGT-"), 9)) for _ in range(40)]
    long = spark.createDataFrame([(n, p, c) for n, s in enumerate(seqs) for p, c in enumerate(s)], "name int, pos int, ch string")
    whole = {(x.pos1, x.pos2): x.mi for x in stats.coevolution(long).collect()}
    parts = {(x.pos1, x.pos2): x.mi for x in stats.coevolution(long, rows=7, columns=4).collect()}
    assert len(whole) == 36 and whole.keys() == parts.keys() and all(abs(whole[k] - parts[k]) < 1e-9 for k in whole)
    pairs = [(a, b) for s in seqs for a, b in [(s[2], s[7])] if "-" not in (a, b)]
    h = lambda xs: -sum((n := xs.count(v) / len(xs)) * np.log2(n) for v in set(xs))
    assert abs(whole[2, 7] - max(0, h([a for a, _ in pairs]) + h([b for _, b in pairs]) - h(pairs))) < 1e-9


def test_permutation_pvalue(spark):
    even = spark.createDataFrame([("a", "x", 50), ("a", "y", 50), ("b", "x", 50), ("b", "y", 50)], "row string, col string, n long")
    far = spark.createDataFrame([("a", "x", 90), ("a", "y", 10), ("b", "x", 10), ("b", "y", 90)], "row string, col string, n long")
    assert stats.permutation_pvalue(even, 50).first().pvalue == 1.0 and stats.permutation_pvalue(far, 50).first().pvalue == 0.0
