"""Pair models, stores written in several runs, fit statistics, feature updates, alphabets, writers."""

import math

import pytest
from pyspark.sql import functions as F

from strandline.functions import likelihood, moltype, pairwise, tree
from strandline.operators import alignment, features, models
from strandline.operators import table as O
from strandline.plans import apps
from strandline.sources import store


def paths(a, b):
    """All alignments of two short sequences, as lists of states."""
    if not a and not b:
        yield []
    if a and b:
        yield from ([("M", a[0], b[0]), *p] for p in paths(a[1:], b[1:]))
    if a:
        yield from ([("X", a[0], "-"), *p] for p in paths(a[1:], b))
    if b:
        yield from ([("Y", "-", b[0]), *p] for p in paths(a, b[1:]))


@pytest.mark.parametrize(("a", "b"), [("ACG", "AG"), ("A", "C"), ("ACGT", "ACG"), ("", "AC")])
def test_pair_model_against_all_alignments(a, b):
    m = pairwise.PairHMM()
    scores = {}
    for p in paths(a, b):
        now, total = "M", 0.0
        for state, x, y in p:
            step = m.steps().get((now, state))
            if step is None:
                break
            total += math.log(step) + (math.log(m.emit(x, y)) if state == "M" else math.log(0.25))
            now = state
        else:
            scores["".join(x for _, x, _ in p), "".join(y for _, _, y in p)] = total
    assert abs(m.forward(a, b) - math.log(sum(map(math.exp, scores.values())))) < 1e-9
    best, top, low = m.viterbi(a, b)
    assert abs(best - max(scores.values())) < 1e-9 and abs(scores[top, low] - best) < 1e-9


def test_store_in_several_runs(spark, tmp_path):
    path = str(tmp_path / "store")
    error = F.when(F.col("id") == "b", F.struct(*[F.lit("x").alias(n) for n in ("type", "origin", "message", "source")])).alias("error")
    members = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, v int")
    assert store.to_do(members, path).count() == 3
    store.write_attempt(members.filter("id <> 'c'").select("id", "v", error), path)
    assert sorted(r.id for r in store.to_do(members, path).collect()) == ["b", "c"]
    store.write_attempt(members.filter("id <> 'a'").select("id", "v", F.lit(None).cast(apps.ERROR).alias("error")), path)
    assert store.to_do(members, path).count() == 0
    assert sorted((r.id, r.status, r.attempt) for r in store.current(spark, path).collect()) == [("a", "completed", 1), ("b", "completed", 2), ("c", "completed", 1)]
    assert store.lock(spark, path, "me") and store.lock(spark, path, "me") and not store.lock(spark, path, "you") and store.holder(spark, path) == "me"
    assert not store.unlock(spark, path, "you") and store.unlock(spark, path, "me") and store.lock(spark, path, "you")


def test_fit_statistics(spark):
    aln = {"a": "ACGTACGTAC", "b": "ACGTACGTAA", "c": "ACGAACGTAC"}
    lf = likelihood.LikelihoodFunction(likelihood.get_model("JC69"), tree.parse_newick("(a:0.1,b:0.2,c:0.3);"), aln)
    stats = lf.statistics()
    assert [(e, v) for t, e, _, v in stats if t == "edge params"] == [("a", 0.1), ("b", 0.2), ("c", 0.3)]
    assert abs(sum(v for t, _, _, v in stats if t == "motif params") - 1) < 1e-12
    lf.shape = 0.5
    probs = lf.bin_probs()
    assert probs.shape == (len(lf.columns), 4) and abs(probs.sum(axis=1) - 1).max() < 1e-12 and (probs > 0).all()
    seqs = spark.createDataFrame([("f", n, s) for n, s in aln.items()], "family string, name string, seq string")
    fits = spark.createDataFrame([("f", "JC69", "(a:0.1,b:0.2,c:0.3);")], "family string, model string, newick string")
    assert sorted((r.table, r.name) for r in models.tabulate_stats(fits, seqs).collect())[:3] == [("edge params", "length")] * 3


def test_jc69_likelihood_of_two():
    same, diff, t = 9, 1, 0.3
    lf = likelihood.LikelihoodFunction(likelihood.get_model("JC69"), tree.parse_newick("(a:0.1,b:0.2);"), {"a": "ACGTACGTAC", "b": "ACGTACGTAA"})
    p = 0.25 + 0.75 * math.exp(-4 / 3 * t)
    assert abs(lf.lnl() - (same * math.log(p / 4) + diff * math.log((1 - p) / 12))) < 1e-6


def test_features_change(spark):
    rows = features.feature_rows(spark.createDataFrame([("s", "gene", "g", 5, 9), ("s", "gene", "h", 1, 2)], "seqid string, biotype string, name string, start long, stop long"))
    changes = spark.createDataFrame([("g", [(20, 30), (11, 12)])], "name string, spans array<struct<start:long,stop:long>>")
    out = {r.name: (r.start, r.stop, len(r.spans)) for r in features.update_record_spans(rows, changes).collect()}
    assert out == {"g": (11, 30, 2), "h": (1, 2, 1)}
    assert features.from_json(features.to_json(rows)).collect() == rows.collect()


def test_alphabets(spark):
    assert moltype.letters_with_gap("TCAG") == "TCAG-" == moltype.letters_with_gap("TCAG-")
    assert moltype.letters_subset("TCAG", "GA") == "AG" and moltype.letters_subset("TCAG", "GA", excluded=True) == "TC"
    one = spark.range(1).select(moltype.convert_indices(F.array(F.lit(0), F.lit(3), F.lit(4)), "TCAG-", "ACGT").alias("x")).first()
    assert one.x == [3, 2, 4]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("b", 2.0)], "k string, v double")
    for style in ("csv", "tsv", "json", "parquet"):
        O.write_table(df, str(tmp_path / style), style)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2 and spark.read.parquet(str(tmp_path / "parquet")).count() == 2
    with pytest.raises(ValueError):
        O.write_table(df, str(tmp_path / "x"), "x")
    apps.write_tabular(df.withColumn("error", F.when(F.col("k") == "a", F.lit("bad"))), str(tmp_path / "t"))
    assert spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "t")).count() == 1
    apps.write_json(df, str(tmp_path / "j"))
    assert sorted(apps.load_json(spark, str(tmp_path / "j"), df.schema).collect()) == sorted(df.collect())
    assert alignment.make_seqs(spark, {"a": "A"}).count() == 1
