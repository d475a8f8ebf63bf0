import math

import pytest
from pyspark.sql import functions as F

from strandline.functions import moltype as M
from strandline.functions import sequence as S
from strandline.functions.genetic_code import get_code
from strandline.operators import alignment as A
from strandline.operators import distance as D
from strandline.plans import registry


def one(spark, expression, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(expression.alias("x")).first().x


def test_complements_and_codes(spark):
    assert one(spark, M.DNA.rc("s"), s="AACGTRN-") == "-NYACGTT"
    assert one(spark, M.DNA.count_variants("s"), s="ARNB") == 2 * 4 * 3
    assert one(spark, M.DNA.count_degenerate("s"), s="ACRN-?") == 3
    assert one(spark, M.DNA.degap("s"), s="A-C?G") == "ACG"
    assert one(spark, M.DNA.strip_bad("s"), s="AXZC-") == "AC-"
    assert one(spark, M.DNA.is_valid("s"), s="AC-N?") and not one(spark, M.DNA.is_valid("s"), s="ACX")
    assert one(spark, M.DNA.can_match("a", "b"), a="RAN", b="AAC") and not one(spark, M.DNA.can_match("a", "b"), a="RA", b="CA")
    assert one(spark, M.RNA.can_pair("a", "b"), a="ACG", b="CGU") and one(spark, M.RNA.must_pair("a", "b"), a="ACG", b="CGU")
    assert M.DNA.to_regex("AR") == "A[AG]"
    assert set(one(spark, M.DNA.random_disambiguate("s"), s="NNRY")) <= set("ACGT")


def test_log_of_many_variants(spark):
    n, v = one(spark, F.array(M.DNA.log_variants("s"), F.ln(M.DNA.count_variants("s"))), s="ARNB-?")
    assert n == pytest.approx(v)
    assert one(spark, M.DNA.log_variants("s"), s="RNB" * 2000) == pytest.approx(2000 * math.log(2 * 4 * 3))


def test_every_text_has_a_log_of_variants(spark, tmp_path):
    spark.createDataFrame([(1, "n" * 2000), (2, "Run, by a bank"), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.name: r.v for r in registry.QUERIES["seq_variants_log"](spark, str(tmp_path)).collect()}
    assert got[1] == pytest.approx(2000 * math.log(4), abs=1e-4) and got[2] > 0 and got[3] == 0


def test_kmers_and_motifs(spark):
    assert one(spark, S.kmers("s", 3), s="ACGTN") == ["ACG", "CGT", "GTN"]
    assert one(spark, S.kmers("s", 3, M.DNA), s="ACGTNAC") == ["ACG", "CGT"]
    assert one(spark, S.motifs("s", 2), s="ACGTA") == ["AC", "GT"]
    assert one(spark, S.windows("s", 3, 2), s="ABCDEFG") == ["ABC", "CDE", "EFG"]
    assert one(spark, M.kmer_index(F.col("s"), "TCAG"), s="CAT") == 16 + 8
    assert one(spark, M.kmer_from_index(F.lit(24), 3, "TCAG"), s="") == "CAT"
    assert one(spark, S.kmers("s", 3), s="") == []


def test_gaps(spark):
    assert [tuple(x) for x in one(spark, S.gap_spans("s"), s="--AC-G--")] == [(0, 2), (2, 1), (3, 2)]
    assert [tuple(x) for x in one(spark, S.nongap_spans("s"), s="--AC-G--")] == [(2, 4), (5, 6)]
    assert one(spark, S.compose_gapped("p", S.gap_spans("s")), s="--AC-G--", p="ACG") == "--AC-G--"
    assert one(spark, S.align_index("s", F.lit(2)), s="--AC-G--") == 5
    assert one(spark, S.seq_index("s", F.lit(5)), s="--AC-G--") == 2
    assert one(spark, S.with_termini_unknown("s"), s="--A-C-") == "??A-C?"


def test_two_sequences(spark):
    assert one(spark, S.frac_same("a", "b"), a="ACGT", b="ACGA") == 0.75
    assert one(spark, S.frac_same_non_gaps("a", "b"), a="AC-T", b="A-GT") == 1.0
    assert one(spark, S.frac_same("a", "b"), a="", b="A") == 0.0


def test_translation(spark):
    gc = get_code(1)
    assert one(spark, gc.translate("s"), s="ATGTGGTAANNN---A") == "MW*X-"
    assert one(spark, gc.has_terminal_stop("s"), s="ATG---TA-A--")
    assert one(spark, gc.trim_stop("s"), s="ATGTAA") == "ATG"
    assert one(spark, gc.trim_stop("s"), s="ATGTA-A-") in ("ATG-----",)
    assert one(spark, gc.best_frame("s"), s="ATGTGGGCC") == 1
    assert get_code(2).table["TGA"] == "W" and get_code(2).table["AGA"] == "*"
    assert len(gc.fourfold_sets()) == 8
    assert [x.strand for x in one(spark, gc.six_frames("s"), s="ATGTGG")] == ["+"] * 3 + ["-"] * 3


@pytest.fixture
def aln(spark):
    return A.make_seqs(spark, {"a": "ACGT-A", "b": "ACCT-A", "c": "AC-TGA", "d": "TC-TGR"})


def seqs(df):
    return {r.name: r.seq for r in df.collect()}


def test_columns(aln):
    assert seqs(A.omit_gap_pos(aln, 0.4)) == {"a": "ACTA", "b": "ACTA", "c": "ACTA", "d": "TCTR"}
    assert seqs(A.no_degenerates(aln)) == {"a": "ACT", "b": "ACT", "c": "ACT", "d": "TCT"}
    assert A.majority_consensus(aln).first()[0] == "AC-TGA"
    assert A.iupac_consensus(aln).first()[0] == "WCSTGR"
    assert sorted(r.pos for r in A.variable_positions(aln).collect()) == [0, 2]
    assert {r.name: r.gaps for r in A.count_gaps_per_seq(aln).collect()} == {"a": 1, "b": 1, "c": 1, "d": 1}
    assert seqs(A.take_positions(aln, [1, 0, 0])) == {"a": "CAA", "b": "CAA", "c": "CAA", "d": "CTT"}
    assert seqs(A.degapped_relative_to(aln, "c")) == {"a": "ACT-A", "b": "ACT-A", "c": "ACTGA", "d": "TCTGR"}
    assert seqs(A.take_codon_positions(aln, (3,))) == {"a": "GA", "b": "CA", "c": "-A", "d": "-R"}
    assert seqs(A.filtered(aln, F.count_if(F.col("ch") == "-") == 0)) == {"a": "ACTA", "b": "ACTA", "c": "ACTA", "d": "TCTR"}


def test_rows(spark, aln):
    assert set(seqs(A.take_seqs(aln, ["d", "a"]))) == {"a", "d"}
    assert seqs(A.drop_duplicated_seqs(A.make_seqs(spark, {"x": "AA", "y": "AA", "z": "C"}))) == {"x": "AA", "z": "C"}
    assert [r.names for r in A.identical_sets(A.make_seqs(spark, {"x": "AN", "y": "AR"}), mask_degenerate=True).collect()] == [["x", "y"]]
    assert seqs(A.pad_seqs(A.make_seqs(spark, {"x": "A", "y": "ACG"}))) == {"x": "A--", "y": "ACG"}
    assert seqs(A.concat([aln, A.make_seqs(spark, {"a": "GG", "z": "TT"})], intersect=False))["z"] == "??????TT"
    with pytest.raises(ValueError):
        A.checked_alignment(A.make_seqs(spark, {"x": "A", "y": "AC"}))


def test_concat_of_unequal_names(spark, aln):
    other = A.make_seqs(spark, {"a": "GG", "z": "TT"})
    assert seqs(A.concat([aln, other])) == {"a": "ACGT-AGG"}
    assert set(seqs(A.concat([aln, other], intersect=False))) == set("abcdz")


def test_concat_of_a_whole_alignment(spark, tmp_path):
    spark.createDataFrame([(i, [-0.5] * 12) for i in range(5)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert seqs(registry.QUERIES["aln_concat"](spark, str(tmp_path))) == {i: "A" * 22 for i in range(5)}


def test_the_following_row_over_gaps_of_names(spark):
    names = [i * i + 7 for i in range(50)]
    df = spark.createDataFrame([(n, i, f"s{n}") for i, n in enumerate(names)], "name long, ord int, seq string").repartition(5)
    want = {n: f"s{m}" for n, m in zip(names, names[1:])} | {names[-1]: None}
    for per_part in (1, 7, 4096):
        assert {r.name: r.other for r in A.with_following(df, per_part).collect()} == want


def test_neighbours_of_sparse_ids(spark, tmp_path):
    spark.createDataFrame([(3, "acgt"), (10, "acga"), (25, "ttga")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.name: (r.same, r.diff) for r in registry.QUERIES["seq_neighbour_fractions"](spark, str(tmp_path)).collect()}
    assert got == {3: (0.75, 1), 10: (0.5, 2)}


def test_distances_of_copies_keep_every_name(spark, tmp_path):
    one_, two, three = [-0.5, -0.05, 0.05, 0.2] * 16, [-0.5, -0.05, 0.05, 0.05] * 16, [-0.05, -0.05, 0.05, 0.2] * 16
    rows = [(i, v) for i, v in enumerate([one_, two, one_, three, one_, two])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    pairs = {(i, j) for i in range(6) for j in range(i + 1, 6)}
    copies = {(i, j) for i, j in pairs if rows[i][1] == rows[j][1]}
    for q, same in (("hamming", 0), ("pdist", 0), ("jc69", 0), ("tn93", 0), ("paralinear", 0), ("percent_identity", 1)):
        got = {(r.name1, r.name2): r[2] for r in registry.QUERIES[f"dist_{q}"](spark, str(tmp_path)).collect()}
        assert set(got) == pairs, q
        assert all(got[p] == pytest.approx(same, abs=1e-9) for p in copies), q
    spark.createDataFrame([(1, one_), (2, one_)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "copies" / "embeddings.parquet"))
    assert registry.QUERIES["dist_max_pair"](spark, str(tmp_path / "copies")).first().dist == 0


def test_distances(spark):
    k = D.jaccard_dist(A.make_seqs(spark, {"s1": "ACGTA", "s2": "ACGTC"}), 2)
    assert k.first().dist == pytest.approx(0.4)
    assert D.approx_pdist(k).first().dist == pytest.approx(0.02597466474649073)
    assert D.approx_jc69(k).first().dist == pytest.approx(0.5716050390351726)
    aln = A.make_seqs(spark, {"a": "ACGTACGTAC" * 13, "b": "ACGTACGTAA" * 13, "c": "NCGT-CGTAA" * 13})
    d = {(r.name1, r.name2): r.dist for r in D.pdist(aln).collect()}
    assert d == pytest.approx({("a", "b"): 0.1, ("a", "c"): 0.125, ("b", "c"): 0.0})
    assert {(r.name1, r.name2): r.dist for r in D.hamming(aln).collect()}["a", "b"] == 13
    for f in (D.jc69, D.tn93, D.paralinear, D.logdet):
        assert f(aln).count() == 3
    g = {(r.name1, r.name2): r.dist for r in D.gap_dist(aln).collect()}
    assert g["a", "b"] == 0 and g["a", "c"] == 13 * 13
