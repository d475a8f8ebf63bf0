from pyspark.sql import functions as F

from strandline.operators.alignment import make_seqs
from strandline.sources import formats as X
from strandline.sources import store

ROWS = {"one": "ACGT-ACGTA", "two": "ACGTTACG-A"}


def test_alignment_formats_round_trip(spark):
    seqs = make_seqs(spark, ROWS)
    for name, write in X.WRITERS.items():
        text = write(seqs)
        assert {r[0]: r[2] for r in X.ALIGNED[name if name != "nexus" else "nex"](text)} == ROWS, name


def test_fasta_reader_and_writer(spark, tmp_path):
    p = str(tmp_path / "x.fasta")
    (tmp_path / "x.fasta").write_text(">a one two\nacg\nt-a\n>b\n\n>c\nGG\n")
    rows = {r.name: (r.label, r.seq) for r in X.read_fasta(spark, p).collect()}
    assert rows == {"a": ("a one two", "ACGT-A"), "b": ("b", ""), "c": ("c", "GG")}
    out = str(tmp_path / "out")
    X.write_fasta(make_seqs(spark, ROWS), out)
    assert {r.name: r.seq for r in X.read_fasta(spark, out).collect()} == ROWS
    assert X.load_seqs(spark, p, "fasta").count() == 3


def test_gff(spark):
    lines = spark.createDataFrame([("# c",), ("s\tsrc\tgene\t3\t9\t.\t+\t.\tID=g1;Parent=p",), ("s\tsrc\tCDS\t-9\t-3\t.\t-\t0\tID=c1",), ("s\tsrc\tCDS\t12\t14\t.\t-\t0\tID=c1",)], "value string")
    rows = X.parse_gff(lines)
    assert sorted((r.id, r.start, r.stop) for r in rows.collect()) == [("c1", 3, 10), ("c1", 11, 14), ("g1", 2, 9)]
    merged = {r["name"]: [tuple(s) for s in r.spans] for r in X.merged_gff(rows).collect()}
    assert merged == {"c1": [(3, 10), (11, 14)], "g1": [(2, 9)]}


GENBANK = """LOCUS       AB1 12 bp DNA
DEFINITION  a record
            of two lines.
SOURCE      human
  ORGANISM  Homo sapiens
FEATURES             Location/Qualifiers
     source          1..12
     CDS             complement(join(2..4,7..9))
                     /gene="abc"
                     /note="long
                     note"
ORIGIN
        1 acgtacgtac gt
//
"""


def test_records(spark):
    locus, definition, organism, seq, features = X.parse_genbank(GENBANK)[0]
    assert (locus, definition, organism, seq) == ("AB1", "a record of two lines.", "Homo sapiens", "ACGTACGTACGT")
    df = spark.createDataFrame([(locus, definition, organism, seq, features)], X.GENBANK)
    f = {r.biotype: r for r in X.genbank_features(df).collect()}
    assert f["CDS"].name == "abc" and f["CDS"].strand == -1 and [tuple(s) for s in f["CDS"].spans] == [(1, 4), (6, 9)]
    assert X.parse_nexus_trees("#NEXUS\nbegin trees;\ntranslate\n1 aa,\n2 bb;\ntree t1 = [&U] (1,2);\nend;")[0] == ("t1", "(aa,bb);")
    assert X.parse_jaspar("A [ 1 2 ]\nC [ 3 4 ]")[0] == (0, "A", 1.0)
    assert X.parse_cisbp("Pos\tA\tC\n1\t0.5\t0.5")[1] == (0, "C", 0.5)
    assert X.parse_embl("ID   X1; SV\nAC   P1;\nDE   thing\nOS   cow\nSQ   seq\n     acgt\n//")[0] == ("X1", "P1", "thing", "cow", "ACGT")


def test_lines(spark):
    psl = "\t".join(["1"] * 8 + ["+", "q"] + ["1"] * 3 + ["t"] + ["1"] * 4 + ["1,2,", "3,", "4,"])
    r = X.parse_psl(spark.createDataFrame([("psLayout",), (psl,)], "value string")).first()
    assert r.blocksizes == [1, 2] and r.qname == "q"
    cig = spark.createDataFrame([("AC--G",)], "s string").select(X.to_cigar(F.col("s")).alias("c"), X.cigar_gaps(X.to_cigar(F.col("s"))).alias("g")).first()
    assert cig.c == "2M2DM" and [tuple(x) for x in cig.g] == [(2, 2)]


def test_bedgraph(spark):
    df = spark.createDataFrame([("c", 0, 5, 1.001), ("c", 5, 9, 1.002), ("c", 9, 12, 2.0)], "chrom string, start long, stop long, value double")
    assert [r.value for r in X.bedgraph(df).collect()][1:] == ["c\t0\t9\t1.00", "c\t9\t12\t2.00"]


def test_store(spark, tmp_path):
    from strandline.plans.apps import ERROR

    df = spark.createDataFrame([(1, "x", None), (2, "y", ("ERROR", "o", "m", "s"))], "id int, text string, error struct<type:string,origin:string,message:string,source:string>")
    assert ERROR.names == ["type", "origin", "message", "source"]
    p = str(tmp_path / "r")
    store.write_results(df, p)
    back = store.read_results(spark, p)
    assert {r.status: r.number for r in store.describe(back).collect()} == {"completed": 1, "not_completed": 1}
    assert tuple(store.validate(back).first()) == (2, 0, 0)
    (tmp_path / "m.txt").write_text("hello")
    assert store.open_store(spark, str(tmp_path), "txt").first().id == "m.txt"
