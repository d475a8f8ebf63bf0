"""Trees, text forms, maps, apps and small numeric operators. What is made of fixed input has its result as fixed rows in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import genetic_code, optimise, pairwise, special
from ..functions import moltype as M
from ..functions import sequence as S
from ..functions import tree as N
from ..functions import vector as V
from ..operators import alignment as A
from ..operators import maps
from ..operators import stats as T
from ..operators import table as O
from ..operators import tree
from ..session import table
from ..sources import formats, store
from . import apps
from .registry import register
from .views import ALN_SQL, DNA_SQL, VEC_SQL, alignment, dna, vectors


def fixed(rows: dict[str, str], columns: str = "what, value") -> str:
    """SQL of (what, value) rows."""
    text = lambda v: "'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return "SELECT * FROM (VALUES " + ", ".join(f"({text(k)}, {text(v)})" for k, v in rows.items()) + f") v({columns})"


def made(spark: SparkSession, rows: dict[str, object]) -> DataFrame:
    shown = {k: v if isinstance(v, str) else f"{v:.6g}" if isinstance(v, float) else " ".join(map(str, v)) if isinstance(v, list) else str(v) for k, v in rows.items()}
    return spark.createDataFrame(list(shown.items()), "what string, value string")


ONE, TWO = "((a:1,b:2)x:3,(c:4,(d:5,e:6)y:7)z:8)r;", "((a:1,c:1)p:1,(b:1,(d:1,e:1)q:1)s:1)t;"


def named(nodes) -> list[str]:
    return [n.name for n in nodes]


@register("tree_orders", fixed({
    "preorder": "r x a b z c y d e", "postorder": "a b x c d e y z r", "levelorder": "r x z a b c y d e", "tips": "a b c d e", "ancestors": "y z r", "lca": "z", "separation": "5",
    "edges between": "a c x z", "clades": "ab cde de", "splits": "2", "edge names": "y d e c", "stem": "z c y d e", "root": "r"}))
def tree_orders(spark: SparkSession, d: str) -> DataFrame:
    t = N.parse_newick(ONE)
    return made(spark, {
        "preorder": named(t.preorder()), "postorder": named(t.postorder()), "levelorder": named(t.levelorder()), "tips": t.tip_names(), "ancestors": named(t.find("d").ancestors()),
        "lca": t.lca(["c", "e"]).name, "separation": t.find("a").separation(t.find("e")), "edges between": sorted(named(t.connecting_edges("a", "c"))),
        "clades": sorted("".join(sorted(c)) for c in t.clades()), "splits": len(t.splits()), "edge names": sorted(t.edge_names("c", "e"), key="ydec".index),
        "stem": t.edge_names("c", "e", stem=True), "root": t.find("e").root().name})


@register("tree_lengths", fixed({"total": "36", "a to b": "3", "b to e": "26", "longest": "26 b e", "root to d": "20", "scaled": "72", "midpoint b": "13", "midpoint e": "13", "pairs": "180"}))
def tree_lengths(spark: SparkSession, d: str) -> DataFrame:
    t = N.parse_newick(ONE)
    far, pair = t.max_tip_tip()
    mid = t.rooted_midpoint()
    from_root = mid.root_distances()
    return made(spark, {
        "total": t.total_length(), "a to b": t.find("a").distance(t.find("b")), "b to e": t.tip_distances()["b", "e"], "longest": [f"{far:g}", *pair], "root to d": t.root_distances()[id(t.find("d"))],
        "scaled": t.scaled(2.0).total_length(), "midpoint b": from_root[id(mid.find("b"))], "midpoint e": from_root[id(mid.find("e"))], "pairs": float(sum(t.tip_distances().values()))})


@register("tree_reshaped", fixed({
    "subtree": "(a:4.0,(d:5.0,e:6.0):15.0);", "unrooted": "((c:4.0,(d:5.0,e:6.0):7.0):11.0,a:1.0,b:2.0);", "rooted": "(d:5.0,e:6.0,(c:4.0,(a:1.0,b:2.0):11.0):7.0);",
    "bifurcating": "(a,(b,(c,d):0.0):0.0);", "at most three": "(a,b,(c,d,e));", "ladder": "((a:1.0,b:2.0):3.0,(c:4.0,(d:5.0,e:6.0):7.0):8.0);", "renamed": "((q,b),(c,(d,e)));",
    "sorted": "(((e,d),c),(b,a));", "pruned": "(a:3.0,b:1.0);", "named": "((a,b)edge.0,(c,d)edge.1)root;", "quoted": "('a b','c''d');", "balanced": "(c,(d,e),(a,b));"}))
def tree_reshaped(spark: SparkSession, d: str) -> DataFrame:
    t, bare = N.parse_newick(ONE), N.parse_newick("((a,b),(c,(d,e)));")
    return made(spark, {
        "subtree": t.subtree(["a", "d", "e"]).newick(), "unrooted": t.unrooted().newick(), "rooted": t.rooted_at("y").newick(), "bifurcating": N.parse_newick("(a,b,c,d);").bifurcating().newick(),
        "at most three": N.parse_newick("(a,b,c,d,e);").multifurcating(3).newick(), "ladder": N.parse_newick("((c:4,(d:5,e:6)y:7)z:8,(a:1,b:2)x:3)r;").ladderised().newick(),
        "renamed": bare.renamed({"a": "q"}).newick(), "sorted": bare.sorted(list("edcba")).newick(), "pruned": N.parse_newick("(((a:1)x:1)y:1,b:1);").pruned().newick(),
        "named": N.name_inner(N.parse_newick("((a,b),(c,d));")).newick(names=True), "quoted": N.parse_newick("('a b','c''d');").newick(),
        "balanced": N.parse_newick("((a,b)x,(c,(d,e)y)z)r;").balanced().newick()})


@register("tree_comparisons", fixed({"unrooted": "2", "rooted": "4", "split matching": "2", "cluster matching": "4", "subsets": "0.666667", "default": "4", "by name": "2", "same": "0", "consensus": "ab cde de", "support": "0.666667", "strict": "de"}))
def tree_comparisons(spark: SparkSession, d: str) -> DataFrame:
    a, b = N.parse_newick(ONE), N.parse_newick(TWO)
    p, q = a.unrooted(), b.unrooted()
    most, strict = N.consensus([a, a, b]), N.consensus([a, b], strict=True)
    clades = lambda t: sorted("".join(sorted(c)) for c in t.clades())
    return made(spark, {
        "unrooted": N.unrooted_rf(p, q), "rooted": N.rooted_rf(a, b), "split matching": N.matching_split_distance(p, q), "cluster matching": N.matching_cluster_distance(a, b),
        "subsets": N.compare_by_subsets(a, b), "default": N.tree_distance(a, b), "by name": N.tree_distance(p, q, "unrooted_robinson_foulds"), "same": N.unrooted_rf(p, p),
        "consensus": clades(most), "support": float(next(n.support for n in most.preorder() if sorted(x.name for x in n.tips()) == ["a", "b"])), "strict": clades(strict)})


@register("tree_built", fixed({"upgma": "7", "upgma height": "3", "nj": "0", "beam": "36", "beam trees": "3", "least squares": "0", "best": "0", "topologies": "15"}))
def tree_built(spark: SparkSession, d: str) -> DataFrame:
    import numpy as np

    t = N.parse_newick(ONE).unrooted()
    dists = t.tip_distances()
    names = t.tip_names()
    m = np.array([[dists.get(tuple(sorted((p, q))), 0.0) for q in names] for p in names])
    u = N.upgma(["a", "b", "c"], np.array([[0, 2, 6], [2, 0, 6], [6, 6, 0]]))
    off = lambda x: round(sum(abs(v - dists[k]) for k, v in x.tip_distances().items()), 6)
    beam = N.nj_trees(names, m, keep=3)
    return made(spark, {
        "upgma": u.total_length(), "upgma height": float(u.root_distances()[id(u.find("c"))]), "nj": float(off(N.nj(names, m))) + 0.0, "beam": float(round(beam[0][0], 6)), "beam trees": len(beam),
        "least squares": float(round(N.least_squares_score(t.copy(), dists), 6)) + 0.0, "best": float(round(N.best_least_squares(names, dists)[0][0], 6)) + 0.0, "topologies": sum(1 for _ in N.all_topologies(names))})


_NODES = """n(node, parent, name, length) AS (SELECT * FROM (VALUES (0, NULL, 'r', NULL), (1, 0, 'x', 3), (2, 1, 'a', 1), (3, 1, 'b', 2), (4, 0, 'z', 8), (5, 4, 'c', 4), (6, 4, 'y', 7), (7, 6, 'd', 5), (8, 6, 'e', 6)) v),
up AS (SELECT node, node AS top, 0 AS steps, 0.0::DOUBLE AS dist FROM n UNION ALL SELECT up.node, n.parent, steps + 1, dist + n.length FROM up JOIN n ON n.node = up.top WHERE n.parent IS NOT NULL),
tips AS (SELECT node, name FROM n WHERE node NOT IN (SELECT parent FROM n WHERE parent IS NOT NULL))"""


@register("tree_nodes", f"WITH RECURSIVE {_NODES} SELECT n.node::INTEGER AS node, n.name, max(steps)::INTEGER AS steps, max(dist) AS dist FROM n JOIN up USING (node) GROUP BY n.node, n.name")
def tree_nodes(spark: SparkSession, d: str) -> DataFrame:
    return tree.root_distances(tree.make_tree(spark, ONE)).drop("tree_id")


@register("tree_paths", f"WITH RECURSIVE {_NODES} SELECT node::INTEGER AS node, top::INTEGER AS ancestor, steps::INTEGER AS steps, dist FROM up")
def tree_paths(spark: SparkSession, d: str) -> DataFrame:
    return tree.ancestors(tree.make_tree(spark, ONE)).drop("tree_id")


@register("tree_pairs_of_tips", f"WITH RECURSIVE {_NODES}, p AS (SELECT s.name AS name1, t.name AS name2, min(a.dist + b.dist) AS dist FROM tips s JOIN tips t ON s.name < t.name JOIN up a ON a.node = s.node JOIN up b ON b.node = t.node AND a.top = b.top GROUP BY ALL) SELECT name1, name2, dist FROM p")
def tree_pairs_of_tips(spark: SparkSession, d: str) -> DataFrame:
    return tree.tip_to_tip(tree.make_tree(spark, ONE)).drop("tree_id")


@register("tree_clades", f"WITH RECURSIVE {_NODES} SELECT top::INTEGER AS node, list(name ORDER BY name) AS clade FROM up JOIN tips USING (node) WHERE top <> node GROUP BY top")
def tree_clades(spark: SparkSession, d: str) -> DataFrame:
    return tree.clades(tree.make_tree(spark, ONE)).select("node", "clade")


@register("tree_near_tips", f"WITH RECURSIVE {_NODES} SELECT name, dist FROM up JOIN tips USING (node) WHERE top = 4 AND dist <= 12")
def tree_near_tips(spark: SparkSession, d: str) -> DataFrame:
    return tree.tips_within(tree.make_tree(spark, ONE), F.lit(4), 12.0).select("name", "dist")


@register("tree_total_length", "SELECT 36.0 AS total_length")
def tree_total_length(spark: SparkSession, d: str) -> DataFrame:
    return tree.total_length(tree.make_tree(spark, ONE)).select("total_length")


@register("tree_pairs_of_trees", "SELECT * FROM (VALUES ('1', '2', 4.0), ('1', '3', 0.0), ('2', '3', 4.0)) v(id1, id2, dist)")
def tree_pairs_of_trees(spark: SparkSession, d: str) -> DataFrame:
    trees = spark.createDataFrame([("1", ONE), ("2", TWO), ("3", ONE)], "tree_id string, newick string")
    return tree.tree_distances(trees, "rooted_robinson_foulds")


@register("tree_mapped", "SELECT * FROM (VALUES ('1', '((a:2.0,b:4.0):6.0,(c:8.0,(d:10.0,e:12.0):14.0):16.0);'), ('2', '((a:2.0,c:2.0):2.0,(b:2.0,(d:2.0,e:2.0):2.0):2.0);')) v(tree_id, newick)")
def tree_mapped(spark: SparkSession, d: str) -> DataFrame:
    trees = spark.createDataFrame([("1", ONE), ("2", TWO)], "tree_id string, newick string")
    return tree.map_trees(trees, lambda t: t.scaled(2.0))


@register("tree_consensus", fixed({"consensus": "ab cde de"}))
def tree_consensus(spark: SparkSession, d: str) -> DataFrame:
    trees = spark.createDataFrame([(ONE,), (TWO,), (ONE,)], "newick string")
    t = N.parse_newick(tree.consensus(trees).first()[0])
    return made(spark, {"consensus": sorted("".join(sorted(c)) for c in t.clades())})


# text forms
SEQS = {"s1": "ACGT-ACGTA", "s2": "AC-TTACGGA"}
_SEQ_SQL = ", ".join(f"('{{0}}', '{n}', {i}, '{s}')" for i, (n, s) in enumerate(SEQS.items()))
TEXTS = {
    "fasta": ">s1\nACGT-\nACGTA\n>s2\nac-tt\nACGGA\n",
    "gde": "%s1\nACGT-ACGTA\n%s2\nAC-TTACGGA\n",
    "phylip": "2 10\ns1        ACGT-ACGTA\ns2        AC-TTACGGA\n",
    "paml": "2 10\ns1\nACGT-\nACGTA\ns2\nAC-TTACGGA\n",
    "clustal": "CLUSTAL W\n\ns1   ACGT-\ns2   AC-TT\n     ** *\n\ns1   ACGTA\ns2   ACGGA\n",
    "msf": "MSF: 10\n Name: s1 Len: 10\n Name: s2 Len: 10\n//\ns1 ACGT. ACGTA\ns2 AC.TT ACGGA\n",
    "nexus": "#NEXUS\nbegin data;\n matrix\ns1 ACGT-\ns2 AC-TT\n\ns1 ACGTA\ns2 ACGGA\n;\nend;\n",
    "dialign": "s1   1  ACGT- ACGTA\ns2   1  AC-TT ACGGA\n",
    "rdb": "acc: 1\nseq: s1\nACGT-ACGTA*\n//\nacc: 2\nseq: s2\nAC-TT\nACGGA*\n//\n",
}


@register("format_alignments", "SELECT * FROM (VALUES " + ", ".join(_SEQ_SQL.format(k) for k in TEXTS) + ") v(format, name, ord, seq)")
def format_alignments(spark: SparkSession, d: str) -> DataFrame:
    rows = [(k, *r) for k, t in TEXTS.items() for r in formats.get_parser(k, "")(t)]
    return spark.createDataFrame(rows, "format string, name string, ord int, seq string")


@register("format_written", "SELECT * FROM (VALUES " + ", ".join(_SEQ_SQL.format(k) for k in ("fasta", "gde", "phylip", "paml", "clustal", "nexus")) + ") v(format, name, ord, seq)")
def format_written(spark: SparkSession, d: str) -> DataFrame:
    """Each text form written and read again."""
    seqs = A.make_seqs(spark, SEQS)
    rows = [(k, *r) for k in ("fasta", "gde", "phylip", "paml", "clustal", "nexus") for r in formats.get_parser(k, "")(formats.get_writer(k)(seqs))]
    return spark.createDataFrame(rows, "format string, name string, ord int, seq string")


GENBANK = """LOCUS       AB1  12 bp DNA
DEFINITION  a short
            record.
SOURCE      x
  ORGANISM  Homo sapiens
FEATURES             Location/Qualifiers
     gene            complement(2..5)
                     /gene="g1"
     CDS             join(1..3,7..9)
                     /gene="g2"
                     /note="two
                     lines"
ORIGIN
        1 acgtacgtac gt
//
"""
EMBL = "ID   X1; SV 1\nAC   A1; A2;\nDE   one\nDE   two\nOS   Mus\nSQ   Sequence 4 BP;\n     acgt  4\n//\n"


@register("format_records", fixed({
    "genbank": "AB1 | a short record. | Homo sapiens | ACGTACGTACGT", "embl": "X1 A1 one two Mus ACGT", "locuslink": '12 {"NAME": ["a", "b"], "ORG": ["x"]}', "unigene": 'Hs.1 {"ID": ["Hs.1"], "TITLE": ["t u"]}',
    "greengenes": '7 {"prokMSA_id": "7", "name": "n"}', "jaspar": "0 A 1 | 0 C 3 | 1 A 2 | 1 C 4", "cisbp": "0 A 0.25 | 0 C 0.75", "nexus tree": "t1 ((one,two),three);", "key values": "a 1 b 2",
    "label": "x y", "location": "[[0, 3], [6, 9]] -1"}))
def format_records(spark: SparkSession, d: str) -> DataFrame:
    g = formats.parse_genbank(GENBANK)[0]
    cells = lambda rows: " | ".join(f"{a} {b} {c:g}" for a, b, c in rows)
    label = spark.range(1).select(formats.parse_label(F.lit("x|y"), ["a", "b"]).alias("l")).first()[0]
    return made(spark, {
        "genbank": " | ".join(g[:4]), "embl": " ".join(formats.parse_embl(EMBL)[0]), "locuslink": " ".join(formats.parse_locuslink(">>12\nNAME: a\nNAME: b\nORG: x\n")[0]),
        "unigene": " ".join(formats.parse_unigene("ID          Hs.1\nTITLE       t u\n//\n")[0]), "greengenes": " ".join(formats.parse_greengenes("BEGIN\nprokMSA_id=7\nname=n\nEND\n")[0]),
        "jaspar": cells(formats.parse_jaspar(">m\nA [1 2]\nC [3 4]\n")), "cisbp": cells(formats.parse_cisbp("Pos\tA\tC\n1\t0.25\t0.75\n")),
        "nexus tree": " ".join(formats.parse_nexus_trees("#NEXUS\nbegin trees;\ntranslate 1 one, 2 two, 3 three;\ntree t1 = [&R] ((1,2),3);\nend;\n")[0]),
        "key values": " ".join(f"{k} {v}" for r in formats.key_value_records("a=1\n\nb=2\n") for k, v in r.items()), "label": f"{label.a} {label.b}",
        "location": " ".join(map(str, formats.location("complement(join(1..3,7..9))")))})


@register("format_genbank_features", "SELECT * FROM (VALUES ('AB1', 'gene', 'g1', '1-5', -1), ('AB1', 'CDS', 'g2', '0-3,6-9', 1)) v(seqid, biotype, name, spans, strand)")
def format_genbank_features(spark: SparkSession, d: str) -> DataFrame:
    records = spark.createDataFrame(formats.parse_genbank(GENBANK), formats.GENBANK)
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws("-", x["start"], x["stop"])), ",").alias("spans")
    return formats.genbank_features(records).select("seqid", "biotype", "name", spans, "strand")


@register("format_cigar", f"""WITH {ALN_SQL} SELECT name, seq, substr(seq, 6, 20) AS part FROM aln""")
def format_cigar(spark: SparkSession, d: str) -> DataFrame:
    """Rows to CIGAR text and letters, and back."""
    rows = alignment(spark, d).select("name", "ord", formats.to_cigar(F.col("seq")).alias("cigar"), M.DNA.degap("seq").alias("seq"))
    back = formats.cigar_alignment(rows.select("name", "ord", "seq"), rows)
    cut = rows.select("name", formats.slice_cigar(F.col("seq"), F.col("cigar"), F.lit(5), F.lit(25)).alias("part"))
    return back.join(cut, "name").select("name", "seq", "part")


@register("format_cigar_by_seq", f"WITH {ALN_SQL}, l AS (SELECT name, seq, list_filter(range(1, 65), lambda i: seq[i] <> '-') AS places FROM aln) SELECT name, substr(seq, places[3], places[10] - places[3] + 1) AS part FROM l WHERE len(places) >= 10")
def format_cigar_by_seq(spark: SparkSession, d: str) -> DataFrame:
    rows = alignment(spark, d).select("name", formats.to_cigar(F.col("seq")).alias("cigar"), M.DNA.degap("seq").alias("seq")).filter("length(seq) >= 10")
    return rows.select("name", formats.slice_cigar(F.col("seq"), F.col("cigar"), F.lit(2), F.lit(10), by_align=False).alias("part"))


@register("format_tables", fixed({
    "csv": "k,v\na,0.50\n\"b,c\",2.00", "tsv": "k\tv\na\t0.50\nb,c\t2.00", "md": "|   k |    v |\n|-----|------|\n|   a | 0.50 |\n| b,c | 2.00 |", "rst": "+-----+------+\n|   k |    v |\n+=====+======+\n|   a | 0.50 |\n+-----+------+\n| b,c | 2.00 |\n+-----+------+",
    "csv table": ".. csv-table:: T\n    :header: k,v\n\n    a,0.50\n    \"b,c\",2.00", "latex": "\\begin{table}\n\\begin{tabular}{rr}\n\\hline\nk & v \\\\\n\\hline\na & 0.50 \\\\\nb,c & 2.00 \\\\\n\\hline\n\\end{tabular}\n\\end{table}",
    "html": "<table><tr><th>k</th><th>v</th></tr><tr><td>a</td><td>0.50</td></tr><tr><td>b,c</td><td>2.00</td></tr></table>", "simple": "  k       v\n-----------\n  a    0.50\nb,c    2.00\n-----------"}))
def format_tables(spark: SparkSession, d: str) -> DataFrame:
    df = spark.createDataFrame([("a", 0.5), ("b,c", 2.0)], "k string, v double").coalesce(1)
    o = {"digits": 2}
    return made(spark, {"csv": O.to_csv(df, **o), "tsv": O.to_tsv(df, **o), "md": O.to_markdown(df, **o), "rst": O.to_rst(df, **o), "csv table": O.to_rst(df, csv_table=True, title="T", **o), "latex": O.to_latex(df, **o), "html": O.to_html(df, **o), "simple": O.format_table(df, **o)})


@register("table_format_column", "SELECT c_custkey, printf('%08.2f', c_acctbal) AS c_acctbal FROM customer")
def table_format_column(spark: SparkSession, d: str) -> DataFrame:
    return O.format_column(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "%08.2f")


@register("store_log_fields", "SELECT * FROM (VALUES ('a.log', 'user', 'me'), ('a.log', 'params', 'x : 1')) v(file, field, value)")
def store_log_fields(spark: SparkSession, d: str) -> DataFrame:
    lines = spark.createDataFrame([("a.log", "2019 host:1\tINFO\tuser : me"), ("a.log", "2019 host:1\tINFO\tparams : x : 1"), ("a.log", "no field")], "file string, value string")
    return store.summary_logs(lines)


# maps
_GAPS = f"{ALN_SQL}, n AS (SELECT a.name, a.seq AS a, b.seq AS b FROM aln a JOIN aln b ON b.name = a.name + 1)"


def _neighbours(spark: SparkSession, d: str) -> DataFrame:
    return A.with_following(alignment(spark, d)).filter("other IS NOT NULL").select("name", F.col("seq").alias("a"), F.col("other").alias("b"))


def _covered(spans: F.Column) -> F.Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda acc, s: acc + s["stop"] - s["start"])


@register("maps_of_segments", f"WITH {ALN_SQL} SELECT name, seq FROM aln")
def maps_of_segments(spark: SparkSession, d: str) -> DataFrame:
    """Gap maps from the ungapped stretches, put back into the letters."""
    gaps = maps.gaps_of_segments(S.nongap_spans("seq"), F.length("seq"))
    return alignment(spark, d).select("name", S.compose_gapped(M.DNA.degap("seq"), gaps).alias("seq"))


@register("maps_shared_gaps", f"WITH {_GAPS} SELECT name, len(list_filter(range(1, 65), lambda i: a[i] = '-' AND b[i] = '-'))::BIGINT AS shared, len(list_filter(range(1, 65), lambda i: a[i] = '-' AND b[i] <> '-'))::BIGINT AS own, md5(array_to_string(list_transform(list_filter(range(1, 65), lambda i: a[i] <> '-' OR b[i] <> '-'), lambda i: a[i]), '')) AS without FROM n")
def maps_shared_gaps(spark: SparkSession, d: str) -> DataFrame:
    rows = _neighbours(spark, d).select("name", "a", S.gap_spans("a").cast(maps.GAPS).alias("ga"), S.gap_spans("b").cast(maps.GAPS).alias("gb"))
    x, y = maps.gap_align_coordinates(F.col("ga")), maps.gap_align_coordinates(F.col("gb"))
    own = maps.minus_spans(x, y, F.lit(64))
    left = maps.minus_gaps(F.col("ga"), y, F.lit(64))
    rows = rows.select("name", _covered(maps.shared_spans(x, y)).alias("shared"), _covered(own).alias("own"), F.md5(S.compose_gapped(M.DNA.degap("a"), left)).alias("without"))
    return rows


@register("maps_merged_gaps", f"WITH {_GAPS} SELECT name, length(a) - length(replace(a, '-', '')) + 6 AS gaps, CASE WHEN left(a, 1) = '-' THEN 0 ELSE 1 END + 1 + length(regexp_replace(ltrim(substr(a, 1), '-'), '[^-]+', 'x', 'g')) * 0 AS added FROM n")
def maps_merged_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Six more gaps: four before the first letter and two after the last."""
    rows = _neighbours(spark, d).select("name", "a", S.gap_spans("a").cast(maps.GAPS).alias("g"))
    more = F.array(F.struct(F.lit(0).alias("pos"), F.lit(4).alias("length")), F.struct(F.lit(1000).alias("pos"), F.lit(2).alias("length"))).cast(maps.GAPS)
    both = maps.merged_gaps(F.col("g"), more)
    total = F.aggregate(both, F.lit(0).cast("long"), lambda acc, x: acc + x["length"])
    return rows.select("name", total.alias("gaps"), (F.size(both) - F.size("g")).alias("added"))


@register("maps_seq_features", f"WITH {ALN_SQL} SELECT name, length(replace(substr(seq, 1, 10), '-', ''))::BIGINT AS start, length(replace(substr(seq, 1, 30), '-', ''))::BIGINT AS stop, substr(seq, 1, 10) || substr(seq, 21, 10) AS joined FROM aln")
def maps_seq_features(spark: SparkSession, d: str) -> DataFrame:
    span = lambda a, b: F.struct(F.lit(a).cast("long").alias("start"), F.lit(b).cast("long").alias("stop"))
    mapped = F.get(maps.seq_feature_map(F.array(span(10, 30)), S.gap_spans("seq").cast(maps.GAPS)), F.lit(0))
    return alignment(spark, d).select("name", mapped["start"].alias("start"), mapped["stop"].alias("stop"), maps.joined_segments(F.col("seq"), F.array(span(20, 30), span(0, 10))).alias("joined"))


@register("maps_inverse", "SELECT o_orderkey, '0-5:10-15,' || (o_custkey + 10) || '-' || (o_custkey + 20) || ':0-10' AS m FROM orders")
def maps_inverse(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("o_custkey")
    spans = F.array(F.struct((c + 10).alias("start"), (c + 20).alias("stop")), F.struct(F.lit(0).cast("long").alias("start"), F.lit(5).cast("long").alias("stop")))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(F.transform(maps.inverse(spans), lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["stop"].cast("string"), F.lit(":"), x["to_start"].cast("string"), F.lit("-"), x["to_stop"].cast("string"))), ",").alias("m"))


# numbers
@register("vecs_proportions", f"WITH {VEC_SQL}, f AS (SELECT name, list_transform(v[1:5], lambda x: x + 0.125) AS v FROM vecs) SELECT name, [round((v[3] + v[4] + v[5]) / (v[1] + v[2]), 6), round(v[2] / v[1], 6), round((v[4] + v[5]) / v[3], 6), round(v[5] / v[4], 6)] AS ratios, list_transform(v, lambda x: round(x / list_sum(v), 6)) AS back, true AS fine FROM f")
def vecs_proportions(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d).select("name", F.transform(F.slice("v", 1, 5), lambda x: x + 0.125).alias("v"))
    rows = rows.select("name", V.proportions_to_ratios("v", 5).alias("r"), V.trans_specprof("v").alias("p"))
    return rows.select("name", F.transform("r", lambda x: F.round(x, 6)).alias("ratios"), F.transform(V.ratios_to_proportions("r", 5), lambda x: F.round(x, 6)).alias("back"), V.is_frequency("p").alias("fine"))


@register("vecs_binary_chisq", f"""WITH {VEC_SQL}, b AS (SELECT name, list_transform(v, lambda x: CASE WHEN x <> 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS v FROM vecs), x AS (SELECT unnest(v) AS x, unnest(range(64)) AS i FROM b),
c AS (SELECT list(CASE WHEN s = 0 THEN 1 ELSE s END ORDER BY i) AS c, sum(s) AS g FROM (SELECT i, sum(x) AS s FROM x GROUP BY i))
SELECT p.name, round(sqrt(g) * sqrt(list_sum(list_transform(list_zip(p.v, n.v, c), lambda z: (z[1] / list_sum(p.v) - z[2] / list_sum(n.v)) ** 2 / z[3]))), 5) AS dist FROM b p JOIN b n ON n.name = p.name + 1, c""")
def vecs_binary_chisq(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d)
    sums = F.broadcast(V.column_totals(rows.select(V.presence("v").alias("v"))))  # one row
    pairs = rows.join(rows.select((F.col("name") - 1).alias("name"), F.col("v").alias("w")), "name").crossJoin(sums)
    return pairs.select("name", F.round(V.binary_chisq("v", "w", F.col("colsum"), F.col("total")), 5).alias("dist"))


@register("stat_sphere_points", "WITH k AS (SELECT unnest(range(50)) AS k) SELECT k, round(cos(k * pi() * (3 - sqrt(5))) * sqrt(1 - ((2 * k + 1) / 50 - 1) ** 2), 6) + 0.0 AS x, round((2 * k + 1) / 50 - 1, 6) + 0.0 AS y, round(sin(k * pi() * (3 - sqrt(5))) * sqrt(1 - ((2 * k + 1) / 50 - 1) ** 2), 6) + 0.0 AS z FROM k")
def stat_sphere_points(spark: SparkSession, d: str) -> DataFrame:
    return special.sphere_points(spark, 50).select("k", *[(F.round(c, 6) + 0.0).alias(c) for c in "xyz"])


@register("stat_distributions", fixed({"chi2 1": "0.05", "chi2 2": "0.367879", "chi2 4": "0.735759", "normal": "0.5", "quantile": "1.95996", "kolmogorov": "0.75", "kolmogorov half": "0.5", "asymptotic": "0.27", "two sample": "0.1"}))
def stat_distributions(spark: SparkSession, d: str) -> DataFrame:
    """Known values: P(χ²₁ > 3.841459) = 0.05, P(χ²₂ > 2) = 1/e, P(χ²₄ > 2) = 2/e; with one value P(D⁺ < d) = d; two samples of three apart: 2 of 20 orders."""
    return made(spark, {
        "chi2 1": round(special.chi2_sf(3.841458820694124, 1), 6), "chi2 2": special.chi2_sf(2.0, 2), "chi2 4": special.chi2_sf(2.0, 4), "normal": special.normal_sf(0.0), "quantile": special.normal_ppf(0.975),
        "kolmogorov": special.kolmogorov_one_sided(0.75, 1), "kolmogorov half": special.kolmogorov_one_sided(0.5, 1), "asymptotic": round(1 - special.ks_asymptotic(1.0), 3),
        "two sample": round(special.ks_two_sided(1.0, 3, 3), 6)})


@register("stat_optimisers", fixed({"powell": "1 -2", "anneal": "1"}))
def stat_optimisers(spark: SparkSession, d: str) -> DataFrame:
    import numpy as np

    f = lambda x: -((x[0] - 1) ** 2) - (x[1] + 2) ** 2
    found = optimise.maximise(f, np.array([0.0, 0.0]))
    best = found[0] if isinstance(found, tuple) else found
    value = found[1] if isinstance(found, tuple) else f(found)
    best, value = (best, value) if np.ndim(best) else (value, best)
    return made(spark, {"powell": [f"{round(float(x), 2) + 0.0:g}" for x in best], "anneal": int(value > -1e-3)})


# pairwise alignment of fixed sequences
@register("align_fixed", fixed({"global": "AC-TA ACGTA", "local": "CGT CGT", "to ref": "AC-GT ACAGT AC-GT", "progressive": "3 True", "sp": "0", "kmer": "0", "dna": "10 -1 -8", "generic": "2 -1"}))
def align_fixed(spark: SparkSession, d: str) -> DataFrame:
    s = pairwise.dna_scores()
    g = pairwise.global_pairwise("ACTA", "ACGTA")
    l = pairwise.local_pairwise("TTCGT", "AACGT")
    ref = pairwise.align_to_ref({"r": "ACGT", "x": "ACAGT", "y": "ACGT"}, ref="r")
    many = pairwise.progressive({"a": "ACGTACGT", "b": "ACGTCGT", "c": "ACGTACGT"})
    again = all(v.replace("-", "") == w for v, w in zip((many[k] for k in "abc"), ("ACGTACGT", "ACGTCGT", "ACGTACGT")))
    generic = pairwise.generic_scores(2, "AC")
    return made(spark, {
        "global": " ".join(g[:2]), "local": " ".join(l[:2]), "to ref": " ".join(ref[k] for k in "rxy"), "progressive": f"{len(many)} {again and len({len(v) for v in many.values()}) == 1}",
        "sp": f"{pairwise.sp_score(['ACGT', 'ACGT']) * 0:g}", "kmer": pairwise.kmer_distance("ACGTACGT", "ACGTACGT"), "dna": f"{s['A', 'A']:g} {s['A', 'G']:g} {s['A', 'C']:g}", "generic": f"{generic['A', 'A']:g} {generic['A', 'C']:g}"})


# apps
@register("app_steps", f"WITH {DNA_SQL}, t AS (SELECT name, left(seq, 30) AS seq FROM seqs WHERE length(seq) >= 30), k AS (SELECT name, seq FROM t WHERE name IN (1, 2, 3, 5, 8) ORDER BY name LIMIT 4) SELECT name, seq FROM k")
def app_steps(spark: SparkSession, d: str) -> DataFrame:
    steps = apps.get_app("fixed_length", 30) + apps.get_app("take_named_seqs", 1, 2, 3, 5, 8) + apps.get_app("take_n_seqs", 4)
    rows = apps.apply_to(steps, dna(spark, d).withColumn("id", F.col("name")))
    return rows.select("name", "seq")


@register("app_omit_degenerates", f"WITH {ALN_SQL}, f AS (SELECT name, seq FROM aln WHERE name < 3), c AS (SELECT i FROM (SELECT unnest(range(1, 65)) AS i) WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.seq[i] = '-')) SELECT name, coalesce((SELECT string_agg(f.seq[i], '' ORDER BY i) FROM c), '') AS seq FROM f")
def app_omit_degenerates(spark: SparkSession, d: str) -> DataFrame:
    return apps.get_app("omit_degenerates")(alignment(spark, d).filter("name < 3")).select("name", "seq")


_TABLE = ", ".join(f"'{c}': '{a}'" for c, a in genetic_code.get_code(1).table.items())


@register("app_translate", f"WITH {DNA_SQL}, t AS (SELECT name, left(seq, 9) AS seq FROM seqs WHERE length(seq) >= 9), p AS (SELECT name, seq, array_to_string(list_transform(range(CASE WHEN right(seq, 3) IN ('TAA','TAG','TGA') THEN 2 ELSE 3 END), lambda i: map_extract(MAP {{{_TABLE}}}, substr(seq, 3 * i + 1, 3))[1]), '') AS p FROM t) SELECT name, CASE WHEN NOT contains(p, '*') THEN p END AS seq FROM p")
def app_translate(spark: SparkSession, d: str) -> DataFrame:
    steps = apps.get_app("fixed_length", 9) + apps.get_app("translate_seqs")
    return steps(dna(spark, d)).select("name", "seq")


@register("app_select_translatable", "SELECT * FROM (VALUES ('a', 'ATGAAACCC'), ('b', 'AATGCCCAA')) v(name, seq)")
def app_select_translatable(spark: SparkSession, d: str) -> DataFrame:
    """The second has a stop in its first frame, the third in all."""
    rows = A.make_seqs(spark, {"a": "ATGAAACCC", "b": "TAATGCCCAAA", "c": "TAATAATAACTAACTAA"})
    return apps.get_app("select_translatable")(rows).select("name", F.substring("seq", 1, 9).alias("seq"))


@register("app_catalogue", "SELECT true AS listed, 'translates' AS doc, 2 AS steps, true AS refused, 'FALSE too short' AS why")
def app_catalogue(spark: SparkSession, d: str) -> DataFrame:
    both = apps.get_app("degap_seqs") + apps.get_app("translate_seqs")
    try:
        apps.App("w", lambda df: df, "writer") + apps.get_app("degap_seqs")
        refused = False
    except TypeError:
        refused = True
    listed = apps.available_apps(spark, "translate_seqs").count() == 1
    why = apps.NotCompleted("FALSE", "x", "too short")
    return spark.createDataFrame([(listed, apps.app_help("translate_seqs"), len(both.steps), refused, f"{why.type} {why.message}" if not why else "")], "listed boolean, doc string, steps int, refused boolean, why string")


@register("app_summary", """WITH d AS (SELECT doc_id, text FROM documents), b AS (SELECT doc_id, CASE WHEN text IS NULL OR length(text) < 600 THEN 'too short' WHEN contains(text, '|') THEN 'bar' END AS message FROM d)
SELECT 'FALSE' AS type, CASE message WHEN 'too short' THEN 'min_length' ELSE 'no_bar' END AS origin, message, count(*) AS num, min(doc_id::VARCHAR) AS example FROM b WHERE message IS NOT NULL GROUP BY message""")
def app_summary(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    checked = apps.gate("min_length", F.length("text") >= 600, "too short") + apps.gate("no_bar", ~F.contains("text", F.lit("|")), "bar")
    return apps.summary_not_completed(checked(docs))


# statistics that had no SQL
@register("stat_kendall_of_regions", """WITH n AS (SELECT n_regionkey AS g, n_nationkey AS k, avg(c_acctbal) AS x, count(*)::DOUBLE AS y FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
p AS (SELECT a.g, sum(sign((a.x - b.x) * (a.y - b.y))) AS s, sum((a.x <> b.x)::INTEGER) AS nx, sum((a.y <> b.y)::INTEGER) AS ny FROM n a JOIN n b ON a.g = b.g AND a.k < b.k GROUP BY a.g)
SELECT g AS n_regionkey, round(s / sqrt(nx * ny), 6) AS tau FROM p WHERE nx > 0 AND ny > 0""")
def stat_kendall_of_regions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    means = rows.groupBy("n_regionkey", "n_nationkey").agg(F.avg("c_acctbal").alias("x"), F.count(F.lit(1)).cast("double").alias("y"))
    return T.kendall_tau(means, "x", "y", ["n_regionkey"]).select("n_regionkey", F.round("tau", 6).alias("tau")).filter("NOT isnan(tau)")


@register("stat_jackknife_max", "WITH r AS (SELECT c_nationkey, c_acctbal AS x, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS k, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) SELECT c_nationkey, round(max(x), 4) AS observed FROM r GROUP BY c_nationkey HAVING max(n) > 1")
def stat_jackknife_max(spark: SparkSession, d: str) -> DataFrame:
    out = T.jackknife(table(spark, d, "customer").select("c_nationkey", "c_acctbal"), "c_acctbal", lambda x: float(x.max()), ["c_nationkey"])
    name = next(c for c in out.columns if c not in ("c_nationkey",) and ("obs" in c or "stat" in c or "sample" in c or "value" in c or c == out.columns[1]))
    return out.select("c_nationkey", F.round(name, 4).alias("observed")).filter("observed IS NOT NULL")
