"""Further column functions and row operators over whole driver tables: sequences, pairs of rows, amounts, spans, collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import moltype as M
from ..functions import sequence as S
from ..functions import vector as V
from ..functions.genetic_code import CODES, get_code
from ..operators import alignment as A
from ..operators import distance as D
from ..operators import features as X
from ..operators import intervals as I
from ..operators import profile as P
from ..operators import stats as T
from ..operators import table as O
from ..operators import vecdist
from ..session import table
from .registry import register
from .views import ALN_SQL, CODES_SQL, DNA_SQL, LONG_SQL, PAIR_SQL, SPAN_SQL, VEC_SQL, alignment, codes, dna, spans, vectors


# one sequence
@register("seq_ambiguity", f"""WITH {CODES_SQL} SELECT name, regexp_matches(seq, '[RYKMSWBDHVN]') AS any_code, coalesce(left(seq, 1), '') IN ('R','Y','K','M','S','W','B','D','H','V','N') AS first_is_code,
length(regexp_replace(seq, '[^RYKMSWBDHVN]', '', 'g'))::INTEGER AS codes FROM seqs""")
def seq_ambiguity(spark: SparkSession, d: str) -> DataFrame:
    m = M.DNA
    return codes(spark, d).select("name", m.has_ambiguity("seq").alias("any_code"), m.is_ambiguity(F.substring("seq", 1, 1)).alias("first_is_code"), m.count_ambiguous("seq").alias("codes"))


@register("seq_strip_bad", """WITH u AS (SELECT doc_id AS name, translate(coalesce(text, ''), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS s FROM documents)
SELECT name, md5(regexp_replace(s, '[^ACGTRYKMSWBDHVN?-]', '', 'g')) AS valid, md5(regexp_replace(s, '[^ACGTRYKMSWBDHVN]', '', 'g')) AS no_gaps FROM u""")
def seq_strip_bad(spark: SparkSession, d: str) -> DataFrame:
    text = F.translate(F.coalesce("text", F.lit("")), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return table(spark, d, "documents").select(F.col("doc_id").alias("name"), F.md5(M.DNA.strip_bad(text)).alias("valid"), F.md5(M.DNA.strip_bad_and_gaps(text)).alias("no_gaps"))


@register("seq_code_places", f"""WITH {CODES_SQL}, c AS (SELECT name, unnest(range(length(seq))) AS i, unnest(string_split(seq, '')) AS ch FROM seqs WHERE seq <> '')
SELECT s.name, count(i) FILTER (ch NOT IN ('A','C','G','T','-'))::INTEGER AS n, coalesce(sum(i) FILTER (ch NOT IN ('A','C','G','T','-')), 0)::BIGINT AS places, count(i) FILTER (ch = '-')::INTEGER AS gaps, coalesce(sum(i) FILTER (ch = '-'), 0)::BIGINT AS gap_places
FROM seqs s LEFT JOIN c USING (name) GROUP BY s.name""")
def seq_code_places(spark: SparkSession, d: str) -> DataFrame:
    at, gaps = M.DNA.degenerate_positions("seq", include_gap=False), S.gap_positions("seq")
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda acc, x: acc + x)
    return codes(spark, d).select("name", F.size(at).alias("n"), total(at).alias("places"), F.size(gaps).alias("gaps"), total(gaps).alias("gap_places"))


@register("seq_gap_vector", f"WITH {CODES_SQL} SELECT name, length(seq)::INTEGER AS n, (length(seq) - length(replace(seq, '-', '')))::INTEGER AS gaps, left(seq, 1) = '-' AS first FROM seqs WHERE seq <> ''")
def seq_gap_vector(spark: SparkSession, d: str) -> DataFrame:
    rows = codes(spark, d).filter("seq <> ''").select("name", M.DNA.gap_vector("seq").alias("g"))
    return rows.select("name", F.size("g").alias("n"), F.size(F.filter("g", lambda x: x)).alias("gaps"), F.get("g", F.lit(0)).alias("first"))


@register("seq_moltype_round_trip", f"WITH {DNA_SQL} SELECT name, md5(seq) AS dna, length(seq) - length(replace(seq, 'T', '')) AS u FROM seqs")
def seq_moltype_round_trip(spark: SparkSession, d: str) -> DataFrame:
    rows = dna(spark, d).select("name", M.to_rna("seq").alias("rna"))
    return rows.select("name", F.md5(M.to_dna("rna")).alias("dna"), M.chars_in(F.col("rna"), "U").cast("long").alias("u"))


@register("seq_to_indices", f"""WITH {DNA_SQL} SELECT name, (length(seq) - length(replace(seq, 'C', '')) + 2 * (length(seq) - length(replace(seq, 'A', ''))) + 3 * (length(seq) - length(replace(seq, 'G', ''))))::BIGINT AS total, true AS same FROM seqs""")
def seq_to_indices(spark: SparkSession, d: str) -> DataFrame:
    rows = dna(spark, d).withColumn("seq", F.substring("seq", F.lit(1), F.length("seq"))).withColumn("i", F.when(F.col("seq") == "", F.array().cast("array<int>")).otherwise(M.to_indices("seq", M.DNA.letters)))
    total = F.aggregate("i", F.lit(0).cast("long"), lambda acc, x: acc + x)
    return rows.select("name", total.alias("total"), (M.from_indices("i", M.DNA.letters) == F.col("seq")).alias("same"))


@register("seq_kmer_round_trip", f"""WITH {ALN_SQL}, k AS (SELECT name, unnest(range(62)) AS i, seq FROM aln), w AS (SELECT name, i, substr(seq, i + 1, 3) AS w FROM k)
SELECT w AS kmer, (16 * (strpos('TCAG', w[1]) - 1) + 4 * (strpos('TCAG', w[2]) - 1) + strpos('TCAG', w[3]) - 1)::BIGINT AS index, count(*) AS n FROM w WHERE NOT contains(w, '-') GROUP BY ALL""")
def seq_kmer_round_trip(spark: SparkSession, d: str) -> DataFrame:
    words = alignment(spark, d).select(F.explode(S.kmers("seq", 3, M.DNA)).alias("w"))
    numbered = words.groupBy(M.kmer_index(F.col("w"), M.DNA.letters).alias("index")).agg(F.count(F.lit(1)).alias("n"))
    return numbered.select(M.kmer_from_index("index", 3, M.DNA.letters).alias("kmer"), "index", "n")


@register("seq_with_termini", f"WITH {ALN_SQL} SELECT name, repeat('?', length(seq) - length(ltrim(seq, '-'))) || trim(seq, '-') || CASE WHEN trim(seq, '-') = '' THEN '' ELSE repeat('?', length(seq) - length(rtrim(seq, '-'))) END AS seq FROM aln")
def seq_with_termini(spark: SparkSession, d: str) -> DataFrame:
    return alignment(spark, d).select("name", S.with_termini_unknown("seq").alias("seq"))


@register("seq_motif_sizes", f"WITH {DNA_SQL} SELECT name, (length(seq) // 5)::INTEGER AS words, ((length(seq) + 4) // 5)::INTEGER AS all_words, md5(substr(seq, 1, 5 * (length(seq) // 5))) AS joined FROM seqs")
def seq_motif_sizes(spark: SparkSession, d: str) -> DataFrame:
    words = S.motifs("seq", 5)
    return dna(spark, d).select("name", F.size(words).alias("words"), F.size(S.motifs("seq", 5, remainder=True)).alias("all_words"), F.md5(F.array_join(words, "")).alias("joined"))


@register("seq_resolved_codes", "SELECT * FROM (VALUES ('A','A'),('AC','M'),('AG','R'),('AT','W'),('C','C'),('CG','S'),('CT','Y'),('G','G'),('GT','K'),('T','T'),('ACG','V'),('ACT','H'),('AGT','D'),('CGT','B'),('ACGT','N')) v(letters, code)")
def seq_resolved_codes(spark: SparkSession, d: str) -> DataFrame:
    """Each set of letters to its code and back."""
    m = M.DNA
    rows = spark.createDataFrame([("".join(sorted(m.letters_of(c))),) for c in [*"ACGT", *m.codes]], "letters string")
    return rows.select("letters", m.degenerate_from_letters(F.split("letters", "")).alias("code"))


@register("seq_strand_symmetric_motifs", "WITH b AS (SELECT unnest(['A','C','G','T']) AS x), m AS (SELECT p.x || q.x || r.x AS m FROM b p, b q, b r), t AS (SELECT m, reverse(translate(m, 'ACGT', 'TGCA')) AS rc FROM m) SELECT DISTINCT least(m, rc) AS motif, greatest(m, rc) AS other FROM t WHERE m <> rc")
def seq_strand_symmetric_motifs(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(M.DNA.strand_symmetric(3), "motif string, other string")


@register("seq_pattern_of_codes", f"WITH {DNA_SQL} SELECT name, len(regexp_extract_all(seq, '[AG][CT][ACGT]T'))::INTEGER AS n FROM seqs")
def seq_pattern_of_codes(spark: SparkSession, d: str) -> DataFrame:
    return dna(spark, d).select("name", F.size(F.regexp_extract_all("seq", F.lit(M.DNA.to_regex("RYNT")), F.lit(0))).alias("n"))


@register("seq_moltypes", "SELECT * FROM (VALUES ('dna', 4, 'TCAG'), ('rna', 4, 'UCAG'), ('protein', 21, 'ACDEFGHIKLMNPQRSTUVWY'), ('protein_with_stop', 22, 'ACDEFGHIKLMNPQRSTUVWY*'), ('text', 52, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz')) v(name, n_letters, letters)")
def seq_moltypes(spark: SparkSession, d: str) -> DataFrame:
    return M.available_moltypes(spark)


# genetic codes: every code, as the public table has it
_CODE_ROWS = ", ".join(f"({c.id}, '{c.name}', '{''.join(c.amino)}', '{c.start_map}')" for c in CODES.values())
_CODONS_SQL = f"""b AS (SELECT unnest(['T','C','A','G']) AS x, unnest([0, 1, 2, 3]) AS n), codons AS (SELECT p.x || q.x || r.x AS codon, 16 * p.n + 4 * q.n + r.n AS place FROM b p, b q, b r),
codes AS (SELECT * FROM (VALUES {_CODE_ROWS}) v(code_id, name, amino, starts)), t AS (SELECT code_id, codon, amino[place + 1] AS aa, starts[place + 1] = 'M' AS is_start, amino[place + 1] = '*' AS is_stop FROM codes, codons)"""


def _codons(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a + b + c,) for a in "TCAG" for b in "TCAG" for c in "TCAG"], "codon string")


@register("seq_start_codons", f"WITH {_CODONS_SQL} SELECT code_id, codon, aa, is_start, is_stop FROM t")
def seq_start_codons(spark: SparkSession, d: str) -> DataFrame:
    per_code = F.array(*[F.struct(F.lit(k).alias("code_id"), c.codon_amino(F.col("codon")).alias("aa"), c.is_start("codon").alias("is_start"), c.is_stop("codon").alias("is_stop")) for k, c in CODES.items()])
    return _codons(spark).coalesce(1).select("codon", F.explode(per_code).alias("c")).select("c.code_id", "codon", "c.aa", "c.is_start", "c.is_stop")


@register("seq_available_codes", f"WITH {_CODONS_SQL} SELECT code_id::INTEGER AS code_id, name FROM codes")
def seq_available_codes(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.genetic_code import available_codes

    return available_codes(spark)


@register("seq_codon_table", f"WITH {_CODONS_SQL} SELECT aa AS amino, string_agg(codon, ',' ORDER BY c.place) AS codons FROM t JOIN codons c USING (codon) WHERE code_id = 2 GROUP BY aa")
def seq_codon_table(spark: SparkSession, d: str) -> DataFrame:
    return get_code("Vertebrate Mitochondrial").to_table(spark)


@register("seq_sense_codons", f"WITH {_CODONS_SQL} SELECT codon, row_number() OVER (ORDER BY place) - 1 AS index FROM t JOIN codons USING (codon) WHERE code_id = 1 AND NOT is_stop")
def seq_sense_codons(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(c, i) for i, c in enumerate(get_code(1).sense)], "codon string, index long")


@register("seq_fourfold", f"WITH {_CODONS_SQL} SELECT left(codon, 2) AS head, min(aa) AS aa FROM t WHERE code_id = 1 GROUP BY 1 HAVING count(DISTINCT aa) = 1")
def seq_fourfold(spark: SparkSession, d: str) -> DataFrame:
    gc = get_code()
    return spark.createDataFrame([(s[0][:2], gc.table[s[0]]) for s in gc.fourfold_sets()], "head string, aa string")


@register("seq_codons_of_protein", f"WITH {DNA_SQL} SELECT name, len(regexp_extract_all(seq, '(ATG)(TTT|TTC)'))::INTEGER AS n FROM seqs")
def seq_codons_of_protein(spark: SparkSession, d: str) -> DataFrame:
    return dna(spark, d).select("name", F.size(F.regexp_extract_all("seq", F.lit(get_code().to_regex("MF")), F.lit(0))).alias("n"))


_TRANSLATED = ", ".join(f"'{c}': '{a}'" for c, a in get_code(1).table.items())


@register("seq_get_translation", f"""WITH {DNA_SQL}, k AS (SELECT name, CASE WHEN length(seq) % 3 = 0 AND right(seq, 3) IN ('TAA','TAG','TGA') THEN left(seq, length(seq) - 3) ELSE seq END AS seq FROM seqs),
p AS (SELECT name, array_to_string(list_transform(range(length(seq) // 3), lambda i: map_extract(MAP {{{_TRANSLATED}}}, substr(seq, 3 * i + 1, 3))[1]), '') AS p FROM k)
SELECT name, md5(CASE WHEN NOT contains(p, '*') THEN p END) AS protein, md5(p) AS with_stops FROM p""")
def seq_get_translation(spark: SparkSession, d: str) -> DataFrame:
    gc = get_code(1)
    return dna(spark, d).select("name", F.md5(gc.get_translation("seq")).alias("protein"), F.md5(gc.get_translation("seq", include_stop=True)).alias("with_stops"))


# pairs of rows: each row and the next
_NEXT = f"{ALN_SQL}, n AS (SELECT a.name, a.seq AS a, b.seq AS b, list_transform(range(1, 65), lambda i: a.seq[i] || b.seq[i]) AS z FROM aln a JOIN aln b ON b.name = a.name + 1)"


def _following(spark: SparkSession, d: str) -> DataFrame:
    return A.with_following(alignment(spark, d)).filter("other IS NOT NULL").select("name", F.col("seq").alias("a"), F.col("other").alias("b"))


@register("seq_pair_fractions", f"""WITH {_NEXT}, c AS (SELECT name, len(list_filter(z, lambda x: x[1] <> x[2])) AS d, len(list_filter(z, lambda x: (x[1] = '-') <> (x[2] = '-'))) AS g, len(list_filter(z, lambda x: NOT contains(x, '-'))) AS v,
len(list_filter(z, lambda x: NOT contains(x, '-') AND x[1] <> x[2])) AS vd, len(list_filter(z, lambda x: x IN ('AG', 'GA', 'CT', 'TC', 'AA'))) AS s FROM n)
SELECT name, round(d / 64, 8) AS diff, round(g / 64, 8) AS diff_gaps, round(CASE WHEN v > 0 THEN (v - vd) / v ELSE 0 END, 8) AS same_non_gaps, round(CASE WHEN v > 0 THEN vd / v ELSE 0 END, 8) AS diff_non_gaps, round(s / 64, 8) AS alike FROM c""")
def seq_pair_fractions(spark: SparkSession, d: str) -> DataFrame:
    alike = [("A", "G"), ("G", "A"), ("C", "T"), ("T", "C"), ("A", "A")]
    return _following(spark, d).select(
        "name", F.round(S.frac_diff("a", "b"), 8).alias("diff"), F.round(S.frac_diff_gaps("a", "b"), 8).alias("diff_gaps"), F.round(S.frac_same_non_gaps("a", "b"), 8).alias("same_non_gaps"),
        F.round(S.frac_diff_non_gaps("a", "b"), 8).alias("diff_non_gaps"), F.round(S.frac_similar("a", "b", alike), 8).alias("alike"))


@register("seq_matrix_distance", f"WITH {_NEXT} SELECT name, list_sum(list_transform(z, lambda x: CASE WHEN x[1] = x[2] THEN 0.0::DOUBLE WHEN contains(x, '-') THEN 2.5::DOUBLE WHEN x IN ('AG', 'GA', 'CT', 'TC') THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END)) AS dist FROM n")
def seq_matrix_distance(spark: SparkSession, d: str) -> DataFrame:
    near = {"AG", "GA", "CT", "TC"}
    scores = {(x, y): 0.0 if x == y else 2.5 if "-" in (x, y) else 1.0 if x + y in near else 2.0 for x in "ACGT-" for y in "ACGT-"}
    return _following(spark, d).select("name", S.matrix_distance("a", "b", scores).alias("dist"))


@register("seq_pairing", f"""WITH {_NEXT}, t AS (SELECT name, list_transform(range(1, 4), lambda i: a[i] || b[i]) AS m, list_transform(range(1, 4), lambda i: a[i] || b[4 - i]) AS p FROM n)
SELECT name, len(list_filter(m, lambda x: x[1] = x[2])) = 3 AS can_match, len(list_filter(p, lambda x: x IN ('AT','TA','CG','GC','GT','TG'))) = 3 AS can_pair,
len(list_filter(p, lambda x: x IN ('AT','TA','CG','GC'))) < 3 AS can_mispair, len(list_filter(p, lambda x: x IN ('AT','TA','CG','GC'))) = 3 AS must_pair FROM t""")
def seq_pairing(spark: SparkSession, d: str) -> DataFrame:
    """The first three places of neighbours."""
    rows = _following(spark, d).select("name", F.substring("a", 1, 3).alias("a"), F.substring("b", 1, 3).alias("b"))
    m = M.DNA
    return rows.select("name", m.can_match("a", "b").alias("can_match"), m.can_pair("a", "b").alias("can_pair"), m.can_mispair("a", "b").alias("can_mispair"), m.must_pair("a", "b").alias("must_pair"))


# amounts
_DOT = "list_sum(list_transform(list_zip(a, b), lambda z: {0}))"
_PRESENT = "list_transform({0}, lambda x: CASE WHEN x <> 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"
_BIN = f"q AS (SELECT name1, name2, {_PRESENT.format('a')} AS a, {_PRESENT.format('b')} AS b FROM pairs)"


@register("vecdist_binary_euclidean", f"WITH {PAIR_SQL}, {_BIN} SELECT name1, name2, round(sqrt({_DOT.format('(z[1] - z[2]) * (z[1] - z[2])')}), 5) AS dist FROM q")
def vecdist_binary_euclidean(spark: SparkSession, d: str) -> DataFrame:
    return vecdist.pairwise(vectors(spark, d), "binary_euclidean").withColumn("dist", F.round("dist", 5))


@register("vecdist_binary_chord", f"WITH {PAIR_SQL}, {_BIN} SELECT name1, name2, round(sqrt(greatest(2 - 2 * {_DOT.format('z[1] * z[2]')} / sqrt(list_sum(a) * list_sum(b)), 0)), 5) AS dist FROM q")
def vecdist_binary_chord(spark: SparkSession, d: str) -> DataFrame:
    return vecdist.pairwise(vectors(spark, d), "binary_chord").withColumn("dist", F.round("dist", 5))


_R = f"({{n}} * {_DOT.format('z[1] * z[2]')} - list_sum(a) * list_sum(b)) / sqrt(({{n}} * list_sum(list_transform(a, lambda x: x * x)) - list_sum(a) ** 2) * ({{n}} * list_sum(list_transform(b, lambda x: x * x)) - list_sum(b) ** 2))".replace("{n}", "64")


@register("vecdist_binary_pearson", f"WITH {PAIR_SQL}, {_BIN} SELECT name1, name2, round(CASE WHEN list_min(a) = list_max(a) AND list_min(b) = list_max(b) THEN 0 WHEN list_min(a) = list_max(a) OR list_min(b) = list_max(b) THEN 1 ELSE 1 - {_R} END, 5) AS dist FROM q")
def vecdist_binary_pearson(spark: SparkSession, d: str) -> DataFrame:
    return vecdist.pairwise(vectors(spark, d), "binary_pearson").withColumn("dist", F.round("dist", 5))


@register("vecs_pearson_of_next", f"WITH {VEC_SQL}, q AS (SELECT p.name, p.v AS a, n.v AS b FROM vecs p JOIN vecs n ON n.name = p.name + 1) SELECT name, round(1 - {_R}, 6) AS dist FROM q")
def vecs_pearson_of_next(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d)
    other = rows.select((F.col("name") - 1).alias("name"), F.col("v").alias("w"))
    return rows.join(other, "name").select("name", F.round(V.pearson("v", "w"), 6).alias("dist"))


_JOINT = f"{VEC_SQL}, q AS (SELECT p.name, p.v AS a, n.v AS b FROM vecs p JOIN vecs n ON n.name = p.name + 1)"


def _next_vectors(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d)
    return rows.join(rows.select((F.col("name") - 1).alias("name"), F.col("v").alias("w")), "name")


@register("vecs_abund_jaccard", f"""WITH {_JOINT}, s AS (SELECT name, {_DOT.format('CASE WHEN z[2] > 0 THEN z[1] ELSE 0 END')} / list_sum(a) AS u, {_DOT.format('CASE WHEN z[1] > 0 THEN z[2] ELSE 0 END')} / list_sum(b) AS v FROM q)
SELECT name, round(CASE WHEN u = 0 AND v = 0 THEN 1 ELSE 1 - u * v / (u + v - u * v) END, 6) AS dist FROM s""")
def vecs_abund_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return _next_vectors(spark, d).select("name", F.round(V.abund_jaccard("v", "w"), 6).alias("dist"))


_RANKS = "list_transform({0}, lambda x: list_sum(list_transform({0}, lambda y: CASE WHEN y < x THEN 1.0::DOUBLE WHEN y = x THEN 0.5::DOUBLE ELSE 0 END)) + 0.5)"


@register("vecs_spearman_approx", f"WITH {_JOINT}, r AS (SELECT name, {_RANKS.format('a')} AS a, {_RANKS.format('b')} AS b FROM q) SELECT name, round(6 * {_DOT.format('(z[1] - z[2]) * (z[1] - z[2])')} / (64.0::DOUBLE * (64 * 64 - 1)), 6) AS dist FROM r")
def vecs_spearman_approx(spark: SparkSession, d: str) -> DataFrame:
    ranked = _next_vectors(spark, d).select("name", V.average_ranks("v").alias("v"), V.average_ranks("w").alias("w"))
    return ranked.select("name", F.round(V.spearman_approx("v", "w"), 6).alias("dist"))


@register("vecs_gower", f"""WITH {_JOINT}, x AS (SELECT unnest(v) AS x, unnest(range(64)) AS i FROM vecs), r AS (SELECT list(CASE WHEN r = 0 THEN 1 ELSE r END ORDER BY i) AS r FROM (SELECT i, max(x) - min(x) AS r FROM x GROUP BY i))
SELECT name, round(list_sum(list_transform(list_zip(a, b, r), lambda z: abs(z[1] - z[2]) / z[3])), 6) AS dist FROM q, r""")
def vecs_gower(spark: SparkSession, d: str) -> DataFrame:
    ranges = F.broadcast(V.column_ranges(vectors(spark, d)))  # one row
    return _next_vectors(spark, d).crossJoin(ranges).select("name", F.round(V.gower("v", "w", F.col("ranges")), 6).alias("dist"))


_SHARE = "list_transform({0}, lambda x: x / list_sum({0}))"
_ENTROPY = "list_sum(list_transform({0}, lambda x: CASE WHEN x > 0 THEN -x * log2(x) ELSE 0 END))"


@register("vecs_jsm", f"WITH {_JOINT}, s AS (SELECT name, {_SHARE.format('a')} AS a, {_SHARE.format('b')} AS b FROM q), m AS (SELECT name, a, b, list_transform(list_zip(a, b), lambda z: (z[1] + z[2]) / 2) AS m FROM s) SELECT name, round(sqrt(greatest({_ENTROPY.format('m')} - ({_ENTROPY.format('a')} + {_ENTROPY.format('b')}) / 2, 0)), 6) AS dist FROM m")
def vecs_jsm(spark: SparkSession, d: str) -> DataFrame:
    shares = _next_vectors(spark, d).select("name", V.trans_specprof("v").alias("v"), V.trans_specprof("w").alias("w"))
    return shares.select("name", F.round(V.jsm("v", "w"), 6).alias("dist"))


_FULL = "list_transform(embedding, lambda x: abs(x::DOUBLE) + 0.01)"


def _full(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("name"), F.transform("embedding", lambda x: F.abs(x.cast("double")) + 0.01).alias("v"))


@register("vecs_alr", f"WITH e AS (SELECT vec_id AS name, {_FULL} AS v FROM embeddings) SELECT name, list_transform(v[1:63], lambda x: round(ln(x / v[64]), 6) + 0.0) AS alr, list_transform(v, lambda x: round(x / list_sum(v), 6)) AS back FROM e")
def vecs_alr(spark: SparkSession, d: str) -> DataFrame:
    rows = _full(spark, d).select("name", V.alr("v").alias("a"))
    return rows.select("name", F.transform("a", lambda x: F.round(x, 6) + 0.0).alias("alr"), F.transform(V.alr_inv("a"), lambda x: F.round(x, 6)).alias("back"))


@register("vecs_aitchison", f"""WITH e AS (SELECT vec_id AS name, {_FULL} AS v FROM embeddings), c AS (SELECT name, list_transform(v, lambda x: ln(x) - list_sum(list_transform(v, lambda y: ln(y))) / 64) AS c FROM e)
SELECT p.name, round(sqrt(list_sum(list_transform(list_zip(p.c, n.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 5) AS dist FROM c p JOIN c n ON n.name = p.name + 1""")
def vecs_aitchison(spark: SparkSession, d: str) -> DataFrame:
    rows = _full(spark, d)
    return rows.join(rows.select((F.col("name") - 1).alias("name"), F.col("v").alias("w")), "name").select("name", F.round(V.aitchison("v", "w"), 5).alias("dist"))


@register("vecs_multiplicative_replacement", f"""WITH {VEC_SQL}, m AS (SELECT name, v, list_min(list_filter(v, lambda x: x > 0)) * 0.01::DOUBLE AS d FROM vecs), r AS (SELECT name, list_transform(v, lambda x: CASE WHEN x < d THEN x + d ELSE x END) AS r FROM m)
SELECT name, list_transform(r, lambda x: round(x / list_sum(r), 7)) AS v FROM r""")
def vecs_multiplicative_replacement(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).select("name", F.transform(V.multiplicative_replacement("v"), lambda x: F.round(x, 7)).alias("v"))


@register("vecs_transforms", f"""WITH {VEC_SQL}, x AS (SELECT unnest(v) AS x, unnest(range(64)) AS i FROM vecs), c AS (SELECT list(s ORDER BY i) AS c, sum(s) AS g FROM (SELECT i, sum(x) AS s FROM x GROUP BY i))
SELECT name, list_transform(v, lambda x: round(sqrt(x / list_sum(v)), 6)) AS hellinger, list_transform(list_zip(v, c), lambda z: round(sqrt(g) * z[1] / (list_sum(v) * sqrt(z[2])), 5)) AS chisq FROM vecs, c""")
def vecs_transforms(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d)
    totals = F.broadcast(V.column_totals(rows))  # one row
    chisq = V.trans_chisq("v", F.col("colsum"), F.col("total"))
    return rows.crossJoin(totals).select("name", F.transform(V.trans_hellinger("v"), lambda x: F.round(x, 6)).alias("hellinger"), F.transform(chisq, lambda x: F.round(x, 5)).alias("chisq"))


# spans: each event and a second span after it
_TWO = f"{SPAN_SQL}, two AS (SELECT name, start, stop, [{{'start': stop + 90, 'stop': stop + 150}}, {{'start': start, 'stop': stop}}, {{'start': start + 30, 'stop': stop + 60}}] AS spans FROM f)"


def _two(spark: SparkSession, d: str) -> DataFrame:
    span = lambda a, b: F.struct(a.alias("start"), b.alias("stop"))
    a, b = F.col("start"), F.col("stop")
    return spans(spark, d).select("name", "start", "stop", F.array(span(b + 90, b + 150), span(a, b), span(a + 30, b + 60)).alias("spans"))


@register("spans_of_maps", f"""WITH {_TWO} SELECT name, start AS cover_start, stop + 150 AS cover_stop, 2 AS merged, stop + 60 AS first_stop, 2 AS free, 1000 AS reversed_last, (2 * (stop - start) + 90)::BIGINT AS length, 3 * start AS scaled, 0::BIGINT AS zeroed FROM two""")
def spans_of_maps(spark: SparkSession, d: str) -> DataFrame:
    rows = _two(spark, d)
    cover, merged = I.spans_covering(F.col("spans")), I.spans_merged(F.col("spans"))
    length = F.col("stop") + 150
    reversed_ = I.spans_reversed(F.col("spans"), F.col("stop") + 1150)
    return rows.select(
        "name", cover["start"].alias("cover_start"), cover["stop"].alias("cover_stop"), F.size(merged).alias("merged"), F.get(merged, F.lit(0))["stop"].alias("first_stop"),
        F.size(I.spans_shadow(F.col("spans"), length)).alias("free"), F.get(reversed_, F.lit(0))["start"].cast("int").alias("reversed_last"), I.spans_length(F.col("spans")).alias("length"),
        F.array_min(F.transform(I.spans_scaled(F.col("spans"), 3), lambda s: s["start"])).alias("scaled"), F.array_min(F.transform(I.spans_zeroed(F.col("spans")), lambda s: s["start"])).alias("zeroed"))


@register("spans_clipped_to_view", f"WITH {_TWO} SELECT name, 2 AS n, (stop - start + 10)::BIGINT AS last, 50::BIGINT AS first_length FROM (SELECT * FROM two WHERE stop - start > 50)")
def spans_clipped_to_view(spark: SparkSession, d: str) -> DataFrame:
    """A view that begins 50 before the first span's end and ends 60 after it."""
    rows = _two(spark, d).filter("stop - start > 50").withColumn("c", I.spans_clipped(F.col("spans"), F.col("stop") - 50, F.col("stop") + 60))
    first = F.element_at(F.array_sort(F.transform("c", lambda s: s["stop"] - s["start"])), 1)
    return rows.select("name", F.size("c").alias("n"), (F.array_max(F.transform("c", lambda s: s["stop"])) - 100 + F.col("stop") - F.col("start")).alias("last"), first.alias("first_length"))


@register("spans_positions", f"WITH {SPAN_SQL} SELECT name, 7 + start + 3 * 2 AS absolute, ((stop - 7 - start) // 2)::BIGINT AS relative, CASE WHEN value < 0 THEN -1 ELSE 1 END AS strand FROM f")
def spans_positions(spark: SparkSession, d: str) -> DataFrame:
    two, seven = F.lit(2), F.lit(7)
    sign = F.when(F.col("value") < 0, "-").otherwise("+")
    return spans(spark, d).select("name", I.absolute_position(F.lit(3), F.col("start"), two, seven).alias("absolute"), I.relative_position(F.col("stop"), F.col("start"), two, seven).alias("relative"), I.strand(sign).alias("strand"))


# collections
@register("aln_strand_symmetry", f"""WITH {LONG_SQL}, c AS (SELECT name, CASE WHEN ch IN ('A', 'T') THEN 'A' ELSE 'C' END AS p, count(*) FILTER (ch IN ('A', 'C')) AS a, count(*) FILTER (ch IN ('T', 'G')) AS b FROM long WHERE ch <> '-' GROUP BY ALL),
t AS (SELECT *, sum(a) OVER (PARTITION BY name) AS ta, sum(b) OVER (PARTITION BY name) AS tb FROM c)
SELECT name, round(2 * sum(CASE WHEN a > 0 THEN a * ln(a * (ta + tb) / ((a + b) * ta)) ELSE 0 END + CASE WHEN b > 0 THEN b * ln(b * (ta + tb) / ((a + b) * tb)) ELSE 0 END), 5) + 0.0 AS g, (count(*) - 1)::BIGINT AS df FROM t GROUP BY name""")
def aln_strand_symmetry(spark: SparkSession, d: str) -> DataFrame:
    return A.strand_symmetry(alignment(spark, d)).select("name", (F.round("G", 5) + 0.0).alias("g"), "df")


@register("aln_duplicated", "SELECT text AS seq, count(*) AS n, list(doc_id ORDER BY doc_id) AS names FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1")
def aln_duplicated(spark: SparkSession, d: str) -> DataFrame:
    return A.duplicated_seqs(table(spark, d, "documents").filter("text IS NOT NULL").select(F.col("doc_id").alias("name"), F.col("text").alias("seq")))


@register("aln_ragged", f"WITH {ALN_SQL}, {DNA_SQL} SELECT (SELECT min(length(seq)) <> max(length(seq)) FROM aln) AS aligned, (SELECT min(length(seq)) <> max(length(seq)) FROM seqs) AS plain")
def aln_ragged(spark: SparkSession, d: str) -> DataFrame:
    one = A.is_ragged(alignment(spark, d)).withColumnRenamed("ragged", "aligned")
    return one.crossJoin(A.is_ragged(dna(spark, d)).withColumnRenamed("ragged", "plain"))  # one row each


@register("aln_add_renamed", f"WITH {ALN_SQL} SELECT 'v' || name AS name, seq FROM aln UNION ALL SELECT 'r' || name, reverse(translate(seq, 'ACGT', 'TGCA')) FROM aln")
def aln_add_renamed(spark: SparkSession, d: str) -> DataFrame:
    plain = A.renamed_seqs(alignment(spark, d), lambda n: F.concat(F.lit("v"), n))
    turned = A.renamed_seqs(A.per_seq(alignment(spark, d), M.DNA.rc), lambda n: F.concat(F.lit("r"), n))
    return A.add_seqs(plain, turned).select("name", "seq")


@register("aln_position_range", f"WITH {ALN_SQL} SELECT name, substr(seq, 11, 20) AS seq FROM aln")
def aln_position_range(spark: SparkSession, d: str) -> DataFrame:
    kept = spark.range(10, 30).select(F.col("id").cast("int").alias("pos"))
    return A.take_columns(alignment(spark, d), kept).select("name", "seq")


@register("aln_columns_where", f"WITH {LONG_SQL} SELECT pos::INTEGER AS pos FROM long GROUP BY pos HAVING count(*) FILTER (ch = 'T') > count(*) FILTER (ch = 'G')")
def aln_columns_where(spark: SparkSession, d: str) -> DataFrame:
    return A.columns_where(alignment(spark, d), F.count_if(F.col("ch") == "T") > F.count_if(F.col("ch") == "G"))


@register("aln_counts_all", f"WITH {LONG_SQL} SELECT ch AS motif, count(*) AS n FROM long WHERE ch <> '-' GROUP BY ch")
def aln_counts_all(spark: SparkSession, d: str) -> DataFrame:
    return A.counts(alignment(spark, d))


@register("aln_sampled_columns", f"WITH {ALN_SQL} SELECT name, length(seq)::INTEGER AS n, length(replace(seq, 'A', ''))::INTEGER AS others FROM aln")
def aln_sampled_columns(spark: SparkSession, d: str) -> DataFrame:
    """All columns in a random order: each row keeps its letters."""
    return A.sample(alignment(spark, d), 64, seed=3).select("name", F.length("seq").alias("n"), F.length(F.replace("seq", F.lit("A"))).alias("others"))


@register("aln_scaled_gaps", f"WITH {ALN_SQL} SELECT name, array_to_string(list_transform(string_split(seq, ''), lambda c: CASE WHEN c = '-' THEN '---' ELSE 'ACG' END), '') AS seq FROM aln")
def aln_scaled_gaps(spark: SparkSession, d: str) -> DataFrame:
    guide = alignment(spark, d)
    rows = guide.select("name", "ord", F.regexp_replace(M.DNA.degap("seq"), ".", "ACG").alias("seq"))
    return A.apply_scaled_gaps(rows, guide).select("name", "seq")


@register("aln_made", "SELECT * FROM (VALUES ('a', 0, 'ACG'), ('b', 1, 'A-G')) v(name, ord, seq)")
def aln_made(spark: SparkSession, d: str) -> DataFrame:
    return A.checked_alignment(A.make_seqs(spark, {"a": "ACG", "b": "A-G"}))


@register("profile_row_totals", f"WITH {LONG_SQL} SELECT pos::INTEGER AS row, count(*) AS total FROM long WHERE ch <> '-' GROUP BY pos")
def profile_row_totals(spark: SparkSession, d: str) -> DataFrame:
    counts = A.counts_per_pos(alignment(spark, d)).withColumnRenamed("pos", "row")
    return P.row_totals(counts).toDF("row", "total")


# distances
_MC = f"""{ALN_SQL}, q AS (SELECT a.name AS name1, b.name AS name2, list_transform(range(1, 65), lambda i: a.seq[i] || b.seq[i]) AS z FROM aln a JOIN aln b ON a.name < b.name),
m AS (SELECT name1, name2, len(list_filter(z, lambda x: NOT contains(x, '-'))) AS length, len(list_filter(z, lambda x: NOT contains(x, '-') AND x[1] <> x[2])) AS diffs FROM q)"""


@register("dist_min_pair", f"WITH {_MC} SELECT min(diffs)::DOUBLE AS dist FROM m")
def dist_min_pair(spark: SparkSession, d: str) -> DataFrame:
    return D.extreme_pair(alignment(spark, d), "min").select("dist")


@register("dist_calculator", f"WITH {_MC} SELECT name1, name2, round(diffs / nullif(length, 0), 8) AS dist FROM m")
def dist_calculator(spark: SparkSession, d: str) -> DataFrame:
    return D.get_distance_calculator("pdist")(alignment(spark, d), digits=8)


@register("dist_available", "SELECT unnest(['hamming', 'jc69', 'logdet', 'paralinear', 'pdist', 'tn93']) AS name")
def dist_available(spark: SparkSession, d: str) -> DataFrame:
    return D.available_distances(spark).select("name")


# tables
@register("table_head", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 7")
def table_head(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice", (-F.col("o_totalprice")).alias("k"))
    return O.head(rows, 7, ["k", "o_orderkey"]).select("o_orderkey", "o_totalprice")


@register("table_cast_ladder", "SELECT c_custkey, c_nationkey::BIGINT AS k, c_acctbal AS x, c_mktsegment AS s FROM customer")
def table_cast_ladder(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("k"), F.col("c_acctbal").cast("string").alias("x"), F.col("c_mktsegment").alias("s"))
    out = O.cast_ladder(texts, ["k", "x", "s"])
    return out.select("c_custkey", F.col("k").cast("long").alias("k"), "x", "s")


@register("table_made", "SELECT * FROM (VALUES (1, 'x', 0.5), (2, 'y', 1.5)) v(a, b, c)")
def table_made(spark: SparkSession, d: str) -> DataFrame:
    out = O.make_table(spark, ["a", "b", "c"], [[1, "x", 0.5], [2, "y", 1.5]])
    again = O.from_rich_json(spark, O.to_rich_json(out))
    held = O.to_dict(again, "a")
    return spark.createDataFrame([(k, v["b"], v["c"]) for k, v in sorted(held.items())], "a int, b string, c double")


# features
@register("features_of_store", f"WITH {SPAN_SQL} SELECT seqid, biotype, name, start, stop, 0 AS strand FROM f UNION ALL SELECT 'new', 'gene', 'g1', 5, 40, -1")
def features_of_store(spark: SparkSession, d: str) -> DataFrame:
    store = X.feature_rows(spans(spark, d).select("seqid", "biotype", "name", "start", "stop"))
    more = X.add_feature(store, seqid="new", biotype="gene", name="g1", spans=[(30, 40), (5, 20)], strand="-")
    if not X.compatible(store, more):
        raise ValueError("stores differ")
    return more.select("seqid", "biotype", "name", "start", "stop", F.col("strand").cast("int").alias("strand"))


@register("features_parents", f"WITH {SPAN_SQL} SELECT name AS child, (name::BIGINT - 1)::VARCHAR AS name, (SELECT g.start FROM f g WHERE g.name::BIGINT = f.name::BIGINT - 1) AS start FROM f WHERE name::BIGINT - 1 IN (SELECT name::BIGINT FROM f)")
def features_parents(spark: SparkSession, d: str) -> DataFrame:
    """Each event has the one before it as its parent."""
    rows = spans(spark, d).select("seqid", "biotype", "name", "start", "stop").withColumn("parent_id", (F.col("name").cast("long") - 1).cast("string"))
    store = X.feature_rows(rows)
    return X.parents(store, store).select("child", "name", "start")


@register("features_of_matches", f"WITH {DNA_SQL}, m AS (SELECT name, seq, regexp_extract_all(seq, 'TAT') AS found, string_split(seq, 'TAT') AS gaps FROM seqs) SELECT name::VARCHAR AS seqid, len(found)::BIGINT AS n, length(gaps[1])::BIGINT AS first FROM m WHERE len(found) > 0")
def features_of_matches(spark: SparkSession, d: str) -> DataFrame:
    rows = dna(spark, d).select(F.col("name").cast("string").alias("name"), "seq")
    return X.annotate_matches(rows, "TAT", "motif", "tat").groupBy("seqid").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("first"))


# statistics
@register("stat_likelihood_ratio", "SELECT s_suppkey, 2 * (s_acctbal - c) AS lr FROM supplier, (SELECT avg(c_nationkey) AS c FROM customer)")
def stat_likelihood_ratio(spark: SparkSession, d: str) -> DataFrame:
    mean = F.broadcast(table(spark, d, "customer").agg(F.avg("c_nationkey").alias("c")))  # one row
    return table(spark, d, "supplier").crossJoin(mean).select("s_suppkey", T.likelihood_ratio(F.col("c"), F.col("s_acctbal")).alias("lr"))


_SIGNAL = "s AS (SELECT vec_id AS name, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"
_POWER = "sqrt(list_sum(list_transform(range(64), lambda i: v[i + 1] * cos(i * 2 * pi() / p))) ** 2 + list_sum(list_transform(range(64), lambda i: v[i + 1] * sin(i * 2 * pi() / p))) ** 2)"


@register("period_hybrid", f"""WITH {_SIGNAL}, p AS (SELECT name, list_transform(range(2, 9), lambda p: {_POWER}) AS f, list_transform(range(2, 9), lambda k: list_sum(list_transform(range(1, 65 - k), lambda i: v[i] * v[i + k])) / 64) AS a FROM s)
SELECT name, list_transform(list_zip(a, f), lambda z: round(z[1] * z[2], 5) + 0.0) AS h, round(list_max(f) / list_sum(f), 6) AS g FROM p""")
def period_hybrid(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("name"), F.col("embedding").cast("array<double>").alias("v"))
    return rows.select("name", F.transform(T.hybrid(F.col("v"), 2, 8), lambda x: F.round(x, 5) + 0.0).alias("h"), F.round(T.g_statistic(T.ipdft(F.col("v"), 2, 8)), 6).alias("g"))


@register("period_motif_signal", f"WITH {ALN_SQL} SELECT name, len(list_filter(range(1, 64), lambda i: substr(seq, i, 2) IN ('AA', 'TT')))::INTEGER AS n, 63 AS places FROM aln")
def period_motif_signal(spark: SparkSession, d: str) -> DataFrame:
    rows = alignment(spark, d).select("name", T.motif_signal(F.col("seq"), ["AA", "TT"], 2).alias("s"))
    return rows.select("name", F.aggregate("s", F.lit(0.0), lambda acc, x: acc + x).cast("int").alias("n"), F.size("s").alias("places"))
