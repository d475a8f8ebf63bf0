"""Alignment, profile and distance operators over embeddings seen as aligned sequences or as rows of amounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators import alignment as A
from ..operators import distance as D
from ..operators import profile as P
from ..operators import stats as T
from ..operators import vecdist
from .registry import register
from .views import ALN_SQL, LONG_SQL, PAIR_SQL, VEC_SQL, alignment, vectors

SEQ = "string_agg(ch, '' ORDER BY pos)"


@register("aln_gaps_per_pos", f"WITH {LONG_SQL} SELECT pos::INTEGER AS pos, count(*) FILTER (ch = '-') AS gaps FROM long GROUP BY ALL")
def aln_gaps_per_pos(spark: SparkSession, d: str) -> DataFrame:
    return A.count_gaps_per_pos(alignment(spark, d))


_W = ", w AS (SELECT *, count(*) FILTER (ch = '-') OVER (PARTITION BY pos) AS g, count(*) OVER (PARTITION BY pos) AS n FROM long)"


@register("aln_gaps_per_seq", f"WITH {LONG_SQL}{_W} SELECT name, count(*) FILTER (ch = '-') AS gaps FROM w GROUP BY name")
def aln_gaps_per_seq(spark: SparkSession, d: str) -> DataFrame:
    return A.count_gaps_per_seq(alignment(spark, d))


@register("aln_gaps_induced", f"WITH {LONG_SQL}{_W} SELECT name, count(*) FILTER (ch <> '-' AND g > 0) AS gaps FROM w GROUP BY name")
def aln_gaps_induced(spark: SparkSession, d: str) -> DataFrame:
    return A.count_gaps_per_seq(alignment(spark, d), induced_by=True)


@register("aln_gaps_unique", f"WITH {LONG_SQL}{_W} SELECT name, count(*) FILTER (ch <> '-' AND g = n - 1) AS gaps FROM w GROUP BY name")
def aln_gaps_unique(spark: SparkSession, d: str) -> DataFrame:
    return A.count_gaps_per_seq(alignment(spark, d), unique=True)


_C = ", c AS (SELECT pos::INTEGER AS pos, ch AS motif, count(*) AS n FROM long WHERE ch <> '-' GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY pos) AS p FROM c)"


@register("aln_counts_per_pos", f"WITH {LONG_SQL}{_C} SELECT * FROM c")
def aln_counts_per_pos(spark: SparkSession, d: str) -> DataFrame:
    return A.counts_per_pos(alignment(spark, d))


@register("aln_probs_per_pos", f"WITH {LONG_SQL}{_C} SELECT pos, motif, n, round(p, 8) AS p FROM p")
def aln_probs_per_pos(spark: SparkSession, d: str) -> DataFrame:
    return A.probs_per_pos(alignment(spark, d)).withColumn("p", F.round("p", 8))


@register("aln_entropy_per_pos", f"WITH {LONG_SQL}{_C} SELECT pos, round(-sum(p * log2(p)), 6) AS entropy FROM p GROUP BY pos")
def aln_entropy_per_pos(spark: SparkSession, d: str) -> DataFrame:
    return A.entropy_per_pos(alignment(spark, d)).withColumn("entropy", F.round("entropy", 6))


@register("aln_information", f"WITH {LONG_SQL}{_C}, e AS (SELECT pos, 2 + sum(p * log2(p)) AS i FROM p GROUP BY pos) SELECT pos, round(avg(i) OVER (ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS information FROM e")
def aln_information(spark: SparkSession, d: str) -> DataFrame:
    return A.information_per_pos(alignment(spark, d), window=5).withColumn("information", F.round("information", 6))


@register("aln_majority_consensus", f"WITH {LONG_SQL}, c AS (SELECT pos, ch, count(*) AS n FROM long GROUP BY ALL), m AS (SELECT pos, ch, row_number() OVER (PARTITION BY pos ORDER BY n DESC, ch DESC) AS r FROM c) SELECT {SEQ} AS consensus FROM m WHERE r = 1")
def aln_majority_consensus(spark: SparkSession, d: str) -> DataFrame:
    return A.majority_consensus(alignment(spark, d))


_CODE = "CASE s WHEN 'A' THEN 'A' WHEN 'C' THEN 'C' WHEN 'G' THEN 'G' WHEN 'T' THEN 'T' WHEN 'AG' THEN 'R' WHEN 'CT' THEN 'Y' WHEN 'AT' THEN 'W' WHEN 'CG' THEN 'S' WHEN 'GT' THEN 'K' WHEN 'AC' THEN 'M' WHEN 'CGT' THEN 'B' WHEN 'AGT' THEN 'D' WHEN 'ACT' THEN 'H' WHEN 'ACG' THEN 'V' WHEN 'ACGT' THEN 'N' ELSE '-' END"


@register("aln_iupac_consensus", f"WITH {LONG_SQL}, s AS (SELECT pos, coalesce(string_agg(DISTINCT ch, '' ORDER BY ch) FILTER (ch <> '-'), '') AS s FROM long GROUP BY pos) SELECT string_agg({_CODE}, '' ORDER BY pos) AS consensus FROM s")
def aln_iupac_consensus(spark: SparkSession, d: str) -> DataFrame:
    return A.iupac_consensus(alignment(spark, d))


@register("aln_variable_positions", f"WITH {LONG_SQL} SELECT pos::INTEGER AS pos FROM long GROUP BY pos HAVING count(DISTINCT CASE WHEN ch <> '-' THEN ch END) > 1")
def aln_variable_positions(spark: SparkSession, d: str) -> DataFrame:
    return A.variable_positions(alignment(spark, d))


@register("aln_omit_gap_pos", f"WITH {LONG_SQL}, k AS (SELECT pos FROM long GROUP BY pos HAVING count(*) FILTER (ch = '-') <= floor(count(*) * 0.05)) SELECT name, {SEQ} AS seq FROM long JOIN k USING (pos) GROUP BY name")
def aln_omit_gap_pos(spark: SparkSession, d: str) -> DataFrame:
    return A.omit_gap_pos(alignment(spark, d), 0.05).select("name", "seq").filter("seq <> ''")


@register("aln_no_degenerates", f"""WITH {ALN_SQL}, l AS (SELECT name, pos, substr(seq, 2 * pos + 1, 2) AS ch FROM (SELECT name, seq, unnest(range(length(seq) // 2)) AS pos FROM aln)),
k AS (SELECT pos FROM l GROUP BY pos HAVING bool_and(ch NOT LIKE '%-%')) SELECT a.name, coalesce(s, '') AS seq FROM aln a LEFT JOIN (SELECT name, {SEQ} AS s FROM l JOIN k USING (pos) GROUP BY name) USING (name)""")
def aln_no_degenerates(spark: SparkSession, d: str) -> DataFrame:
    return A.no_degenerates(alignment(spark, d), k=2).select("name", "seq")


@register("aln_omit_bad_seqs", f"WITH {LONG_SQL}{_W}, u AS (SELECT name, count(*) FILTER (ch <> '-' AND g = n - 1) AS gaps FROM w GROUP BY name), q AS (SELECT quantile_cont(gaps, 0.9) AS cut FROM u) SELECT name FROM u, q WHERE gaps <= cut")
def aln_omit_bad_seqs(spark: SparkSession, d: str) -> DataFrame:
    return A.omit_bad_seqs(alignment(spark, d), 0.9).select("name")


@register("aln_degapped_relative_to", f"WITH {LONG_SQL}, k AS (SELECT pos FROM long WHERE name = 7 AND ch <> '-') SELECT name, {SEQ} AS seq FROM long JOIN k USING (pos) GROUP BY name")
def aln_degapped_relative_to(spark: SparkSession, d: str) -> DataFrame:
    return A.degapped_relative_to(alignment(spark, d), 7).select("name", "seq")


@register("aln_codon_positions", f"WITH {LONG_SQL} SELECT name, string_agg(ch, '' ORDER BY pos) FILTER (pos % 3 IN (0, 1)) AS seq FROM long GROUP BY name")
def aln_codon_positions(spark: SparkSession, d: str) -> DataFrame:
    return A.take_codon_positions(alignment(spark, d), (1, 2)).select("name", "seq")


@register("aln_take_positions", f"WITH {ALN_SQL} SELECT name, seq[11] || seq[3] || seq[3] || seq[60] AS seq FROM aln")
def aln_take_positions(spark: SparkSession, d: str) -> DataFrame:
    return A.take_positions(alignment(spark, d), [10, 2, 2, 59]).select("name", "seq")


@register("aln_matching_ref", f"""WITH {ALN_SQL}, m AS (SELECT a.name, length(a.seq) AS n, array_to_string(list_transform(range(1, length(a.seq) + 1), lambda i: CASE WHEN (a.seq[i] = '-') <> (r.seq[i] = '-') THEN '1' ELSE '0' END), '') AS m
FROM aln a, (SELECT seq FROM aln WHERE name = 3) r) SELECT name FROM m WHERE length(replace(m, '0', '')) <= 0.12 * n AND NOT contains(m, '11')""")
def aln_matching_ref(spark: SparkSession, d: str) -> DataFrame:
    return A.matching_ref(alignment(spark, d), 3, 0.12, 2).select("name")


@register("aln_fixed_length", f"WITH {ALN_SQL} SELECT name, right(seq, 30) AS seq FROM aln")
def aln_fixed_length(spark: SparkSession, d: str) -> DataFrame:
    return A.fixed_length(alignment(spark, d), 30, "last").select("name", "seq")


@register("aln_site_patterns", f"WITH {LONG_SQL}, p AS (SELECT pos, string_agg(ch, '' ORDER BY name) AS pattern FROM long GROUP BY pos) SELECT md5(pattern) AS pattern, count(*) AS n FROM p GROUP BY ALL")
def aln_site_patterns(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.models import site_patterns

    return site_patterns(alignment(spark, d)).select(F.md5("pattern").alias("pattern"), "n")


# profiles
@register("profile_information", f"WITH {LONG_SQL}{_C}, k AS (SELECT pos, count(*) AS k, -sum(p * log2(p)) AS h FROM p GROUP BY pos) SELECT pos AS row, round(log2(k) - h, 6) AS information FROM k")
def profile_information(spark: SparkSession, d: str) -> DataFrame:
    counts = A.counts_per_pos(alignment(spark, d)).withColumnRenamed("pos", "row")
    return P.information(P.to_freqs(counts)).withColumn("information", F.round("information", 6))


@register("profile_pssm", f"WITH {LONG_SQL}{_C} SELECT pos AS row, motif, round(log2(p) + log2(count(*) OVER (PARTITION BY pos)), 6) AS score FROM p")
def profile_pssm(spark: SparkSession, d: str) -> DataFrame:
    counts = A.counts_per_pos(alignment(spark, d)).withColumnRenamed("pos", "row")
    return P.to_pssm(P.to_freqs(counts)).withColumn("score", F.round("score", 6))


@register("profile_relative_entropy", f"WITH {LONG_SQL}{_C}, b AS (SELECT *, 1 / count(*) OVER (PARTITION BY pos) AS b FROM p) SELECT pos AS row, round(sum(b * (log2(b) - log2(p))), 6) AS relative_entropy FROM b GROUP BY pos")
def profile_relative_entropy(spark: SparkSession, d: str) -> DataFrame:
    counts = A.counts_per_pos(alignment(spark, d)).withColumnRenamed("pos", "row")
    return P.relative_entropy(P.to_freqs(counts)).withColumn("relative_entropy", F.round("relative_entropy", 6))


_H = "CASE WHEN {0} > 0 THEN -({0}) * log2({0}) ELSE 0 END"
_FULL = ", full_p AS (SELECT r.pos, m.motif, coalesce(p.p, 0) AS p FROM (SELECT DISTINCT pos FROM p) r CROSS JOIN (VALUES ('A'), ('C'), ('G'), ('T')) m(motif) LEFT JOIN p ON p.pos = r.pos AND p.motif = m.motif)"


@register("profile_jsd", f"""WITH {LONG_SQL}{_C}{_FULL} SELECT a.pos AS row1, b.pos AS row2, round(greatest(sum({_H.format('(a.p + b.p) / 2')} - ({_H.format('a.p')} + {_H.format('b.p')}) / 2), 0), 6) AS jsd
FROM full_p a JOIN full_p b ON a.motif = b.motif AND a.pos < b.pos GROUP BY ALL""")
def profile_jsd(spark: SparkSession, d: str) -> DataFrame:
    counts = P.full_grid(A.counts_per_pos(alignment(spark, d)).withColumnRenamed("pos", "row"), "TCAG")
    return P.pairwise_jsd(P.to_freqs(counts)).withColumn("jsd", F.round("jsd", 6))


@register("profile_score_seqs", f"""WITH {LONG_SQL}{_C}, s AS (SELECT pos, motif, log2(p) + log2(count(*) OVER (PARTITION BY pos)) AS score FROM p WHERE pos < 8),
x AS (SELECT name, start, unnest(range(8)) AS k, seq FROM (SELECT name, seq, unnest(range(length(seq) - 7)) AS start FROM aln))
SELECT name, start::INTEGER AS start, round(sum(coalesce(score, 0)), 5) AS score FROM x LEFT JOIN s ON s.pos = k AND s.motif = seq[start + k + 1] GROUP BY ALL""")
def profile_score_seqs(spark: SparkSession, d: str) -> DataFrame:
    aln = alignment(spark, d)
    counts = A.counts_per_pos(aln).withColumnRenamed("pos", "row")
    pssm = P.to_pssm(P.to_freqs(counts)).filter("row < 8")
    return P.score_seqs(aln, pssm).withColumn("score", F.round("score", 5))


@register("profile_ic_score", f"WITH {LONG_SQL}, c AS (SELECT pos, ch, count(*) AS n FROM long GROUP BY ALL), t AS (SELECT count(*) AS rows FROM aln) SELECT round(sum(n / rows * log2(n / rows / 0.25)), 5) AS ic_score FROM c, t WHERE ch <> '-'")
def profile_ic_score(spark: SparkSession, d: str) -> DataFrame:
    aln = alignment(spark, d)
    rows = F.broadcast(aln.agg(F.count(F.lit(1)).alias("rows")))
    freqs = A.counts_per_pos(aln).crossJoin(rows).withColumn("p", F.col("n") / F.col("rows"))
    return P.ic_score(freqs).withColumn("ic_score", F.round("ic_score", 5))


# pairwise distances
_M = f"""{ALN_SQL}, u AS (SELECT name, seq FROM aln), q AS (SELECT a.name AS name1, b.name AS name2,
  list_transform(range(1, 65), lambda i: a.seq[i] || b.seq[i]) AS z FROM u a JOIN u b ON a.name < b.name),
m AS (SELECT name1, name2, len(list_filter(z, lambda x: x NOT LIKE '%-%')) AS valid, len(list_filter(z, lambda x: x NOT LIKE '%-%' AND x[1] <> x[2])) AS diffs, z FROM q)"""


@register("dist_hamming", f"WITH {_M} SELECT name1, name2, diffs::DOUBLE AS dist FROM m")
def dist_hamming(spark: SparkSession, d: str) -> DataFrame:
    return D.hamming(alignment(spark, d))


@register("dist_pdist", f"WITH {_M} SELECT name1, name2, round(diffs / nullif(valid, 0), 8) AS dist FROM m")
def dist_pdist(spark: SparkSession, d: str) -> DataFrame:
    return D.pdist(alignment(spark, d), digits=8)


@register("dist_jc69", f"WITH {_M}, p AS (SELECT name1, name2, diffs / nullif(valid, 0) AS p FROM m) SELECT name1, name2, CASE WHEN p = 0 THEN 0 WHEN p < 0.75 THEN round(-0.75 * ln(1 - p / 0.75), 6) END AS dist FROM p")
def dist_jc69(spark: SparkSession, d: str) -> DataFrame:
    return D.jc69(alignment(spark, d), digits=6, nan_to_null=True)


_TN = f"""{_M}, f AS (SELECT sum(length(seq) - length(replace(seq, 'A', ''))) AS a, sum(length(seq) - length(replace(seq, 'C', ''))) AS c, sum(length(seq) - length(replace(seq, 'G', ''))) AS g, sum(length(seq) - length(replace(seq, 'T', ''))) AS t FROM u),
h AS (SELECT a / (a + c + g + t) AS a, c / (a + c + g + t) AS c, g / (a + c + g + t) AS g, t / (a + c + g + t) AS t FROM f),
k AS (SELECT a + g AS r, c + t AS y, a * g AS rr, c * t AS yy, 2 * a * g / (a + g) AS c1, 2 * c * t / (c + t) AS c2 FROM h),
n AS (SELECT name1, name2, valid, diffs, len(list_filter(z, lambda x: x IN ('AG', 'GA'))) / valid AS ts_r, len(list_filter(z, lambda x: x IN ('CT', 'TC'))) / valid AS ts_y,
  len(list_filter(z, lambda x: x IN ('AC', 'CA', 'AT', 'TA', 'GC', 'CG', 'GT', 'TG'))) / valid AS tv FROM m),
e AS (SELECT name1, name2, valid, diffs, c1, c2, 2 * (r * y - rr * y / r - yy * r / y) AS c3, 1 - ts_r / c1 - tv / (2 * r) AS t1, 1 - ts_y / c2 - tv / (2 * y) AS t2, 1 - tv / (2 * r * y) AS t3 FROM n, k)"""


@register("dist_tn93", f"WITH {_TN} SELECT name1, name2, CASE WHEN valid = 0 THEN NULL WHEN diffs = 0 THEN 0 WHEN t1 > 0 AND t2 > 0 AND t3 > 0 THEN round(-c1 * ln(t1) - c2 * ln(t2) - c3 * ln(t3), 6) END AS dist FROM e")
def dist_tn93(spark: SparkSession, d: str) -> DataFrame:
    return D.tn93(alignment(spark, d), digits=6, nan_to_null=True)


@register("dist_paralinear")
def dist_paralinear(spark: SparkSession, d: str) -> DataFrame:
    return D.paralinear(alignment(spark, d))


@register("dist_gap", f"""WITH {ALN_SQL}, g AS (SELECT name, list_distinct(list_filter(list_transform(range(1, 65), lambda i: CASE WHEN seq[i] = '-' AND (i = 1 OR seq[i - 1] <> '-') THEN i::VARCHAR || ':' || (length(substr(seq, i)) - length(ltrim(substr(seq, i), '-')))::VARCHAR END), lambda x: x IS NOT NULL)) AS s FROM aln),
p AS (SELECT a.name AS name1, b.name AS name2, list_filter(a.s || b.s, lambda x: NOT (list_contains(a.s, x) AND list_contains(b.s, x))) AS o FROM g a JOIN g b ON a.name < b.name)
SELECT name1, name2, (12 * len(o) + coalesce(list_sum(list_transform(o, lambda x: split_part(x, ':', 2)::INTEGER)), 0))::DOUBLE AS dist FROM p""")
def dist_gap(spark: SparkSession, d: str) -> DataFrame:
    return D.gap_dist(alignment(spark, d))


@register("dist_max_pair", f"WITH {_M} SELECT max(diffs)::DOUBLE AS dist FROM m")
def dist_max_pair(spark: SparkSession, d: str) -> DataFrame:
    return D.extreme_pair(alignment(spark, d), "max").select("dist")


@register("aln_coevolution", f"""WITH {LONG_SQL}, c AS (SELECT a.pos::INTEGER AS pos1, b.pos::INTEGER AS pos2, a.ch AS c1, b.ch AS c2, count(*) AS n FROM long a JOIN long b ON a.name = b.name AND a.pos < b.pos WHERE a.ch <> '-' AND b.ch <> '-' GROUP BY ALL),
t AS (SELECT *, sum(n) OVER (PARTITION BY pos1, pos2) AS s, sum(n) OVER (PARTITION BY pos1, pos2, c1) AS n1, sum(n) OVER (PARTITION BY pos1, pos2, c2) AS n2 FROM c)
SELECT pos1, pos2, round(greatest(sum(n / s * log2(n * s / (n1 * n2))), 0), 6) AS mi FROM t GROUP BY ALL""")
def aln_coevolution(spark: SparkSession, d: str) -> DataFrame:
    return T.coevolution(A.long_form(alignment(spark, d))).withColumn("mi", F.round("mi", 6))


# rows of amounts
_S = "list_sum(list_transform(list_zip(a, b), lambda z: {0}))"
_X, _Y = "z[1]", "z[2]"
_VEC = {
    "euclidean": f"sqrt({_S.format(f'({_X} - {_Y}) * ({_X} - {_Y})')})",
    "manhattan": _S.format(f"abs({_X} - {_Y})"),
    "bray_curtis": f"{_S.format(f'abs({_X} - {_Y})')} / (list_sum(a) + list_sum(b))",
    "bray_curtis_magurran": f"1 - 2 * {_S.format(f'least({_X}, {_Y})')} / (list_sum(a) + list_sum(b))",
    "canberra": f"{_S.format(f'CASE WHEN {_X} + {_Y} <> 0 THEN abs({_X} - {_Y}) / ({_X} + {_Y}) ELSE 0 END')} / {_S.format(f'CASE WHEN {_X} <> 0 OR {_Y} <> 0 THEN 1 ELSE 0 END')}",
    "soergel": f"{_S.format(f'abs({_X} - {_Y})')} / {_S.format(f'greatest({_X}, {_Y})')}",
    "kulczynski": f"1 - ({_S.format(f'least({_X}, {_Y})')} / list_sum(a) + {_S.format(f'least({_X}, {_Y})')} / list_sum(b)) / 2",
    "chord": f"sqrt(greatest(2 - 2 * {_S.format(f'{_X} * {_Y}')} / sqrt(list_sum(list_transform(a, lambda x: x * x)) * list_sum(list_transform(b, lambda x: x * x))), 0))",
    "binary_hamming": _S.format(f"CASE WHEN ({_X} <> 0) <> ({_Y} <> 0) THEN 1.0::DOUBLE ELSE 0 END"),
    "otu_gain": _S.format(f"CASE WHEN {_X} <> 0 AND {_Y} = 0 THEN 1.0::DOUBLE ELSE 0 END"),
}
_BOTH = _S.format(f"CASE WHEN {_X} <> 0 AND {_Y} <> 0 THEN 1.0::DOUBLE ELSE 0 END")
_NA, _NB = ("list_sum(list_transform(%s, lambda x: CASE WHEN x <> 0 THEN 1.0::DOUBLE ELSE 0 END))" % c for c in "ab")
_VEC |= {
    "binary_sorensen_dice": f"1 - 2 * {_BOTH} / ({_NA} + {_NB})",
    "binary_jaccard": f"1 - {_BOTH} / ({_NA} + {_NB} - {_BOTH})",
    "binary_ochiai": f"1 - {_BOTH} / sqrt({_NA} * {_NB})",
    "binary_lennon": f"CASE WHEN {_BOTH} = 0 THEN 1 ELSE 1 - {_BOTH} / ({_BOTH} + least({_NA} - {_BOTH}, {_NB} - {_BOTH})) END",
    "morisita_horn": f"1 - 2 * {_S.format(f'{_X} * {_Y}')} / ((list_sum(list_transform(a, lambda x: x * x)) / (list_sum(a) * list_sum(a)) + list_sum(list_transform(b, lambda x: x * x)) / (list_sum(b) * list_sum(b))) * list_sum(a) * list_sum(b))",
    "hellinger": f"sqrt(greatest(2 - 2 * {_S.format(f'sqrt({_X} * {_Y})')} / sqrt(list_sum(a) * list_sum(b)), 0))",
    "specprof": "sqrt(list_sum(list_transform(list_zip(list_transform(a, lambda x: x / list_sum(a)), list_transform(b, lambda x: x / list_sum(b))), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))",
}


def _vector_query(name: str):
    @register(f"vecdist_{name}", f"WITH {PAIR_SQL} SELECT name1, name2, round({_VEC[name]}, 5) AS dist FROM pairs")
    def query(spark: SparkSession, d: str) -> DataFrame:
        return vecdist.pairwise(vectors(spark, d), name, digits=5)

    return query


for _name in _VEC:
    _vector_query(_name)


@register("vec_chord_transform", f"WITH {VEC_SQL} SELECT name, list_transform(v, lambda x: round(x / sqrt(list_sum(list_transform(v, lambda y: y * y))), 6)) AS v FROM vecs")
def vec_chord_transform(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).select("name", F.transform(V.trans_chord("v"), lambda x: F.round(x, 6)).alias("v"))


@register("vec_column_totals", f"WITH {VEC_SQL}, x AS (SELECT unnest(v) AS x, unnest(range(len(v))) AS i FROM vecs) SELECT i::INTEGER AS i, round(sum(x), 5) AS x FROM x GROUP BY i")
def vec_column_totals(spark: SparkSession, d: str) -> DataFrame:
    t = V.column_totals(vectors(spark, d))
    return t.select(F.posexplode("colsum").alias("i", "x")).select("i", F.round("x", 5).alias("x"))


@register("vec_center_of_mass", f"WITH {VEC_SQL}, x AS (SELECT unnest(v) AS x, unnest(range(len(v))) AS i FROM vecs) SELECT i::INTEGER AS i, round(avg(x), 7) AS x FROM x GROUP BY i")
def vec_center_of_mass(spark: SparkSession, d: str) -> DataFrame:
    return V.center_of_mass(vectors(spark, d)).withColumn("x", F.round("x", 7))


@register("vec_entropy", f"WITH {VEC_SQL}, p AS (SELECT name, list_transform(v, lambda x: x / list_sum(v)) AS p FROM vecs) SELECT name, round(list_sum(list_transform(p, lambda x: CASE WHEN x > 0 THEN -x * log2(x) ELSE 0 END)), 6) AS h FROM p")
def vec_entropy(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).select("name", V.trans_specprof("v").alias("p")).select("name", F.round(V.entropy("p"), 6).alias("h"))


