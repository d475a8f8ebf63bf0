"""Sequence functions over the documents' DNA-like letters, whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import moltype as M
from ..functions import sequence as S
from ..functions.genetic_code import CODONS, get_code
from ..operators import alignment as A
from ..operators import distance as D
from ..session import table
from .registry import register
from .views import BENCH_SQL, CODES_SQL, DNA_SQL, codes, dna

GC = get_code(1)
CODON_MAP = "MAP {" + ", ".join(f"'{c}': '{GC.table[c]}'" for c in CODONS) + "}"


def translated(seq: str) -> str:
    """SQL for the protein of a DNA expression."""
    return f"array_to_string(list_transform(range(0, length({seq}) - 2, 3), lambda i: {CODON_MAP}[substr({seq}, i + 1, 3)]), '')"


@register("seq_reverse_complement", f"WITH {DNA_SQL} SELECT name, md5(reverse(translate(seq, 'ACGT', 'TGCA'))) AS rc FROM seqs")
def seq_reverse_complement(spark: SparkSession, d: str) -> DataFrame:
    return dna(spark, d).select("name", F.md5(M.DNA.rc("seq")).alias("rc"))


@register("seq_rna", f"WITH {DNA_SQL} SELECT name, md5(replace(seq, 'T', 'U')) AS rna FROM seqs")
def seq_rna(spark: SparkSession, d: str) -> DataFrame:
    return dna(spark, d).select("name", F.md5(M.to_rna("seq")).alias("rna"))


@register("seq_complement_codes", f"WITH {CODES_SQL} SELECT name, md5(translate(seq, 'ACGTRYKMSWBDHVN', 'TGCAYRMKSWVHDBN')) AS c FROM seqs")
def seq_complement_codes(spark: SparkSession, d: str) -> DataFrame:
    return codes(spark, d).select("name", F.md5(M.DNA.complement("seq")).alias("c"))


@register("seq_predicates", f"""WITH {CODES_SQL} SELECT name, regexp_matches(seq, '[RYKMSWBDHVN]') AS degenerate, contains(seq, '-') AS gapped, NOT regexp_matches(seq, '[^ACGT]') AS strict,
  true AS valid FROM seqs""")
def seq_predicates(spark: SparkSession, d: str) -> DataFrame:
    m = M.DNA
    return codes(spark, d).select("name", m.is_degenerate("seq").alias("degenerate"), m.is_gapped("seq").alias("gapped"), m.is_strict("seq").alias("strict"), m.is_valid("seq").alias("valid"))


@register("seq_character_counts", f"""WITH {CODES_SQL} SELECT name, length(seq) - length(replace(seq, '-', '')) AS gaps, length(regexp_replace(seq, '[ACGT-]', '', 'g')) AS degenerate, length(regexp_replace(seq, '[^ACGT]', '', 'g')) AS plain FROM seqs""")
def seq_character_counts(spark: SparkSession, d: str) -> DataFrame:
    m = M.DNA
    return codes(spark, d).select("name", m.count_gaps("seq").cast("long").alias("gaps"), m.count_degenerate("seq").cast("long").alias("degenerate"), S.canonical_length("seq").cast("long").alias("plain"))


@register("seq_variants_log", f"""WITH {CODES_SQL} SELECT name, round(length(regexp_replace(seq, '[^RYKMSW]', '', 'g')) * ln(2) + length(regexp_replace(seq, '[^BDHV]', '', 'g')) * ln(3) + length(regexp_replace(seq, '[^N]', '', 'g')) * ln(4), 4) AS v FROM seqs""")
def seq_variants_log(spark: SparkSession, d: str) -> DataFrame:
    """Every sequence, however many variants it has."""
    return codes(spark, d).select("name", F.round(M.DNA.log_variants("seq"), 4).alias("v"))


@register("seq_strip", f"WITH {CODES_SQL} SELECT name, md5(regexp_replace(seq, '[RYKMSWBDHVN]', '', 'g')) AS stripped, md5(replace(seq, '-', '')) AS degapped FROM seqs")
def seq_strip(spark: SparkSession, d: str) -> DataFrame:
    return codes(spark, d).select("name", F.md5(M.DNA.strip_degenerate("seq")).alias("stripped"), F.md5(M.DNA.degap("seq")).alias("degapped"))


@register("seq_weight", f"""WITH {DNA_SQL} SELECT name, CASE WHEN seq = '' THEN 0 ELSE round(313.21 * (length(seq) - length(replace(seq, 'A', ''))) + 304.2 * (length(seq) - length(replace(seq, 'T', '')))
  + 289.18 * (length(seq) - length(replace(seq, 'C', ''))) + 329.21 * (length(seq) - length(replace(seq, 'G', ''))) + 18, 2) END::DOUBLE AS mw FROM seqs""")
def seq_weight(spark: SparkSession, d: str) -> DataFrame:
    return dna(spark, d).select("name", F.round(M.DNA.mw("seq"), 2).alias("mw"))


@register("seq_count_kmers", f"""WITH {DNA_SQL}, k AS (SELECT name, unnest(list_transform(range(1, length(seq) - 1), lambda i: substr(seq, i, 3))) AS kmer FROM seqs)
SELECT name, kmer, count(*) AS n FROM k GROUP BY ALL""")
def seq_count_kmers(spark: SparkSession, d: str) -> DataFrame:
    return A.count_kmers(dna(spark, d), 3)


@register("seq_count_kmers_strict", f"""WITH {CODES_SQL}, k AS (SELECT name, unnest(list_transform(range(1, length(seq) - 2), lambda i: substr(seq, i, 4))) AS kmer FROM seqs)
SELECT name, kmer, count(*) AS n FROM k WHERE NOT regexp_matches(kmer, '[^ACGT]') GROUP BY ALL""")
def seq_count_kmers_strict(spark: SparkSession, d: str) -> DataFrame:
    return A.count_kmers(codes(spark, d), 4)


@register("seq_motif_counts", f"""WITH {CODES_SQL}, k AS (SELECT name, unnest(list_transform(range(0, length(seq) - 1, 2), lambda i: substr(seq, i + 1, 2))) AS motif FROM seqs)
SELECT name, motif, count(*) AS n FROM k WHERE NOT regexp_matches(motif, '[^ACGT]') GROUP BY ALL""")
def seq_motif_counts(spark: SparkSession, d: str) -> DataFrame:
    return A.counts_per_seq(codes(spark, d), 2)


@register("seq_entropy", f"""WITH {DNA_SQL}, k AS (SELECT name, unnest(string_split(seq, '')) AS c FROM seqs WHERE seq <> ''), n AS (SELECT name, c, count(*) AS n FROM k WHERE c <> '' GROUP BY ALL),
p AS (SELECT name, n / sum(n) OVER (PARTITION BY name) AS p FROM n) SELECT name, round(-sum(p * log2(p)), 6) + 0.0 AS entropy FROM p GROUP BY ALL""")
def seq_entropy(spark: SparkSession, d: str) -> DataFrame:
    return A.entropy_per_seq(dna(spark, d)).select("name", (F.round("entropy", 6) + 0.0).alias("entropy"))


@register("seq_sliding_windows", f"""WITH {DNA_SQL}, w AS (SELECT name, unnest(range(0, length(seq) - 49, 25)) AS start, seq FROM seqs)
SELECT name, start::INTEGER AS start, length(regexp_replace(substr(seq, start + 1, 50), '[^GC]', '', 'g'))::INTEGER AS gc FROM w""")
def seq_sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    return A.sliding_windows(dna(spark, d), 50, 25).select("name", "start", M.chars_in(F.col("seq"), "GC").alias("gc"))


@register("seq_translation", f"WITH {DNA_SQL} SELECT name, md5({translated('seq')}) AS protein FROM seqs")
def seq_translation(spark: SparkSession, d: str) -> DataFrame:
    return dna(spark, d).select("name", F.md5(GC.translate("seq")).alias("protein"))


_FRAMES = " UNION ALL ".join(f"SELECT name, '{s}' AS strand, {f} AS frame, {translated(f'substr({x}, {f + 1})')} AS p FROM t" for s, x in (("+", "seq"), ("-", "rc")) for f in range(3))


@register("seq_six_frames", f"WITH {DNA_SQL}, t AS (SELECT name, seq, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM seqs), x AS ({_FRAMES}) SELECT name, strand, frame::INTEGER AS frame, (length(p) - length(replace(p, '*', '')))::INTEGER AS stops FROM x")
def seq_six_frames(spark: SparkSession, d: str) -> DataFrame:
    rows = dna(spark, d).select("name", F.explode(GC.six_frames("seq")).alias("f"))
    return rows.select("name", "f.strand", "f.frame", M.chars_in(F.col("f.protein"), "*").alias("stops"))


@register("seq_best_frame", f"""WITH {DNA_SQL}, t AS (SELECT name, seq, '' AS rc FROM seqs), x AS ({' UNION ALL '.join(_FRAMES.split(' UNION ALL ')[:3])}),
s AS (SELECT name, frame, length(p) - length(replace(p, '*', '')) AS stops, p LIKE '%*' AS last FROM x), b AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY stops, frame) AS r FROM s)
SELECT name, CASE WHEN stops = 0 OR stops = 1 AND last THEN frame + 1 END::INTEGER AS frame FROM b WHERE r = 1""")
def seq_best_frame(spark: SparkSession, d: str) -> DataFrame:
    return dna(spark, d).select("name", GC.best_frame("seq").alias("frame"))


@register("seq_terminal_stop", f"WITH {DNA_SQL} SELECT name, length(seq) % 3 = 0 AND right(seq, 3) IN ('TAA', 'TAG', 'TGA') AS stop, length(seq) - CASE WHEN length(seq) % 3 = 0 AND right(seq, 3) IN ('TAA', 'TAG', 'TGA') THEN 3 ELSE 0 END AS trimmed FROM seqs")
def seq_terminal_stop(spark: SparkSession, d: str) -> DataFrame:
    return dna(spark, d).select("name", GC.has_terminal_stop("seq").alias("stop"), F.length(GC.trim_stop("seq")).cast("long").alias("trimmed"))


@register("seq_kmer_index", f"""WITH {BENCH_SQL}, k AS (SELECT name, unnest(list_transform(range(1, length(seq) - 2), lambda i: substr(seq, i, 4))) AS kmer FROM seqs)
SELECT DISTINCT kmer, (64 * (instr('TCAG', kmer[1]) - 1) + 16 * (instr('TCAG', kmer[2]) - 1) + 4 * (instr('TCAG', kmer[3]) - 1) + instr('TCAG', kmer[4]) - 1)::BIGINT AS i FROM k""")
def seq_kmer_index(spark: SparkSession, d: str) -> DataFrame:
    rows = dna(spark, d, "benchmark", "item_id").select(F.explode(S.kmers("seq", 4)).alias("kmer")).distinct()
    return rows.select("kmer", M.kmer_index(F.col("kmer"), "TCAG").alias("i"))


@register("seq_gap_runs", f"WITH {CODES_SQL} SELECT name, len(regexp_extract_all(seq, '-+'))::INTEGER AS runs, (length(seq) - length(replace(seq, '-', '')))::INTEGER AS total FROM seqs")
def seq_gap_runs(spark: SparkSession, d: str) -> DataFrame:
    rows = codes(spark, d).select("name", S.gap_spans("seq").alias("g"))
    return rows.select("name", F.size("g").alias("runs"), F.aggregate("g", F.lit(0), lambda acc, x: acc + x["length"]).alias("total"))


@register("seq_gap_round_trip", f"WITH {CODES_SQL} SELECT name, md5(seq) AS seq FROM seqs")
def seq_gap_round_trip(spark: SparkSession, d: str) -> DataFrame:
    rows = codes(spark, d).select("name", M.DNA.degap("seq").alias("plain"), S.gap_spans("seq").alias("g"))
    return rows.select("name", F.md5(S.compose_gapped("plain", F.col("g"))).alias("seq"))


@register("seq_fasta", f"WITH {DNA_SQL} SELECT name, md5('>' || name || chr(10) || array_to_string(regexp_extract_all(seq, '.{{1,60}}'), chr(10))) AS fasta FROM seqs")
def seq_fasta(spark: SparkSession, d: str) -> DataFrame:
    return dna(spark, d).select("name", F.md5(S.to_fasta("name", "seq")).alias("fasta"))


@register("seq_termini_unknown", f"""WITH {CODES_SQL}, t AS (SELECT name, seq, length(seq) - length(ltrim(seq, '-')) AS l, CASE WHEN ltrim(seq, '-') = '' THEN 0 ELSE length(seq) - length(rtrim(seq, '-')) END AS r FROM seqs)
SELECT name, md5(repeat('?', l) || substr(seq, l + 1, length(seq) - l - r) || repeat('?', r)) AS s FROM t""")
def seq_termini_unknown(spark: SparkSession, d: str) -> DataFrame:
    return codes(spark, d).select("name", F.md5(S.with_termini_unknown("seq")).alias("s"))


@register("seq_strand_symmetry", f"""WITH {DNA_SQL}, k AS (SELECT name, unnest(string_split(seq, '')) AS c FROM seqs WHERE seq <> ''), n AS (SELECT name, c, count(*) AS n FROM k WHERE c <> '' GROUP BY ALL),
c AS (SELECT name, CASE WHEN c IN ('A', 'T') THEN 'AT' ELSE 'CG' END AS pair, sum(CASE WHEN c IN ('A', 'C') THEN n ELSE 0 END) AS a, sum(CASE WHEN c IN ('T', 'G') THEN n ELSE 0 END) AS b FROM n GROUP BY ALL),
t AS (SELECT *, sum(a) OVER (PARTITION BY name) AS ta, sum(b) OVER (PARTITION BY name) AS tb FROM c)
SELECT name, round(2 * sum(CASE WHEN a > 0 THEN a * ln(a * (ta + tb) / ((a + b) * ta)) ELSE 0 END + CASE WHEN b > 0 THEN b * ln(b * (ta + tb) / ((a + b) * tb)) ELSE 0 END), 4) + 0.0 AS G, count(*) - 1 AS df FROM t GROUP BY name""")
def seq_strand_symmetry(spark: SparkSession, d: str) -> DataFrame:
    return A.strand_symmetry(dna(spark, d)).select("name", (F.round("G", 4) + 0.0).alias("G"), "df")


@register("seq_motif_probs", f"""WITH {CODES_SQL}, k AS (SELECT unnest(string_split(seq, '')) AS motif FROM seqs), n AS (SELECT motif, count(*) AS n FROM k WHERE motif IN ('A', 'C', 'G', 'T') GROUP BY motif) SELECT motif, round(n / sum(n) OVER (), 8) AS p FROM n""")
def seq_motif_probs(spark: SparkSession, d: str) -> DataFrame:
    return A.motif_probs(codes(spark, d)).select("motif", F.round("p", 8).alias("p"))


@register("seq_identical_sets", f"WITH {DNA_SQL} SELECT list(name ORDER BY name) AS names FROM seqs GROUP BY seq HAVING count(*) > 1")
def seq_identical_sets(spark: SparkSession, d: str) -> DataFrame:
    return A.identical_sets(dna(spark, d))


@register("seq_drop_duplicated", f"WITH {DNA_SQL} SELECT min(name) AS name FROM seqs GROUP BY seq")
def seq_drop_duplicated(spark: SparkSession, d: str) -> DataFrame:
    return A.drop_duplicated_seqs(dna(spark, d)).select("name")


@register("seq_lengths", f"WITH {CODES_SQL} SELECT name, length(regexp_replace(seq, '[^ACGTRYKMSWBDHVN]', '', 'g')) AS length FROM seqs")
def seq_lengths(spark: SparkSession, d: str) -> DataFrame:
    return A.get_lengths(codes(spark, d), include_ambiguity=True).withColumn("length", F.col("length").cast("long"))


@register("seq_neighbour_fractions", f"""WITH {CODES_SQL}, t AS (SELECT name, seq, lead(seq) OVER (ORDER BY name) AS other FROM seqs), n AS (SELECT *, least(length(seq), length(other)) AS n FROM t WHERE other IS NOT NULL),
p AS (SELECT name, n, unnest(range(1, n + 1)) AS i, seq, other FROM n WHERE n > 0)
SELECT name, round(avg((seq[i] = other[i])::INTEGER), 8) AS same, sum((seq[i] <> other[i])::INTEGER)::INTEGER AS diff, round(avg(((seq[i] = '-') = (other[i] = '-'))::INTEGER), 8) AS same_gaps FROM p GROUP BY name""")
def seq_neighbour_fractions(spark: SparkSession, d: str) -> DataFrame:
    rows = A.with_following(codes(spark, d)).filter("length(seq) > 0 AND length(other) > 0")
    return rows.select("name", F.round(S.frac_same("seq", "other"), 8).alias("same"), S.diff("seq", "other").alias("diff"), F.round(S.frac_same_gaps("seq", "other"), 8).alias("same_gaps"))


_SETS = f"{BENCH_SQL}, k AS (SELECT DISTINCT name, unnest(list_transform(range(1, length(seq) - 4), lambda i: substr(seq, i, 6))) AS kmer FROM seqs), s AS (SELECT name, count(*) AS n FROM k GROUP BY ALL), j AS (SELECT a.name AS name1, b.name AS name2, count(*) AS shared FROM k a JOIN k b ON a.kmer = b.kmer AND a.name < b.name GROUP BY ALL), u AS (SELECT p.name AS name1, q.name AS name2, coalesce(p2.n, 0) AS n1, coalesce(q2.n, 0) AS n2 FROM seqs p JOIN seqs q ON p.name < q.name LEFT JOIN s p2 ON p2.name = p.name LEFT JOIN s q2 ON q2.name = q.name), r AS (SELECT u.name1, u.name2, CASE WHEN n1 + n2 = 0 THEN 0 ELSE 1 - coalesce(shared, 0) / (n1 + n2 - coalesce(shared, 0)) END AS dist FROM u LEFT JOIN j ON u.name1 = j.name1 AND u.name2 = j.name2)"


@register("dist_jaccard", f"WITH {_SETS} SELECT name1, name2, round(dist, 8) AS dist FROM r")
def dist_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return D.jaccard_dist(dna(spark, d, "benchmark", "item_id"), 6).withColumn("dist", F.round("dist", 8))


@register("dist_jaccard_shared", f"WITH {_SETS} SELECT r.name1, r.name2, round(dist, 8) AS dist FROM r JOIN j ON r.name1 = j.name1 AND r.name2 = j.name2")
def dist_jaccard_shared(spark: SparkSession, d: str) -> DataFrame:
    return D.jaccard_shared(dna(spark, d, "benchmark", "item_id"), 6).withColumn("dist", F.round("dist", 8))


_POLY = f"{D.JACCARD_TO_P[0]!r}::DOUBLE"
for _c in D.JACCARD_TO_P[1:]:
    _POLY = f"({_POLY} * dist + {_c!r}::DOUBLE)"


@register("dist_approx_pdist", f"WITH {_SETS} SELECT name1, name2, round({_POLY}, 5) AS dist FROM r")
def dist_approx_pdist(spark: SparkSession, d: str) -> DataFrame:
    return D.approx_pdist(D.jaccard_dist(dna(spark, d, "benchmark", "item_id"), 6)).withColumn("dist", F.round("dist", 5))


@register("seq_pad", f"WITH {BENCH_SQL}, m AS (SELECT max(length(seq)) AS n FROM seqs) SELECT name, md5(rpad(seq, n::INTEGER, '-')) AS s FROM seqs, m")
def seq_pad(spark: SparkSession, d: str) -> DataFrame:
    return A.pad_seqs(dna(spark, d, "benchmark", "item_id")).select("name", F.md5("seq").alias("s"))


@register("seq_take_semi", f"WITH {BENCH_SQL} SELECT name, length(seq) AS n FROM seqs WHERE name IN (SELECT doc_id FROM labels WHERE quality = 1)")
def seq_take_semi(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "labels").filter("quality = 1").select(F.col("doc_id").alias("name"))
    return A.take_seqs(dna(spark, d, "benchmark", "item_id"), names).select("name", F.length("seq").cast("long").alias("n"))


@register("cigar_round_trip", f"WITH {CODES_SQL} SELECT name, list_sum(list_transform(regexp_extract_all(seq, '-+'), lambda x: length(x)))::BIGINT AS gaps FROM seqs")
def cigar_round_trip(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.formats import cigar_gaps, to_cigar

    rows = codes(spark, d).select("name", cigar_gaps(to_cigar(F.col("seq"))).alias("g"))
    total = F.aggregate("g", F.lit(0).cast("long"), lambda acc, x: acc + x["length"])
    return rows.select("name", F.when(F.size("g") > 0, total).alias("gaps"))
