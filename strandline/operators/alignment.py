"""Collections and alignments: rows (name, ord, seq). Row-local work stays on strings; per-column work explodes to
(name, ord, pos, ch) and aggregates at once."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.genetic_code import GeneticCode, get_code
from ..functions.moltype import DNA, GAP, MISSING, MolType, chars_in, let, literal_map, quoted
from ..functions.sequence import kmers, motifs, windows


def make_seqs(spark: SparkSession, data: dict[str, str] | Sequence[tuple[str, str]]) -> DataFrame:
    rows = list(data.items()) if isinstance(data, dict) else list(data)
    return spark.createDataFrame([(n, i, s) for i, (n, s) in enumerate(rows)], "name string, ord int, seq string")


def checked_alignment(seqs: DataFrame) -> DataFrame:
    """The rows, if all lengths are equal and no name repeats."""
    r = seqs.agg(F.min(F.length("seq")).alias("a"), F.max(F.length("seq")).alias("b"), F.count("name").alias("n"), F.count_distinct("name").alias("d")).first()
    if r.a != r.b or r.n != r.d:
        raise ValueError("lengths differ" if r.a != r.b else "names repeat")
    return seqs


# rows
def take_seqs(seqs: DataFrame, names: Sequence[str] | DataFrame, negate: bool = False) -> DataFrame:
    """Named rows, in the order of the names; a table of names is joined."""
    if isinstance(names, DataFrame):
        return seqs.join(names.select("name").distinct(), "name", "left_anti" if negate else "left_semi")
    if negate:
        return seqs.filter(~F.col("name").isin(*names))
    order = literal_map({n: i for i, n in enumerate(names)})
    return seqs.filter(F.col("name").isin(*names)).withColumn("ord", order[F.col("name")])


def take_seqs_if(seqs: DataFrame, p: Column, negate: bool = False) -> DataFrame:
    return seqs.filter(~p if negate else p)


def add_seqs(seqs: DataFrame, other: DataFrame) -> DataFrame:
    clash = seqs.join(other, "name", "left_semi").limit(1).count()
    if clash:
        raise ValueError("names repeat")
    top = seqs.agg(F.coalesce(F.max("ord") + 1, F.lit(0)).alias("__top"))
    return seqs.unionByName(other.crossJoin(F.broadcast(top)).withColumn("ord", F.col("ord") + F.col("__top")).drop("__top"))


def renamed_seqs(seqs: DataFrame, renamer: dict[str, str] | Callable[[Column], Column]) -> DataFrame:
    c = F.coalesce(literal_map(renamer)[F.col("name")], F.col("name")) if isinstance(renamer, dict) else renamer(F.col("name"))
    return seqs.withColumn("name", c)


def per_seq(seqs: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    """Every sequence through a column expression: degap, rc, translation and so on."""
    return seqs.withColumn("seq", f(F.col("seq")))


def get_lengths(seqs: DataFrame, mt: MolType = DNA, include_ambiguity: bool = False, allow_gap: bool = False) -> DataFrame:
    letters = mt.letters + ("".join(mt.codes) if include_ambiguity else "") + (GAP + MISSING if allow_gap else "")
    return seqs.select("name", chars_in(F.col("seq"), letters).alias("length"))


def has_terminal_stop(seqs: DataFrame, gc: GeneticCode | None = None) -> DataFrame:
    return seqs.agg(F.bool_or((gc or get_code()).has_terminal_stop("seq")).alias("has_stop"))


def is_ragged(seqs: DataFrame) -> DataFrame:
    return seqs.agg((F.min(F.length("seq")) != F.max(F.length("seq"))).alias("ragged"))


def pad_seqs(seqs: DataFrame, length: int | None = None) -> DataFrame:
    if length is not None:
        return seqs.withColumn("seq", F.rpad("seq", length, GAP))
    longest = F.broadcast(seqs.agg(F.max(F.length("seq")).alias("__n")))
    return seqs.crossJoin(longest).withColumn("seq", F.rpad("seq", F.col("__n"), F.lit(GAP))).drop("__n")


def duplicated_seqs(seqs: DataFrame) -> DataFrame:
    """Sequences that several names have: (seq, n, names in order). Names of a group are listed, so they are meant to fit a row."""
    return seqs.groupBy("seq").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("name")).alias("names")).filter("n > 1")


def identical_sets(seqs: DataFrame, mt: MolType = DNA, mask_degenerate: bool = False) -> DataFrame:
    """Names with one sequence. With `mask_degenerate` codes and gaps compare as one mark, by place."""
    key = F.regexp_replace("seq", f"[^{quoted(mt.letters)}]", MISSING) if mask_degenerate else F.col("seq")
    return seqs.groupBy(key.alias("key")).agg(F.array_sort(F.collect_set("name")).alias("names")).filter(F.size("names") > 1).select("names")


def drop_duplicated_seqs(seqs: DataFrame) -> DataFrame:
    """Of each sequence the first row."""
    first = seqs.groupBy("seq").agg(F.min(F.struct("ord", "name")).alias("r"))
    return first.select("r.name", "r.ord", "seq")


def get_similar(seqs: DataFrame, target: str, metric: Callable[[Column, Column], Column], low: float = 0.0, high: float = 1.0) -> DataFrame:
    return seqs.filter(metric(F.col("seq"), F.lit(target)).between(low, high))


def ambiguous_positions(seqs: DataFrame, mt: MolType = DNA) -> DataFrame:
    return long_form(seqs).filter(F.col("ch").isin(*mt.codes, MISSING)).select("name", "pos", "ch")


# counts
def _wanted(mt: MolType, include_ambiguity: bool, allow_gap: bool) -> str:
    return f"^[{quoted(mt.letters + (''.join(mt.codes) + MISSING if include_ambiguity else '') + (GAP if allow_gap else ''))}]*$"


def motif_rows(seqs: DataFrame, k: int = 1, mt: MolType = DNA, include_ambiguity: bool = False, allow_gap: bool = False) -> DataFrame:
    """(name, motif): words of k that don't overlap, the remainder dropped."""
    rows = seqs.select("name", F.explode(motifs("seq", k)).alias("motif"))
    return rows.filter(F.col("motif").rlike(_wanted(mt, include_ambiguity, allow_gap)))


def counts_per_seq(seqs: DataFrame, k: int = 1, **options) -> DataFrame:
    return motif_rows(seqs, k, **options).groupBy("name", "motif").agg(F.count(F.lit(1)).alias("n"))


def counts(seqs: DataFrame, k: int = 1, **options) -> DataFrame:
    return motif_rows(seqs, k, **options).groupBy("motif").agg(F.count(F.lit(1)).alias("n"))


def probs_per_seq(seqs: DataFrame, k: int = 1, **options) -> DataFrame:
    c = counts_per_seq(seqs, k, **options)
    return c.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy("name")))


def entropy_per_seq(seqs: DataFrame, k: int = 1, **options) -> DataFrame:
    c = counts_per_seq(seqs, k, **options)
    return c.groupBy("name").agg((F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("entropy"))


def motif_probs(seqs: DataFrame, mt: MolType = DNA, include_ambiguity: bool = False, pseudocount: float = 0.0) -> DataFrame:
    """Pooled frequencies of the letters; a code counts in equal parts as what it stands for; the pseudocount starts every letter."""
    spark = seqs.sparkSession
    share = [(c, x, 1.0 / len(mt.letters_of(c))) for c in mt.letters + ("".join(mt.codes) if include_ambiguity else "") for x in mt.letters_of(c)]
    parts = F.broadcast(spark.createDataFrame(share, "motif string, letter string, w double"))
    seen = counts(seqs, 1, mt=mt, include_ambiguity=include_ambiguity).join(parts, "motif").groupBy("letter").agg(F.sum(F.col("n") * F.col("w")).alias("n"))
    every = spark.createDataFrame([(c,) for c in mt.letters], "letter string")
    filled = every.join(seen, "letter", "left").withColumn("n", F.coalesce("n", F.lit(0.0)) + pseudocount)
    return filled.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy(F.lit(1)))).select(F.col("letter").alias("motif"), "p")


def count_kmers(seqs: DataFrame, k: int, mt: MolType = DNA) -> DataFrame:
    """(name, kmer, n) of overlapping k-mers of plain letters; one with any other character doesn't count."""
    rows = seqs.select("name", F.explode(kmers("seq", k, mt)).alias("kmer"))
    return rows.groupBy("name", "kmer").agg(F.count(F.lit(1)).alias("n"))


def sliding_windows(seqs: DataFrame, window: int, step: int) -> DataFrame:
    rows = seqs.select("name", F.posexplode(windows("seq", window, step)).alias("i", "seq"))
    return rows.select("name", (F.col("i") * step).alias("start"), "seq")


def strand_symmetry(seqs: DataFrame, k: int = 1, mt: MolType = DNA) -> DataFrame:
    """(name, G, df): the G statistic of motif against reverse-complement counts, over pairs with any count."""
    pairs = mt.strand_symmetric(k)
    first = literal_map({m: p[0] for p in pairs for m in p})
    c = counts_per_seq(seqs, k, mt=mt).withColumn("pair", first[F.col("motif")]).filter("pair IS NOT NULL")
    cells = c.groupBy("name", "pair").agg(F.sum(F.when(F.col("motif") == F.col("pair"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("motif") != F.col("pair"), F.col("n")).otherwise(0)).alias("b"))
    w = W.partitionBy("name")
    t = cells.withColumns({"ta": F.sum("a").over(w), "tb": F.sum("b").over(w)})
    row = F.col("a") + F.col("b")
    term = lambda o, s: F.when(F.col(o) > 0, F.col(o) * F.ln(F.col(o) * (F.col("ta") + F.col("tb")) / (row * F.col(s)))).otherwise(0.0)
    return t.groupBy("name").agg((2 * F.sum(term("a", "ta") + term("b", "tb"))).alias("G"), (F.count(F.lit(1)) - 1).alias("df"))


# columns
def long_form(aln: DataFrame) -> DataFrame:
    return aln.select("name", "ord", F.posexplode(F.split("seq", "")).alias("pos", "ch")).filter("ch <> ''")


def motif_columns(aln: DataFrame, k: int = 1) -> DataFrame:
    """(name, ord, pos, ch): words of k as columns, the remainder dropped."""
    return long_form(aln) if k == 1 else aln.select("name", "ord", F.posexplode(motifs("seq", k)).alias("pos", "ch"))


def gap_condition(c: Column, include_ambiguity: bool = True) -> Column:
    return F.contains(c, F.lit(GAP)) | F.contains(c, F.lit(MISSING)) if include_ambiguity else F.contains(c, F.lit(GAP))


def take_positions(aln: DataFrame, cols: Sequence[int], negate: bool = False) -> DataFrame:
    """Columns by place, in the given order, repeats kept; a short list, sent with the plan."""
    chars = F.split(F.col("seq"), "")
    if negate:
        kept = F.filter(chars, lambda c, i: ~i.isin(*cols)) if cols else chars
        return aln.withColumn("seq", F.array_join(kept, ""))
    return aln.withColumn("seq", F.concat(*[F.substring("seq", c + 1, 1) for c in cols]) if cols else F.lit(""))


def take_columns(aln: DataFrame, kept: DataFrame, k: int = 1) -> DataFrame:
    """The rows with only the motif columns of `kept` (pos). The kept places are one sorted array, a row's length at most."""
    places = F.broadcast(kept.agg(F.array_sort(F.collect_set("pos")).alias("__kept")))
    words = F.split("seq", "") if k == 1 else motifs("seq", k)
    text = F.array_join(let(words, lambda w: F.transform(F.col("__kept"), lambda p: F.try_element_at(w, p + 1))), "")
    return aln.crossJoin(places).withColumn("seq", text).drop("__kept")


def columns_where(aln: DataFrame, test: Column, k: int = 1) -> DataFrame:
    """(pos) of motif columns for which an aggregate over `ch` is true."""
    return motif_columns(aln, k).groupBy("pos").agg(test.alias("__ok")).filter("__ok").select("pos")


def filtered(aln: DataFrame, test: Column, k: int = 1) -> DataFrame:
    return take_columns(aln, columns_where(aln, test, k), k)


def no_degenerates(aln: DataFrame, mt: MolType = DNA, k: int = 1, allow_gap: bool = False) -> DataFrame:
    return filtered(aln, F.bool_and(F.col("ch").rlike(f"^[{quoted(mt.letters + (GAP if allow_gap else ''))}]*$")), k)


def omit_gap_pos(aln: DataFrame, allowed: float | None = None, k: int = 1) -> DataFrame:
    """Without motif columns that have more gaps than allowed: all but one row by default, or a fraction rounded down."""
    n = F.count(F.lit(1))
    limit = n - 1 if allowed is None else F.floor(n * allowed)
    return filtered(aln, F.count_if(gap_condition(F.col("ch"))) <= limit, k)


def degapped_relative_to(aln: DataFrame, name: str) -> DataFrame:
    kept = long_form(aln.filter(F.col("name") == name)).filter(~gap_condition(F.col("ch"))).select("pos")
    return take_columns(aln, kept)


def matching_ref(aln: DataFrame, ref: str, gap_fraction: float, gap_run: int) -> DataFrame:
    """Rows whose gaps, where they differ from the reference's, are few and have no run of `gap_run`."""
    target = F.broadcast(aln.filter(F.col("name") == ref).select(F.col("seq").alias("__ref")))
    marks = F.zip_with(F.split("seq", ""), F.split("__ref", ""), lambda a, b: F.when(gap_condition(a) != gap_condition(b), F.lit("1")).otherwise(F.lit("0")))
    rows = aln.crossJoin(target).withColumn("__m", F.array_join(marks, ""))
    few = chars_in(F.col("__m"), "1") <= gap_fraction * F.length("seq")
    return rows.filter(few & ~F.contains(F.col("__m"), F.lit("1" * gap_run))).drop("__m", "__ref")


def count_gaps_per_pos(aln: DataFrame, include_ambiguity: bool = True) -> DataFrame:
    return long_form(aln).groupBy("pos").agg(F.count_if(gap_condition(F.col("ch"), include_ambiguity)).alias("gaps"))


def count_gaps_per_seq(aln: DataFrame, induced_by: bool = False, unique: bool = False, include_ambiguity: bool = True) -> DataFrame:
    """Gaps in columns with any gap; `induced_by`: letters opposite gaps; `unique`: letters that alone in their column aren't gaps."""
    g = gap_condition(F.col("ch"), include_ambiguity).cast("int")
    w = W.partitionBy("pos")
    rows = long_form(aln).withColumn("__g", g).withColumns({"__gaps": F.sum("__g").over(w), "__n": F.count(F.lit(1)).over(w)})
    if unique:
        hit = (F.col("__g") == 0) & (F.col("__gaps") == F.col("__n") - 1)
    elif induced_by:
        hit = (F.col("__g") == 0) & (F.col("__gaps") > 0)
    else:
        hit = F.col("__g") == 1
    return rows.groupBy("name").agg(F.count_if(hit).alias("gaps"))


def omit_bad_seqs(aln: DataFrame, quantile: float | None = None) -> DataFrame:
    """Without rows that alone cause more gaps than the quantile, (n - 1) / n by default."""
    u = count_gaps_per_seq(aln, unique=True)
    if quantile is None:
        n = aln.count()
        quantile = (n - 1) / n if n else 1.0
    cut = F.broadcast(u.agg(F.percentile("gaps", quantile).alias("__cut")))
    return aln.join(u.crossJoin(cut).filter("gaps <= __cut").select("name"), "name", "left_semi")


def counts_per_pos(aln: DataFrame, k: int = 1, mt: MolType = DNA, include_ambiguity: bool = False, allow_gap: bool = False) -> DataFrame:
    rows = motif_columns(aln, k).filter(F.col("ch").rlike(_wanted(mt, include_ambiguity, allow_gap)))
    return rows.groupBy("pos", F.col("ch").alias("motif")).agg(F.count(F.lit(1)).alias("n"))


def probs_per_pos(aln: DataFrame, k: int = 1, **options) -> DataFrame:
    c = counts_per_pos(aln, k, **options)
    return c.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy("pos")))


def entropy_per_pos(aln: DataFrame, k: int = 1, **options) -> DataFrame:
    c = counts_per_pos(aln, k, **options)
    return c.groupBy("pos").agg((F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("entropy"))


def information_per_pos(aln: DataFrame, states: int = 4, window: int = 1, **options) -> DataFrame:
    """log2(states) minus the entropy, averaged over `window` columns around each place."""
    e = entropy_per_pos(aln, **options).withColumn("__i", math.log2(states) - F.col("entropy"))
    around = W.partitionBy(F.lit(1)).orderBy("pos").rowsBetween(-(window // 2), (window - 1) // 2)
    return e.select("pos", F.avg("__i").over(around).alias("information"))


def variable_positions(aln: DataFrame, mt: MolType = DNA, k: int = 1, include_gap: bool = True, include_ambiguity: bool = False) -> DataFrame:
    """Columns with more than one state; those with gaps or codes left out unless these are included."""
    plain = F.col("ch").rlike(f"^[{quoted(mt.letters)}]*$")
    allowed = mt.letters + (GAP + MISSING if include_gap else "") + ("".join(mt.codes) if include_ambiguity else "")
    states = F.count_distinct(F.when(plain, F.col("ch"))) if include_gap and not include_ambiguity else F.count_distinct("ch")
    fine = F.bool_and(F.col("ch").rlike(f"^[{quoted(allowed)}]*$"))
    return columns_where(aln, (states > 1) & fine, k)


def _joined(by_pos: DataFrame, c: str) -> DataFrame:
    return by_pos.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", c))), lambda x: x[c]), "").alias("consensus"))


def majority_consensus(aln: DataFrame) -> DataFrame:
    """One row: the most frequent character of each column, the largest of equals."""
    n = long_form(aln).groupBy("pos", "ch").agg(F.count(F.lit(1)).alias("n"))
    return _joined(n.groupBy("pos").agg(F.max_by("ch", F.struct("n", "ch")).alias("c")), "c")


def iupac_consensus(aln: DataFrame, mt: MolType = DNA) -> DataFrame:
    """One row: the code for each column's letters; gaps count as nothing but in columns of gaps alone."""
    letters = F.filter(F.collect_set("ch"), lambda c: (c != GAP) & (c != MISSING))
    by = long_form(aln).groupBy("pos").agg(letters.alias("letters"))
    return _joined(by.withColumn("c", F.when(F.size("letters") == 0, F.lit(GAP)).otherwise(mt.degenerate_from_letters(F.col("letters")))), "c")


def column_order(length: int, n: int, seed: int, k: int = 1, replace: bool = False) -> list[int]:
    """Places of sampled motif columns, by a seeded generator on the driver: as many as an alignment is long."""
    import random

    r = random.Random(seed)
    at = [r.randrange(length // k) for _ in range(n)] if replace else r.sample(range(length // k), n)
    return [p * k + i for p in at for i in range(k)]


def sample(aln: DataFrame, n: int | None = None, seed: int = 0, k: int = 1, replace: bool = False) -> DataFrame:
    length = aln.agg(F.max(F.length("seq"))).first()[0] or 0
    return take_positions(aln, column_order(length, n if n is not None else length // k, seed, k, replace))


def sample_with(aln: DataFrame, order: Sequence[int]) -> DataFrame:
    return take_positions(aln, order)


def apply_scaled_gaps(seqs: DataFrame, guide: DataFrame, factor: int = 3) -> DataFrame:
    """Ungapped codon rows with the gaps of their aligned proteins, `factor` characters for each."""
    from ..functions.sequence import compose_gapped, gap_spans

    g = guide.select("name", F.transform(gap_spans("seq"), lambda x: F.struct((x["pos"] * factor).alias("pos"), (x["length"] * factor).alias("length"))).alias("__g"))
    return seqs.join(g, "name").withColumn("seq", compose_gapped("seq", F.col("__g"))).drop("__g")


def to_pretty(aln: DataFrame, ref: str) -> DataFrame:
    """Rows with . where they equal the reference row."""
    target = F.broadcast(aln.filter(F.col("name") == ref).select(F.col("seq").alias("__ref")))
    dots = F.zip_with(F.split("seq", ""), F.split("__ref", ""), lambda a, b: F.when(a == b, F.lit(".")).otherwise(a))
    return aln.crossJoin(target).withColumn("seq", F.when(F.col("name") == ref, F.col("seq")).otherwise(F.array_join(dots, ""))).drop("__ref")


# apps over alignments
def concat(alns: Sequence[DataFrame], intersect: bool = True, fill: str = MISSING) -> DataFrame:
    """Alignments side by side by name: names that all have, or all names with missing characters in place of lost rows."""
    lengths = [a.agg(F.max(F.length("seq"))).first()[0] or 0 for a in alns]
    out = alns[0].select("name", "ord", F.col("seq").alias("__0"))
    for i, a in enumerate(alns[1:], 1):
        out = out.join(a.select("name", F.col("ord").alias("__o"), F.col("seq").alias(f"__{i}")), "name", "inner" if intersect else "full")
        out = out.withColumn("ord", F.coalesce("ord", "__o")).drop("__o")
    parts = [F.coalesce(F.col(f"__{i}"), F.lit(fill * n)) for i, n in enumerate(lengths)]
    return out.select("name", "ord", F.concat(*parts).alias("seq"))


def with_following(seqs: DataFrame, per_part: int = 4096) -> DataFrame:
    """`other`: the seq of the next row in the order of names, which are numbers, null on the last. Rows are dealt to ranges
    between quantiles of the names, so that no task has them all; the first row of a range follows the last of the one before."""
    n = seqs.count()
    parts = min(max(n // per_part, 1), 2000)
    found = seqs.agg(F.percentile_approx("name", [i / parts for i in range(1, parts)], 10000)).first()[0] if parts > 1 else []
    # every bound is a name of the table, so no range but the first is empty
    bounds = sorted(set(found))

    def range_of(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high + 1) // 2
        return F.when(F.col("name") >= F.lit(bounds[middle - 1]), range_of(middle, high)).otherwise(range_of(low, middle - 1))

    rows = seqs.withColumn("__range", range_of(0, len(bounds)))
    firsts = rows.groupBy("__range").agg(F.min(F.struct("name", "seq")).alias("f")).select((F.col("__range") - 1).alias("__range"), F.col("f.seq").alias("__after"))
    w = W.partitionBy("__range").orderBy("name", "seq")
    rows = rows.withColumn("__next", F.lead(F.struct("seq")).over(w)).join(firsts, "__range", "left")
    return rows.withColumn("other", F.when(F.col("__next").isNull(), F.col("__after")).otherwise(F.col("__next.seq"))).drop("__range", "__next", "__after")


def take_codon_positions(aln: DataFrame, positions: Sequence[int] = (3,), gc: GeneticCode | None = None, fourfold: bool = False) -> DataFrame:
    """Columns at the given places of codons (1 to 3), or third places of columns within one four-fold degenerate set."""
    if not fourfold:
        kept = F.filter(F.split("seq", ""), lambda c, i: (i % 3 + 1).isin(*positions) & (c != ""))
        return aln.withColumn("seq", F.array_join(kept, ""))
    sets = {c: i for i, s in enumerate((gc or get_code()).fourfold_sets()) for c in s}
    number = literal_map(sets)[F.col("ch")]
    ok = (F.count(number) == F.count(F.lit(1))) & (F.min(number) == F.max(number))
    kept = columns_where(aln, ok, 3)
    return per_seq(take_columns(aln, kept, 3), lambda s: F.regexp_replace(s, "..(.)", "$1"))


def fixed_length(seqs: DataFrame, length: int, start: str | int = 0, k: int = 1) -> DataFrame:
    """Rows cut to `length` from a start, `first` or `last`; shorter ones are dropped."""
    rows = seqs.filter(F.length("seq") >= length)
    begin = F.lit(0) if start == "first" else F.length("seq") - length if start == "last" else F.lit(int(start))
    return rows.withColumn("seq", F.substring("seq", begin + 1, F.lit(length)))


def omit_duplicated(seqs: DataFrame, choose: str | None = "longest", mt: MolType = DNA) -> DataFrame:
    """One row per degapped sequence: the longest, or, with None, no row of a sequence that repeats."""
    key = mt.degap("seq")
    w = W.partitionBy("__k")
    rows = seqs.withColumn("__k", key)
    if choose is None:
        return rows.withColumn("__n", F.count(F.lit(1)).over(w)).filter("__n = 1").drop("__k", "__n")
    best = rows.groupBy("__k").agg(F.max_by(F.struct("name", "ord", "seq"), F.struct(F.length("seq"), -F.col("ord"))).alias("r"))
    return best.select("r.*")
