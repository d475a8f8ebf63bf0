"""Column expressions over one sequence, or two of them, held as strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .moltype import DNA, GAP, MISSING, MolType, chars_in, col, let, literal_map, quoted


def kmers(s: Column | str, k: int, strict: MolType | None = None) -> Column:
    """All overlapping k-mers in order, in one pass over the text; `strict`: those of its letters only."""
    one = f"[{quoted(strict.letters)}]" if strict else "."
    return F.regexp_extract_all(col(s), F.lit(f"(?s)(?=({one}{{{k}}}))"), F.lit(1))


def motifs(s: Column | str, k: int, remainder: bool = False) -> Column:
    """Words of k characters one after the other; the last, shorter one only with `remainder`."""
    return F.regexp_extract_all(col(s), F.lit(f"(?s).{{{1 if remainder else k},{k}}}"), F.lit(0))


def windows(s: Column | str, window: int, step: int, start: int = 0, end: int | None = None) -> Column:
    """Windows at start, start + step, …, each wholly inside; `end`: no window begins at it or later."""
    text = col(s) if not start else F.substring(col(s), F.lit(start + 1), F.length(col(s)))
    if end is not None:
        text = F.substring(text, F.lit(1), F.lit(max(0, end - start) + window - 1))
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{window}}})).{{1,{step}}}"), F.lit(1))


def count_sub(s: Column | str, part: str) -> Column:
    """Occurrences that don't overlap."""
    return ((F.length(col(s)) - F.length(F.replace(col(s), F.lit(part)))) / len(part)).cast("int")


def gap_positions(s: Column | str) -> Column:
    return F.array_compact(F.transform(F.split(col(s), ""), lambda c, i: F.when((c == GAP) | (c == MISSING), i)))


def running(lengths: Column) -> Column:
    """For each entry of array<int> the sum of those before it. Chunk by chunk: a fold that appends copies its array each
    time, so a single one would take the square of the length."""
    kind = "array<int>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def inner(chunk: Column) -> Column:
        return F.aggregate(chunk, start, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])

    def whole(v: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / 64).cast("int"))
        chunks = F.transform(numbers, lambda c: F.slice(v, c * 64 + 1, F.lit(64)))
        return let(chunks, lambda cs: F.flatten(F.zip_with(F.transform(cs, inner), inner(F.transform(cs, lambda c: F.aggregate(c, F.lit(0), lambda acc, x: acc + x))), lambda xs, o: F.transform(xs, lambda x: x + o))))

    return let(lengths, lambda v: F.when(F.size(v) > 0, whole(v)).otherwise(F.array().cast(kind)))


def _runs(s: Column | str) -> Column:
    """Stretches of gaps and of other characters, in turn."""
    return F.regexp_extract_all(col(s), F.lit(r"[\-?]+|[^\-?]+"), F.lit(0))


def _gap_runs(s: Column | str, ungapped: bool) -> Column:
    def spans(parts: Column) -> Column:
        is_gap = lambda p: p.rlike(r"^[\-?]")
        at = running(F.transform(parts, lambda p: F.when(is_gap(p) & F.lit(ungapped), 0).otherwise(F.length(p))))
        both = F.zip_with(parts, at, lambda p, n: F.when(is_gap(p), F.struct(n.alias("pos"), F.length(p).alias("length"))))
        return F.array_compact(both)

    return let(_runs(s), spans)


def gap_spans(s: Column | str) -> Column:
    """Runs of gaps as structs (pos, length), pos being the place in the ungapped sequence."""
    return _gap_runs(s, True)


def gap_align_spans(s: Column | str) -> Column:
    """Runs of gaps as structs (pos, length), pos being the place in the gapped sequence."""
    return _gap_runs(s, False)


def nongap_spans(s: Column | str) -> Column:
    """Ungapped stretches as structs (start, stop) in the gapped sequence."""

    def spans(parts: Column) -> Column:
        at = running(F.transform(parts, F.length))
        both = F.zip_with(parts, at, lambda p, n: F.when(~p.rlike(r"^[\-?]"), F.struct(n.alias("start"), (n + F.length(p)).alias("stop"))))
        return F.array_compact(both)

    return let(_runs(s), spans)


def align_index(s: Column | str, seq_index: Column) -> Column:
    """The place in the gapped sequence of a place in the ungapped one."""
    return seq_index + F.aggregate(F.filter(gap_spans(s), lambda g: g["pos"] <= seq_index), F.lit(0), lambda acc, g: acc + g["length"])


def seq_index(s: Column | str, align: Column) -> Column:
    """The place in the ungapped sequence of a place in the gapped one: letters before it."""
    return F.length(F.translate(F.substring(col(s), F.lit(1), align), GAP + MISSING, ""))


def compose_gapped(s: Column | str, gaps: Column) -> Column:
    """The ungapped sequence with runs of gaps (pos, length) put back, in the order of pos."""

    def text(x: Column) -> Column:
        ends = F.concat(F.transform(x["g"], lambda g: F.struct(g["pos"].alias("pos"), g["length"].alias("length"))), F.array(F.struct(F.length(x["s"]).alias("pos"), F.lit(0).alias("length"))))
        starts = F.concat(F.array(F.lit(0)), F.transform(x["g"], lambda g: g["pos"]))
        parts = F.zip_with(starts, ends, lambda a, e: F.concat(F.array_join(F.slice(x["c"], a + 1, e["pos"] - a), ""), F.repeat(F.lit(GAP), e["length"])))
        return F.array_join(parts, "")

    return let(F.struct(col(s).alias("s"), F.split(col(s), "").alias("c"), F.array_sort(gaps).alias("g")), text)


def with_termini_unknown(s: Column | str) -> Column:
    """Gaps at both ends as missing characters."""
    left = F.length(F.regexp_extract(col(s), r"^-*", 0))
    right = F.when(left == F.length(col(s)), 0).otherwise(F.length(F.regexp_extract(col(s), r"-*$", 0)))
    middle = F.substring(col(s), left + 1, F.length(col(s)) - left - right)
    return F.concat(F.repeat(F.lit(MISSING), left), middle, F.repeat(F.lit(MISSING), right))


def shuffled(s: Column | str, seed: int) -> Column:
    """The characters in an order given by a hash of sequence, place and seed."""
    keyed = let(F.xxhash64(col(s), F.lit(seed)), lambda h: F.transform(F.split(col(s), ""), lambda c, i: F.struct(F.xxhash64(h, i).alias("k"), c.alias("c"))))
    return F.array_join(F.transform(F.array_sort(keyed), lambda x: x["c"]), "")


def sampled(s: Column | str, n: int, seed: int, motif: int = 1, replace: bool = False) -> Column:
    """n motifs drawn by hash: with replacement, or the first n of a shuffled order."""
    words, h = motifs(s, motif), F.xxhash64(col(s), F.lit(seed))
    if replace:
        pick = lambda w: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.element_at(w["w"], F.pmod(F.xxhash64(w["h"], i), F.size(w["w"])).cast("int") + 1))
        return F.array_join(let(F.struct(words.alias("w"), h.alias("h")), pick), "")
    keyed = let(h, lambda k: F.transform(words, lambda w, i: F.struct(F.xxhash64(k, i).alias("k"), w.alias("w"))))
    return F.array_join(F.transform(F.slice(F.array_sort(keyed), 1, n), lambda x: x["w"]), "")


# two sequences, over the places that both have
def _zip(a: Column | str, b: Column | str, f) -> Column:
    n = F.least(F.length(col(a)), F.length(col(b)))
    return F.zip_with(F.split(F.substring(col(a), F.lit(1), n), ""), F.split(F.substring(col(b), F.lit(1), n), ""), f)


def _total(flags: Column) -> Column:
    return F.aggregate(flags, F.lit(0), lambda acc, x: acc + x.cast("int"))


def _is_gap(c: Column) -> Column:
    return (c == GAP) | (c == MISSING)


def diff(a: Column | str, b: Column | str) -> Column:
    return _total(_zip(a, b, lambda x, y: x != y))


def frac_same(a: Column | str, b: Column | str) -> Column:
    n = F.least(F.length(col(a)), F.length(col(b)))
    return F.when(n > 0, _total(_zip(a, b, lambda x, y: x == y)) / n).otherwise(0.0)


def frac_diff(a: Column | str, b: Column | str) -> Column:
    n = F.least(F.length(col(a)), F.length(col(b)))
    return F.when(n > 0, diff(a, b) / n).otherwise(0.0)


def frac_same_gaps(a: Column | str, b: Column | str) -> Column:
    n = F.least(F.length(col(a)), F.length(col(b)))
    return F.when(n > 0, _total(_zip(a, b, lambda x, y: _is_gap(x) == _is_gap(y))) / n).otherwise(0.0)


def frac_diff_gaps(a: Column | str, b: Column | str) -> Column:
    n = F.least(F.length(col(a)), F.length(col(b)))
    return F.when(n > 0, 1 - frac_same_gaps(a, b)).otherwise(0.0)


def frac_same_non_gaps(a: Column | str, b: Column | str) -> Column:
    both = _total(_zip(a, b, lambda x, y: ~_is_gap(x) & ~_is_gap(y)))
    return F.when(both > 0, _total(_zip(a, b, lambda x, y: ~_is_gap(x) & ~_is_gap(y) & (x == y))) / both).otherwise(0.0)


def frac_diff_non_gaps(a: Column | str, b: Column | str) -> Column:
    both = _total(_zip(a, b, lambda x, y: ~_is_gap(x) & ~_is_gap(y)))
    return F.when(both > 0, _total(_zip(a, b, lambda x, y: ~_is_gap(x) & ~_is_gap(y) & (x != y))) / both).otherwise(0.0)


def frac_similar(a: Column | str, b: Column | str, pairs: list[tuple[str, str]]) -> Column:
    table = literal_map({x + y: True for x, y in pairs})
    n = F.least(F.length(col(a)), F.length(col(b)))
    return F.when(n > 0, _total(_zip(a, b, lambda x, y: F.coalesce(table[F.concat(x, y)], F.lit(False)))) / n).otherwise(0.0)


def matrix_distance(a: Column | str, b: Column | str, scores: dict[tuple[str, str], float]) -> Column:
    """The sum of the matrix's cells for each place; pairs that it lacks make the result null."""
    table = literal_map({x + y: float(v) for (x, y), v in scores.items()})
    return F.aggregate(_zip(a, b, lambda x, y: table[F.concat(x, y)]), F.lit(0.0), lambda acc, v: acc + v)


# text forms
def to_fasta(name: Column | str, s: Column | str, block: int = 60) -> Column:
    wrapped = F.array_join(motifs(s, block, remainder=True), "\n")
    return F.concat(F.lit(">"), col(name).cast("string"), F.lit("\n"), wrapped)


def to_phylip(name: Column | str, s: Column | str, width: int = 28) -> Column:
    return F.concat(F.rpad(col(name).cast("string"), width, " "), F.lit("  "), col(s))


def strand_symmetry_pairs(k: int, mt: MolType = DNA) -> Column:
    """Motif to the smaller of itself and its reverse complement, as a map."""
    return literal_map({m: min(pair) for pair in mt.strand_symmetric(k) for m in pair})


def canonical_length(s: Column | str, mt: MolType = DNA) -> Column:
    """Letters that are neither gaps nor codes."""
    return chars_in(col(s), mt.letters)
