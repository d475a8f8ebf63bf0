"""Molecular types: alphabets, ambiguity codes, and column expressions over sequences as strings."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GAP, MISSING = "-", "?"

# The IUPAC nucleotide codes and the letters that each stands for.
IUPAC = {
    "R": "AG", "Y": "CT", "W": "AT", "S": "CG", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}
# Average weights of residues as the public reference tables give them (Da).
DNA_WEIGHTS = {"A": 313.21, "T": 304.2, "C": 289.18, "G": 329.21}
RNA_WEIGHTS = {"A": 329.21, "U": 306.17, "C": 305.18, "G": 345.21}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, f) -> Column:
    """f(value) with the value computed once: inside a lambda an expression would be computed for every element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def chars_in(text: Column, letters: str) -> Column:
    """How many characters of `text` are one of `letters`."""
    return F.length(text) - F.length(F.translate(text, letters, ""))


def quoted(letters: str) -> str:
    """Letters for use inside a regular expression's class."""
    return "".join("\\" + c if c in "-?*^]\\[" else c for c in letters)


def literal_map(d: dict[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


@dataclass(frozen=True)
class MolType:
    """`letters` in alphabet order; `codes`: ambiguity code to the letters it stands for."""

    name: str
    letters: str
    codes: dict[str, str] = field(default_factory=dict)
    complements: dict[str, str] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=dict)
    pairs: tuple[str, ...] = ()
    wobble: tuple[str, ...] = ()

    @property
    def degenerate(self) -> str:
        return "".join(self.codes) + MISSING

    @property
    def everything(self) -> str:
        return self.letters + "".join(self.codes) + GAP + MISSING

    # predicates
    def is_valid(self, s: Column | str) -> Column:
        return ~col(s).rlike(f"[^{quoted(self.everything)}]")

    def is_strict(self, s: Column | str) -> Column:
        return ~col(s).rlike(f"[^{quoted(self.letters)}]")

    def is_degenerate(self, s: Column | str) -> Column:
        return col(s).rlike(f"[{quoted(self.degenerate)}]")

    def has_ambiguity(self, s: Column | str) -> Column:
        return col(s).rlike(f"[{quoted(''.join(self.codes) or MISSING)}]")

    def is_gapped(self, s: Column | str) -> Column:
        return col(s).rlike(r"[\-?]")

    def is_ambiguity(self, motif: Column | str) -> Column:
        return col(motif).isin(*self.codes)

    # recoding
    def complement(self, s: Column | str) -> Column:
        return F.translate(col(s), "".join(self.complements), "".join(self.complements.values()))

    def rc(self, s: Column | str) -> Column:
        return F.reverse(self.complement(s))

    def degap(self, s: Column | str) -> Column:
        return F.translate(col(s), GAP + MISSING, "")

    def strip_degenerate(self, s: Column | str) -> Column:
        return F.translate(col(s), self.degenerate, "")

    def strip_bad(self, s: Column | str) -> Column:
        return F.regexp_replace(col(s), f"[^{quoted(self.everything)}]", "")

    def strip_bad_and_gaps(self, s: Column | str) -> Column:
        return F.regexp_replace(col(s), f"[^{quoted(self.letters + ''.join(self.codes))}]", "")

    def random_disambiguate(self, s: Column | str, seed: int = 0) -> Column:
        """Each ambiguity code as one of its letters, chosen by a hash of sequence, place and seed: the same in every run."""
        options = literal_map({k: v for k, v in self.codes.items()})
        picked = let(F.xxhash64(col(s), F.lit(seed)), lambda h: F.transform(F.split(col(s), ""), lambda c, i: F.coalesce(self._pick(options[c], F.xxhash64(h, i)), c)))
        return F.array_join(picked, "")

    @staticmethod
    def _pick(letters: Column, h: Column) -> Column:
        return F.substring(letters, F.pmod(h, F.length(letters)).cast("int") + 1, F.lit(1))

    # counts and positions
    def count_gaps(self, s: Column | str) -> Column:
        return chars_in(col(s), GAP + MISSING)

    def count_degenerate(self, s: Column | str) -> Column:
        return chars_in(col(s), self.degenerate)

    def count_ambiguous(self, s: Column | str) -> Column:
        return chars_in(col(s), "".join(self.codes) + MISSING)

    def _codes_by_size(self) -> list[tuple[int, str]]:
        by_size: dict[int, str] = {}
        for code, letters in self.codes.items():
            by_size[len(letters)] = by_size.get(len(letters), "") + code
        by_size[len(self.letters) + 1] = by_size.get(len(self.letters) + 1, "") + MISSING
        return sorted(by_size.items())

    def count_variants(self, s: Column | str) -> Column:
        """How many plain sequences the codes stand for, as a double; infinite beyond one, see log_variants."""
        return reduce(lambda a, b: a * b, (F.pow(F.lit(float(n)), chars_in(col(s), codes)) for n, codes in self._codes_by_size()))

    def log_variants(self, s: Column | str) -> Column:
        """The natural logarithm of count_variants, for texts of any length."""
        return reduce(lambda a, b: a + b, (chars_in(col(s), codes) * F.lit(math.log(n)) for n, codes in self._codes_by_size()))

    def degenerate_positions(self, s: Column | str, include_gap: bool = True) -> Column:
        """Places, from 0, of degenerate characters."""
        wanted = self.degenerate + (GAP if include_gap else "")
        flags = F.transform(F.split(col(s), ""), lambda c, i: F.when(F.instr(F.lit(wanted), c) > 0, F.when(c != "", i)))
        return F.array_compact(flags)

    def gap_vector(self, s: Column | str) -> Column:
        return F.transform(F.split(col(s), ""), lambda c: (c == GAP) | (c == MISSING))

    def mw(self, s: Column | str, delta: float = 18.0) -> Column:
        """Molecular weight of a strand: its residues and `delta` for the ends; 0 of an empty one. Codes and gaps weigh nothing."""
        total = reduce(lambda a, b: a + b, (F.lit(w) * chars_in(col(s), c) for c, w in self.weights.items()))
        return F.when(F.length(col(s)) == 0, 0.0).otherwise(total + delta)

    # ambiguity sets
    def letters_of(self, c: str) -> str:
        return self.codes.get(c, self.letters if c == MISSING else c)

    def code_of(self) -> dict[str, str]:
        """For each sorted set of letters, as a string, the code for it."""
        return {"".join(sorted(v)): k for k, v in self.codes.items()} | {c: c for c in self.letters}

    def degenerate_from_letters(self, letters: Column) -> Column:
        """The smallest code for an array of characters: gaps and codes count as what they stand for."""
        known = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.transform(letters, lambda c: F.split(F.coalesce(literal_map(self.codes)[c], c), ""))))), "")
        return F.coalesce(literal_map(self.code_of())[known], F.lit(MISSING))

    def _pairs_where(self, test) -> str:
        both = self.letters + "".join(self.codes)
        return ",".join(a + b for a, b in product(both, both) if test(a, b))

    def _zip(self, a: Column, b: Column) -> Column:
        return F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.concat(F.coalesce(x, F.lit("")), F.coalesce(y, F.lit(""))))

    def can_match(self, a: Column | str, b: Column | str) -> Column:
        """Whether every place of two sequences of one length has a letter in common."""
        table = literal_map({p: True for p in self._pairs_where(lambda x, y: bool(set(self.letters_of(x)) & set(self.letters_of(y)))).split(",")} | {"--": True, "": True})
        return F.forall(self._zip(col(a), col(b)), lambda p: F.coalesce(table[p], F.lit(False)))

    def _joint(self, x: str, y: str, pairs: tuple[str, ...], every: bool) -> bool:
        found = [p + q in pairs or q + p in pairs for p in self.letters_of(x) for q in self.letters_of(y)]
        return all(found) if every else any(found)

    def can_pair(self, a: Column | str, b: Column | str) -> Column:
        """Whether `a` could pair with `b` reversed, wobbles included."""
        table = literal_map({p: True for p in self._pairs_where(lambda x, y: self._joint(x, y, self.pairs + self.wobble, False)).split(",")} | {"": True})
        return F.forall(self._zip(col(a), F.reverse(col(b))), lambda p: F.coalesce(table[p], F.lit(False)))

    def can_mispair(self, a: Column | str, b: Column | str) -> Column:
        """Whether some place of `a` could fail to pair with `b` reversed; gaps may."""
        table = literal_map({p: False for p in self._pairs_where(lambda x, y: self._joint(x, y, self.pairs, True)).split(",")})
        return F.exists(self._zip(col(a), F.reverse(col(b))), lambda p: (p != "") & F.coalesce(table[p], F.lit(True)))

    def must_pair(self, a: Column | str, b: Column | str) -> Column:
        return ~self.can_mispair(a, b)

    def to_regex(self, s: str) -> str:
        """A regular expression for what a motif with codes stands for."""
        return "".join(f"[{self.letters_of(c)}]" if len(self.letters_of(c)) > 1 else c for c in s)

    def kmers(self, k: int) -> list[str]:
        return ["".join(p) for p in product(self.letters, repeat=k)]

    def strand_symmetric(self, k: int) -> list[tuple[str, str]]:
        """Pairs of a motif and its reverse complement, each once, without those that are their own."""
        rc = lambda m: "".join(self.complements[c] for c in reversed(m))
        return sorted({tuple(sorted((m, rc(m)))) for m in self.kmers(k) if m != rc(m)})


def _complements(t: str) -> dict[str, str]:
    one = {"A": t, t: "A", "C": "G", "G": "C"}
    plain = {k: v.replace("T", t) for k, v in IUPAC.items()}
    for code, letters in plain.items():
        turned = sorted(one[c] for c in letters)
        one[code] = next(k for k, v in plain.items() if sorted(v) == turned)
    return one | {GAP: GAP, MISSING: MISSING}


AMINO = "ACDEFGHIKLMNPQRSTUVWY"
DNA = MolType("dna", "TCAG", dict(IUPAC), _complements("T"), DNA_WEIGHTS, ("AT", "CG"), ("GT",))
RNA = MolType("rna", "UCAG", {k: v.replace("T", "U") for k, v in IUPAC.items()}, _complements("U"), RNA_WEIGHTS, ("AU", "CG"), ("GU",))
PROTEIN = MolType("protein", AMINO, {"B": "DN", "X": AMINO, "Z": "EQ"})
PROTEIN_WITH_STOP = MolType("protein_with_stop", AMINO + "*", {"B": "DN", "X": AMINO + "*", "Z": "EQ"})
TEXT = MolType("text", "".join(chr(c) for r in (range(65, 91), range(97, 123)) for c in r))
MOLTYPES = {m.name: m for m in (DNA, RNA, PROTEIN, PROTEIN_WITH_STOP, TEXT)}


def moltype(name: str) -> MolType:
    return MOLTYPES[name]


def available_moltypes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m.name, len(m.letters), m.letters) for m in MOLTYPES.values()], "name string, n_letters int, letters string")


def to_rna(s: Column | str) -> Column:
    return F.translate(col(s), "Tt", "Uu")


def to_dna(s: Column | str) -> Column:
    return F.translate(col(s), "Uu", "Tt")


# alphabets as codes
def to_indices(s: Column | str, letters: str) -> Column:
    """Each character as its place in `letters`; others as the number of letters."""
    return F.transform(F.split(col(s), ""), lambda c: F.when(F.instr(F.lit(letters), c) > 0, F.instr(F.lit(letters), c) - 1).otherwise(len(letters)))


def from_indices(codes: Column | str, letters: str) -> Column:
    return F.array_join(F.transform(col(codes), lambda i: F.substring(F.lit(letters), i + 1, F.lit(1))), "")


def kmer_index(kmer: Column, letters: str) -> Column:
    """A k-mer as a number in base len(letters); null with other characters."""
    n = len(letters)
    digits = F.transform(F.split(kmer, ""), lambda c: F.when(F.instr(F.lit(letters), c) > 0, F.instr(F.lit(letters), c) - 1).cast("long"))
    return F.aggregate(digits, F.lit(0).cast("long"), lambda acc, d: acc * n + d)


def kmer_from_index(index: Column | str, k: int, letters: str) -> Column:
    n = len(letters)
    places = [F.pmod(F.floor(col(index) / n**p), F.lit(n)) for p in range(k - 1, -1, -1)]
    return F.concat(*[F.substring(F.lit(letters), p.cast("int") + 1, F.lit(1)) for p in places])


def letters_with_gap(letters: str, gap: str = GAP) -> str:
    return letters if gap in letters else letters + gap


def letters_subset(letters: str, motifs: str, excluded: bool = False) -> str:
    """Those of the alphabet that are among `motifs`, or aren't, in its order."""
    return "".join(c for c in letters if (c in motifs) != excluded)


def convert_indices(codes: Column | str, letters: str, to: str) -> Column:
    """Places in one alphabet as places in another; letters that it lacks as its size."""
    place = literal_map({i: to.index(c) if c in to else len(to) for i, c in enumerate(letters)})
    return F.transform(col(codes), lambda i: F.coalesce(place[i], F.lit(len(to))))
