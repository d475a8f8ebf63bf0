"""Genetic codes: translation, frames and stops as column expressions."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .moltype import DNA, col, literal_map
from .sequence import motifs

CODONS = ["".join(c) for c in product("TCAG", repeat=3)]
# Fixed values, from the public table of genetic codes: number, amino acids and start codons in the order of CODONS, name.
PUBLIC_CODES = """
1 FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG ---M---------------M---------------M---------------------------- Standard
2 FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSS**VVVVAAAADDEEGGGG --------------------------------MMMM---------------M------------ Vertebrate Mitochondrial
3 FFLLSSSSYY**CCWWTTTTPPPPHHQQRRRRIIMMTTTTNNKKSSRRVVVVAAAADDEEGGGG ----------------------------------MM---------------M------------ Yeast Mitochondrial
4 FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG --MM---------------M------------MMMM---------------M------------ Mold Mitochondrial; Protozoan Mitochondrial; Coelenterate Mitochondrial; Mycoplasma; Spiroplasma
5 FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSSSSVVVVAAAADDEEGGGG ---M----------------------------MMMM---------------M------------ Invertebrate Mitochondrial
6 FFLLSSSSYYQQCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG -----------------------------------M---------------------------- Ciliate Nuclear; Dasycladacean Nuclear; Hexamita Nuclear
9 FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNNKSSSSVVVVAAAADDEEGGGG -----------------------------------M---------------M------------ Echinoderm Mitochondrial; Flatworm Mitochondrial
10 FFLLSSSSYY**CCCWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG -----------------------------------M---------------------------- Euplotid Nuclear
11 FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG ---M---------------M------------MMMM---------------M------------ Bacterial, Archaeal and Plant Plastid
12 FFLLSSSSYY**CC*WLLLSPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG -------------------M---------------M---------------------------- Alternative Yeast Nuclear
13 FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSSGGVVVVAAAADDEEGGGG ---M------------------------------MM---------------M------------ Ascidian Mitochondrial
14 FFLLSSSSYYY*CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNNKSSSSVVVVAAAADDEEGGGG -----------------------------------M---------------------------- Alternative Flatworm Mitochondrial
15 FFLLSSSSYY*QCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG -----------------------------------M---------------------------- Blepharisma Macronuclear
16 FFLLSSSSYY*LCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG -----------------------------------M---------------------------- Chlorophycean Mitochondrial
21 FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNNKSSSSVVVVAAAADDEEGGGG -----------------------------------M---------------M------------ Trematode Mitochondrial
22 FFLLSS*SYY*LCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG -----------------------------------M---------------------------- Scenedesmus obliquus Mitochondrial
23 FF*LSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG --------------------------------M--M---------------M------------ Thraustochytrium Mitochondrial
24 FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSSKVVVVAAAADDEEGGGG ---M---------------M---------------M---------------M------------ Rhabdopleuridae Mitochondrial
25 FFLLSSSSYY**CCGWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG ---M-------------------------------M---------------M------------ Candidate Division SR1 and Gracilibacteria
26 FFLLSSSSYY**CC*WLLLAPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG -------------------M---------------M---------------------------- Pachysolen tannophilus Nuclear
27 FFLLSSSSYYQQCCWWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG -----------------------------------M---------------------------- Karyorelict Nuclear
28 FFLLSSSSYYQQCCWWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG -----------------------------------M---------------------------- Condylostoma Nuclear
29 FFLLSSSSYYYYCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG -----------------------------------M---------------------------- Mesodinium Nuclear
30 FFLLSSSSYYEECC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG -----------------------------------M---------------------------- Peritrich Nuclear
31 FFLLSSSSYYEECCWWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG -----------------------------------M---------------------------- Blastocrithidia Nuclear
32 FFLLSSSSYY*WCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG ---M---------------M------------MMMM---------------M------------ Balanophoraceae Plastid
33 FFLLSSSSYYY*CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSSKVVVVAAAADDEEGGGG ---M---------------M---------------M---------------M------------ Cephalodiscidae Mitochondrial
"""


@dataclass(frozen=True)
class GeneticCode:
    id: int
    name: str
    amino: tuple[str, ...]
    start_map: str

    @property
    def table(self) -> dict[str, str]:
        return dict(zip(CODONS, self.amino))

    @property
    def stops(self) -> list[str]:
        return [c for c, a in self.table.items() if a == "*"]

    @property
    def starts(self) -> list[str]:
        return [c for c, m in zip(CODONS, self.start_map) if m == "M"]

    @property
    def sense(self) -> list[str]:
        return [c for c, a in self.table.items() if a != "*"]

    def codon_amino(self, codon: Column) -> Column:
        """X for codons with codes, - for gap codons."""
        return F.coalesce(literal_map(self.table)[codon], F.when(codon == "---", F.lit("-")).otherwise(F.lit("X")))

    def translate(self, s: Column | str, start: int = 0, rc: bool = False) -> Column:
        """Codon by codon from `start` (of the reverse complement with `rc`), a partial last codon left out."""
        text = DNA.rc(s) if rc else col(s)
        text = F.substring(text, F.lit(start + 1), F.length(text)) if start else text
        return F.array_join(F.transform(motifs(text, 3), self.codon_amino), "")

    def six_frames(self, s: Column | str) -> Column:
        """array<struct<strand, frame, protein>>: frames 0, 1, 2 of + and then of -."""
        return F.array(*[F.struct(F.lit("-" if rc else "+").alias("strand"), F.lit(f).alias("frame"), self.translate(s, f, rc).alias("protein")) for rc in (False, True) for f in range(3)])

    def is_stop(self, codon: Column | str) -> Column:
        return col(codon).isin(*self.stops)

    def is_start(self, codon: Column | str) -> Column:
        return col(codon).isin(*self.starts)

    def has_terminal_stop(self, s: Column | str) -> Column:
        """Whether the ungapped sequence is whole codons and ends with a stop."""
        plain = DNA.degap(s)
        return (F.length(plain) % 3 == 0) & F.right(plain, F.lit(3)).isin(*self.stops)

    def trim_stop(self, s: Column | str) -> Column:
        """Without a terminal stop: an ungapped sequence is shortened, a gapped one keeps its length."""
        text = col(s)
        stop_and_gaps = F.regexp_extract(text, "((?:" + "|".join("-*".join(c) for c in self.stops) + ")-*)$", 1)
        short = F.substring(text, F.lit(1), F.length(text) - 3)
        padded = F.concat(F.substring(text, F.lit(1), F.length(text) - F.length(stop_and_gaps)), F.repeat(F.lit("-"), F.length(stop_and_gaps)))
        return F.when(~self.has_terminal_stop(s), text).when(F.contains(text, F.lit("-")), padded).otherwise(short)

    def get_translation(self, s: Column | str, trim_stop: bool = True, include_stop: bool = False) -> Column:
        """The protein; null where a stop is left inside, unless stops are wanted."""
        protein = self.translate(self.trim_stop(s) if trim_stop else s)
        return protein if include_stop else F.when(~F.contains(protein, F.lit("*")), protein)

    def best_frame(self, s: Column | str, allow_rc: bool = False, require_stop: bool = False) -> Column:
        """1, 2, 3 (or -1, -2, -3): the frame with the fewest stops, the first of equals; null if it has more than one stop,
        or one that isn't last, or, with `require_stop`, if no frame has exactly one, at its end."""
        frames = F.slice(self.six_frames(s), 1, 6 if allow_rc else 3)
        scored = F.transform(
            frames,
            lambda f, i: F.struct(
                (F.length(f["protein"]) - F.length(F.translate(f["protein"], "*", ""))).alias("stops"),
                i.alias("i"),
                f["protein"].endswith("*").alias("last"),
                F.when(f["strand"] == "+", f["frame"] + 1).otherwise(-f["frame"] - 1).alias("frame"),
            ),
        )
        if require_stop:
            scored = F.filter(scored, lambda f: f["stops"] == 1)
        best = F.array_min(scored)
        return F.when((best["stops"] == 0) | ((best["stops"] == 1) & best["last"]), best["frame"])

    def fourfold_sets(self) -> list[list[str]]:
        """Codons that share their first two letters and their amino acid, four at a time."""
        table = self.table
        sets = [[a + b + c for c in "TCAG"] for a in "TCAG" for b in "TCAG"]
        return [s for s in sets if len({table[c] for c in s}) == 1 and table[s[0]] != "*"]

    def to_regex(self, protein: str) -> str:
        """A regular expression for all codons of an amino-acid sequence."""
        by: dict[str, list[str]] = {}
        for c, a in self.table.items():
            by.setdefault(a, []).append(c)
        return "".join("(" + "|".join(by[a]) + ")" if a in by else "..." for a in protein)

    def to_table(self, spark: SparkSession) -> DataFrame:
        rows = [(a, ",".join(c for c in CODONS if self.table[c] == a)) for a in sorted(set(self.amino))]
        return spark.createDataFrame(rows, "amino string, codons string")


def _catalogue() -> dict[int, GeneticCode]:
    rows = (line.split(" ", 3) for line in PUBLIC_CODES.strip().splitlines())
    return {int(number): GeneticCode(int(number), name, tuple(amino), starts) for number, amino, starts, name in rows}


CODES = _catalogue()


def get_code(code: int | str | GeneticCode = 1) -> GeneticCode:
    """By number, or by name as the catalogue has it."""
    if isinstance(code, GeneticCode):
        return code
    number = int(code) if str(code).isdigit() else next((k for k, v in CODES.items() if v.name == code), None)
    if number not in CODES:
        raise ValueError(f"no genetic code {code!r}")
    return CODES[number]


def available_codes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, v.name) for k, v in CODES.items()], "code_id int, name string")
