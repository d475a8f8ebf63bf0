"""Secret scans through a trigram inverted index, in DataFrame operations only.

Each rule's regular expression becomes a Boolean query: an OR of clauses, each an AND of trigrams that every match
must contain (in lower case). The index holds, for the trigrams that the rules ask for, the ids of the documents
with that trigram; it is written once. A clause's postings are intersected by id, and only the candidates of a rule are
matched with its expression. A rule without mandatory trigrams is matched against all documents, in place.

Texts stay where they are while the candidates' ids are few enough to be broadcast. Beyond that a row whose own text has
none of the rarest trigrams can't be a candidate and goes on as it is; the others' texts meet the candidates by id.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

try:
    from re import _constants as sre
    from re import _parser as sre_parse
except ImportError:  # before Python 3.11
    import sre_constants as sre
    import sre_parse

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.moltype import let
from ..functions.sequence import running
from .common import materialise

#: More strings than that aren't told apart; a part of an expression then counts as anything.
MOST_STRINGS = 64
#: Trigrams of a clause that the index is asked for; fewer than all still hold for every match.
PER_CLAUSE = 2
#: Candidates whose ids are broadcast, at most; more are joined by a shuffle of the texts that may match.
FEW = 500_000


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern` whose `group` has at least `least` characters. `scan`: an expression with the same matches
    that are long enough, where there is one (a greedy run at the end can't be made longer, so short ones needn't match)."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    scan: str = ""


BASE = (
    Rule("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]+", 0, 24, r"[0-9a-f]{24,}"),
)
#: Further kinds: private key blocks, signed web tokens, keys with a provider's prefix, addresses with a password.
RULES = (
    *BASE,
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\x0A\x0D\x20]*"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("vendor", r"(ghp_|github_pat_|glpat-|xoxb-|sk_live_|npm_|AIza)[A-Za-z0-9_-]{16,}"),
    Rule("uri", r"[a-z][a-z0-9+.-]{1,15}://[^\x00-\x20:@/]+:[^\x00-\x20:@/]+@"),
)


def _strings(items) -> tuple[set[str] | None, list[set[str]]]:
    """(all strings that the items match, if they are few; for what comes before a break: sets of which one string occurs)."""
    now: set[str] = {""}
    past: list[set[str]] = []
    whole = True
    for op, arg in items:
        found: set[str] | None = None
        inner: list[set[str]] = []
        if op is sre.LITERAL:
            found = {chr(arg).lower()}
        elif op is sre.IN and all(k is sre.LITERAL for k, _ in arg):
            found = {chr(v).lower() for _, v in arg}
        elif op is sre.SUBPATTERN:
            found, inner = _strings(arg[-1])
        elif op is sre.BRANCH:
            parts = [_strings(x) for x in arg[1]]
            if all(p[0] is not None for p in parts):
                found = set().union(*(p[0] for p in parts))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, body = arg
            each, held = _strings(body)
            if high == 1 and each is not None:
                found = each | {""}
            elif low == high == 1:
                found, inner = each, held
            elif low >= 1:
                inner = held + ([each] if each is not None else [])
        elif op is sre.AT:
            continue
        if found is not None and len(now) * len(found) <= MOST_STRINGS:
            now = {a + b for a, b in product(now, found)}
        else:
            past += [now, *inner]
            now, whole = found or {""}, False
    return (now, past) if whole else (None, [*past, now])


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """The clauses of which at least one holds in every text with a match; none: any text may match."""
    exact, sets = _strings(sre_parse.parse(pattern))
    best: list[frozenset[str]] = []
    for strings in [exact] if exact is not None else sets:
        clauses = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
        if all(clauses) and clauses:
            smallest = [c for c in clauses if not any(o < c for o in clauses)]
            if not best or sum(map(len, smallest)) / len(smallest) > sum(map(len, best)) / len(best):
                best = sorted(smallest, key=sorted)
    return best


def _rare(trigram: str) -> tuple[int, str]:
    """Sorts trigrams by how rare they are likely to be in prose: first those with other characters than letters, then with rare letters."""
    return -sum(3 if not c.isalpha() else 1 if c in "jkqvwxyz" else 0 for c in trigram), trigram


def _clauses(rules: tuple[Rule, ...]) -> list[tuple[int, int, frozenset[str]]]:
    """(rule, clause, trigrams that the index is asked for)."""
    return [(i, c, frozenset(sorted(clause, key=_rare)[:PER_CLAUSE])) for i, r in enumerate(rules) for c, clause in enumerate(trigram_query(r.pattern))]


def postings(docs: DataFrame, trigrams: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The inverted index: (trigram, id) for each of `trigrams` and each row that contains it in lower case."""
    low = docs.select(F.col(id_col), F.lower(F.col(text_col)).alias("__low")).filter("__low is not null")
    held = F.array(*[F.when(F.contains(F.col("__low"), F.lit(t)), F.lit(t)) for t in trigrams])
    return low.select(F.explode(F.array_compact(held)).alias("trigram"), id_col)


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id") -> DataFrame:
    """(id, __rules): the rules, as bits by their place, whose Boolean query holds for the id.

    An id's postings meet once, as bits of the trigrams asked for; the clauses are tested on the bits.
    """
    asked = sorted({t for _, _, clause in _clauses(rules) for t in clause})
    words = range(-(-len(asked) // 60))  # longs that hold a bit for each trigram
    met = index.groupBy(id_col).agg(*[F.bit_or(_bit(asked[w * 60 : w * 60 + 60])).alias(f"__met{w}") for w in words])
    rule_bits = F.lit(0).cast("long")
    for i, _, clause in _clauses(rules):
        holds = F.lit(True)
        for w in words:
            full = sum(1 << b for b, t in enumerate(asked[w * 60 : w * 60 + 60]) if t in clause)
            holds = holds & (F.col(f"__met{w}").bitwiseAND(F.lit(full).cast("long")) == full)
        rule_bits = rule_bits.bitwiseOR(F.when(holds, F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return met.select(id_col, rule_bits.alias("__rules")).filter("__rules <> 0")


def _bit(trigrams: list[str]) -> Column:
    number = F.create_map(*[F.lit(x) for i, t in enumerate(trigrams) for x in (t, 1 << i)])[F.col("trigram")]
    return F.coalesce(number.cast("long"), F.lit(0).cast("long"))


SPAN = "struct<start:int,number:int,end:int,kind:string,from:int,to:int>"


def _spans(text: Column, rule: Rule, number: int) -> Column:
    """Matches as structs: start and end in code points, from and to in bytes. What lies between matches, and the
    matches, add up: running sums, so the work grows with the text and not with the square of its matches."""
    pattern = rule.scan or rule.pattern
    rx = F.lit(pattern)
    between = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, rx, F.lit(0))
    tested = F.regexp_extract_all(text, rx, F.lit(rule.group)) if rule.group else whole

    def made(gaps: Column, found: Column, parts: Column) -> Column:
        sizes = lambda f: F.zip_with(gaps, found, lambda b, m: f(b) + F.coalesce(f(m), F.lit(0)))
        places = lambda f: F.zip_with(running(sizes(f)), gaps, lambda at, b: at + f(b))
        rows = F.arrays_zip(places(F.length).alias("a"), places(F.octet_length).alias("o"), found.alias("m"), parts.alias("g"))
        kept = F.filter(rows, lambda x: F.length(x["g"]) >= rule.least)  # null for what follows the last match
        return F.transform(kept, lambda x: F.struct(
            x["a"].alias("start"), F.lit(number).alias("number"), (x["a"] + F.length(x["m"])).alias("end"), F.lit(rule.kind).alias("kind"),
            x["o"].alias("from"), (x["o"] + F.octet_length(x["m"])).alias("to")).cast(SPAN))

    return let(between, lambda b: let(whole, lambda m: let(tested, lambda g: made(b, m, g)) if rule.group else made(b, m, m)))


def _found(text: Column, rules: tuple[Rule, ...], asked: dict[int, Column]) -> Column:
    none = F.array().cast(f"array<{SPAN}>")
    return F.array_sort(F.concat(*[F.when(asked[i], _spans(text, r, i)).otherwise(none) for i, r in enumerate(rules) if i in asked], none))


def _located(docs: DataFrame, rules: tuple[Rule, ...], id_col: str, text_col: str) -> DataFrame:
    """(__row, __spans): every row of `docs` and its spans."""
    clauses = _clauses(rules)
    indexed = sorted({i for i, _, _ in clauses})
    rows = docs.select(F.struct(*docs.columns).alias("__row"))
    text = F.coalesce(F.col("__row")[text_col].cast("string"), F.lit(""))
    scans = {}
    for i, rule in enumerate(rules):
        if i not in indexed:
            scans[i] = text.rlike(rule.scan or rule.pattern)
    if not indexed:
        return rows.withColumn("__spans", _found(text, rules, scans))
    trigrams = sorted({t for _, _, c in clauses for t in c})
    index = materialise(postings(docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")), trigrams, "__id", "__text"), "postings")
    met = materialise(candidates(index, rules, "__id"), "candidates")
    asked = {i: F.coalesce(F.col("__rules"), F.lit(0)).bitwiseAND(F.lit(1 << i)) != 0 for i in indexed}
    own = F.col("__row")[id_col].eqNullSafe(F.col("__id"))
    if met.count() <= FEW:
        return rows.join(F.broadcast(met), own, "left").select("__row", _found(text, rules, {**scans, **asked}).alias("__spans"))
    may = F.lit(False)
    for t in sorted({min(c, key=_rare) for _, _, c in clauses}):
        may = may | F.contains(F.lower(text), F.lit(t))
    some = rows.filter(may).join(met, own, "left").select("__row", _found(text, rules, {**scans, **asked}).alias("__spans"))
    return some.unionByName(rows.filter(~may).select("__row", _found(text, rules, scans).alias("__spans")))


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with secret_spans: array of (start, number, end, kind) by start and then rule, in code points, end exclusive.

    Per rule the matches are leftmost and don't overlap; those too short are dropped after matching. A null or empty
    text has no spans. Null and repeated ids are looked up like any other: candidates are checked on the row's own
    text. Texts of any length are scanned as a whole. An empty table gives an empty result; a column named secret_spans
    is replaced, other columns stay as they were.
    """
    names = [c for c in docs.columns if c != "secret_spans"]
    public = F.transform("__spans", lambda s: F.struct(*[s[c].alias(c) for c in ("start", "number", "end", "kind")]))
    return _located(docs.select(*names), rules, id_col, text_col).select(*[F.col("__row")[c].alias(c) for c in names], public.alias("secret_spans"))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`docs` with every span of its texts replaced by `mark` (overlapping spans by one); rows without spans as they were.

    n_chars, where there is such a column, follows the new text; all other columns stay as they were. Null and empty
    texts, repeated ids and an empty table: as for scan_secrets.
    """
    text = F.col("__row")[text_col]
    raw = text.cast("string").cast("binary")

    def cut(spans: Column) -> Column:
        # bytes are cut, as places of code points would be looked for from the text's start each time
        ends = F.transform(spans, lambda s, i: F.struct(s["from"].alias("from"), s["to"].alias("to"), i.alias("i")))
        return let(ends, lambda es: let(_reach(es), lambda reach: F.array_join(F.concat(
            F.transform(F.filter(es, lambda e: F.get(reach, e["i"]) <= e["from"]), lambda e: F.concat(F.substring(raw, F.get(reach, e["i"]) + 1, e["from"] - F.get(reach, e["i"])).cast("string"), F.lit(mark))),
            F.array(F.substring(raw, F.get(reach, F.size(es)) + 1, F.lit(1 << 30)).cast("string"))), "")))

    found = _located(docs, rules, id_col, text_col)
    hit = F.size("__spans") > 0
    clean = found.withColumn("__clean", F.when(hit, cut(F.col("__spans"))).otherwise(text.cast("string")))
    out = {c: F.col("__row")[c] for c in docs.columns}
    out[text_col] = F.col("__clean")
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(hit, F.length("__clean").cast(docs.schema["n_chars"].dataType)).otherwise(out["n_chars"])
    return clean.select(*[v.alias(c) for c, v in out.items()])


def _reach(spans: Column) -> Column:
    """For each span, and after the last, how far the spans before it reach, in bytes."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def inner(ends: Column) -> Column:
        return F.aggregate(ends, start, lambda acc, x: F.struct(F.greatest(acc["at"], x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])

    # chunk by chunk, as a fold that appends copies its array each time
    ends = F.concat(F.transform(spans, lambda s: s["to"]), F.array(F.lit(0)))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(ends) - 1) / 64).cast("int")), lambda c: F.slice(ends, c * 64 + 1, F.lit(64)))
    return let(chunks, lambda cs: F.flatten(F.zip_with(F.transform(cs, inner), inner(F.transform(cs, lambda c: F.array_max(c))), lambda xs, o: F.transform(xs, lambda x: F.greatest(x, o)))))
