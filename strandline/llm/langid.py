"""Language identification by interpolated Kneser-Ney character models, one per language.

A document's words (runs of letters and their combining marks in lower case, between two boundary marks) are scored
character by character under each language's model; the language with the lowest cross-entropy per character wins. The
models lie in sorted arrays of n-gram hashes whose rows hold the languages' log-probabilities, and likewise context
hashes with back-off weights. Counts come from the whole texts of all labelled rows; they are counted on the executors,
and only n-gram counts, all of them, reach the driver, whose memory grows with the number of different n-grams and not with
the rows. The limit beyond which a text is rejected comes from all labelled rows too: they are dealt to two folds by a hash
of the id, and each fold is scored by models of the other one's counts.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Characters in the longest n-grams.
ORDER = 4
#: Different words that a task counts before it hands on their n-grams.
HELD = 500_000
#: Words whose scores a worker keeps.
CACHE = 200_000
#: A text of n characters is rejected if its cross-entropy is over MARGIN · (1 + SHORT / n) times the QUANTILE of the
#: labelled rows of its language: a few characters can't tell that a language is unknown.
QUANTILE, MARGIN, SHORT = 0.99, 1.5, 16
BEGIN, END = "\x02", "\x03"
#: Runs of letters and marks with a letter in them; digits, underscores and all else part words. In plain ASCII the first does.
ASCII, RUNS = re.compile(r"[a-z]+"), regex.compile(r"\p{M}*\p{L}[\p{L}\p{M}]*")


def words_of(text: str | None) -> list[str]:
    """A text's words, all letters and their marks in lower case; none if it has no letter."""
    low = (text or "").lower()
    return ASCII.findall(low) if low.isascii() else RUNS.findall(low)


_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _M2
    return h ^ (h >> np.uint64(29))


def hashes(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """For k = 0 … order: at each place the hash of the k characters that end there. (k = 0: a constant.)"""
    codes = codes.astype(np.uint64)
    out = [np.full(len(codes), _M1, dtype=np.uint64)]
    power = np.uint64(1)
    with np.errstate(over="ignore"):
        acc = np.zeros(len(codes), dtype=np.uint64)
        for k in range(order):
            shifted = np.zeros_like(codes)
            shifted[k:] = codes[: len(codes) - k] if k else codes
            acc = acc + (shifted + np.uint64(1)) * power
            power = power * _M1
            out.append(_mix(acc + np.uint64(k + 1) * _M2))
    return out


@dataclass
class Model:
    """langs; per order 1 … n: grams (sorted hashes, rows × languages log2-probabilities), contexts (sorted hashes, log2 back-off weights)."""

    langs: list[str]
    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    unknown: np.ndarray  # log2-probability of a character that no language has, by language
    limit: list[float]

    def word_bits(self, words: list[str]) -> np.ndarray:
        """For each word and language, minus the log2-probability of its characters and its end."""
        text = "".join(f"{BEGIN}{w}{END}" for w in words)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        of = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
        place = np.arange(len(codes)) - np.repeat(np.cumsum([len(w) + 2 for w in words]) - [len(w) + 2 for w in words], [len(w) + 2 for w in words])
        order = len(self.grams)
        h = hashes(codes, order)
        total = np.zeros((len(codes), len(self.langs)), dtype=np.float32)
        left = np.flatnonzero(place > 0)  # the begin mark isn't predicted
        for k in range(order, 0, -1):
            here = left[place[left] >= k - 1]
            keys, logs = self.grams[k - 1]
            if not len(here) or not len(keys):
                continue
            at = np.minimum(np.searchsorted(keys, h[k][here]), len(keys) - 1)
            hit = keys[at] == h[k][here]
            total[here[hit]] += logs[at[hit]]
            done = np.zeros(len(codes), dtype=bool)
            done[here[hit]] = True
            miss = here[~hit]
            if k > 1 and len(miss):
                keys, logs = self.contexts[k - 1]
                if len(keys):
                    context = h[k - 1][miss - 1]
                    at = np.minimum(np.searchsorted(keys, context), len(keys) - 1)
                    seen = keys[at] == context
                    total[miss[seen]] += logs[at[seen]]
            left = left[~done[left]]
        total[left] += self.unknown
        out = np.empty((len(words), len(self.langs)))
        for j in range(len(self.langs)):
            out[:, j] = -np.bincount(of, weights=total[:, j], minlength=len(words))
        return out


def build(counts: dict[str, dict[str, int]], order: int = ORDER) -> Model:
    """The models from each language's counts of n-grams of the longest order, and of shorter ones that begin a word."""
    langs = sorted(counts)
    alphabet = {c for grams in counts.values() for g in grams for c in g} - {BEGIN}
    uniform = 1.0 / (len(alphabet) + 1)
    probs: list[list[dict[str, float]]] = []
    backs: list[list[dict[str, float]]] = []
    for lang in langs:
        level: list[dict[str, float]] = [defaultdict(float) for _ in range(order + 1)]
        for g, n in counts[lang].items():
            level[len(g)][g] += n
        for k in range(order, 1, -1):  # shorter n-grams inside words count the characters seen before them
            for g in level[k]:
                level[k - 1][g[1:]] += 1
        p: list[dict[str, float]] = [{} for _ in range(order + 1)]
        back: list[dict[str, float]] = [{} for _ in range(order + 1)]
        p[0][""] = uniform
        for k in range(1, order + 1):
            grams = {g: n for g, n in level[k].items() if g != BEGIN}
            once, twice = sum(n == 1 for n in grams.values()), sum(n == 2 for n in grams.values())
            discount = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5
            total: dict[str, float] = defaultdict(float)
            kinds: Counter = Counter()
            for g, n in grams.items():
                total[g[:-1]] += n
                kinds[g[:-1]] += 1
            for h, n in total.items():
                back[k][h] = discount * kinds[h] / n
            for g, n in grams.items():
                p[k][g] = max(n - discount, 0.0) / total[g[:-1]] + back[k][g[:-1]] * p[k - 1][g[1:]]
        probs.append(p)
        backs.append(back)

    def value(i: int, g: str) -> float:
        k = len(g)
        if not k:
            return uniform
        known = probs[i][k].get(g)
        return known if known is not None else backs[i][k].get(g[:-1], 1.0) * value(i, g[1:])

    def packed(keys: list[str], rows: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
        if not keys:
            return np.zeros(0, np.uint64), np.zeros((0, len(langs)), np.float32)
        k = len(keys[0])
        codes = np.frombuffer("".join(keys).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        h = hashes(codes, k)[k][k - 1 :: k] if k else np.array([_M1])
        by = np.argsort(h, kind="stable")
        return h[by], np.log2(np.array(rows))[by].astype(np.float32)

    grams, contexts = [], []
    for k in range(1, order + 1):
        keys = sorted({g for i in range(len(langs)) for g in probs[i][k]})
        grams.append(packed(keys, [[value(i, g) for i in range(len(langs))] for g in keys]))
        heads = sorted({g for i in range(len(langs)) for g in backs[i][k]})
        contexts.append(packed(heads, [[backs[i][k].get(g, 1.0) for i in range(len(langs))] for g in heads]) if k > 1 else packed([], []))
    unknown = np.log2([uniform * backs[i][1].get("", 1.0) for i in range(len(langs))]).astype(np.float32)
    return Model(langs, grams, contexts, unknown, [math.inf] * len(langs))


def word_grams(words: Counter, order: int = ORDER) -> Counter:
    out: Counter = Counter()
    for w, n in words.items():
        s = f"{BEGIN}{w}{END}"
        for i in range(2, len(s) + 1):
            out[s[max(0, i - order) : i]] += n
    return out


def fold_of(key: Column) -> Column:
    """0 or 1 by a hash of the id, so rows that repeat an id are in one fold; a null id counts as empty text."""
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit("")), F.lit("fold")), F.lit(2)).cast("int")


def fit(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER) -> Model | None:
    """Models from all rows that `train` keeps and whose text and language aren't null; None without any.

    Rows that repeat an id count each. The limits come from the same rows, each scored by models of the fold that it isn't in;
    rows of a language that the other fold lacks give none. A language without a limit takes the widest of the others (no
    limit if there is none). Texts of any length are counted as a whole.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kept = docs.filter(train).filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = kept.select(F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text"), fold_of(F.col(id_col)).alias("fold"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[tuple[str, int], Counter] = defaultdict(Counter)

        def handed_on() -> Iterator[pa.RecordBatch]:
            for (lang, fold), c in words.items():
                grams = word_grams(c, order)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array([fold] * len(grams), pa.int32()), pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())], ["lang", "fold", "gram", "n"])
            words.clear()

        for b in batches:
            for lang, text, fold in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                words[lang, fold].update(words_of(text.as_py()))
            if sum(map(len, words.values())) > HELD:
                yield from handed_on()
        yield from handed_on()

    each = [F.sum(F.when(F.col("fold") == i, F.col("n")).otherwise(0)).alias(f"n{i}") for i in range(2)]
    found = rows.mapInArrow(count, "lang string, fold int, gram string, n long").groupBy("lang", "gram").agg(*each).toArrow().to_pydict()
    counts: tuple[dict, dict, dict] = ({}, {}, {})
    for lang, g, *n in zip(found["lang"], found["gram"], found["n0"], found["n1"]):
        for held, m in zip(counts, (*n, sum(n))):
            if m:
                held.setdefault(lang, {})[g] = m
    del found
    if not counts[2]:
        return None
    model = build(counts[2], order)
    halves = spark.sparkContext.broadcast([build(c, order) if c else None for c in (counts[1], counts[0])])  # by the fold that they score

    def bits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = [Scorer(m) for m in halves.value]
        for b in batches:
            folds = b.column(2).to_numpy()
            for fold, scorer in enumerate(scorers):
                part = b.filter(pa.array(folds == fold))
                if part.num_rows and scorer.model:
                    lang, _, bits, _ = scorer(part.column(1))
                    known = np.isin(part.column(0).to_numpy(zero_copy_only=False).astype(str), scorer.model.langs) & ~np.isnan(bits)
                    yield pa.RecordBatch.from_arrays([pa.array(lang[known], pa.string()), pa.array(bits[known])], ["lang_pred", "bits"])

    scored = rows.mapInArrow(bits_of, "lang_pred string, bits double").groupBy("lang_pred").agg(F.percentile_approx("bits", QUANTILE, F.lit(10_000)).alias("q"))
    for r in scored.collect():
        model.limit[model.langs.index(r[0])] = MARGIN * r[1]
    worst = max((x for x in model.limit if x < math.inf), default=math.inf)
    model.limit = [min(x, worst) for x in model.limit]
    return model


class Scorer:
    """Scores batches of texts; keeps the scores of words seen lately."""

    def __init__(self, model: Model | None) -> None:
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.bits = np.zeros((0, len(self.model.langs) if self.model else 0), dtype=np.float32)
        self.chars = np.zeros(0, dtype=np.int64)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per text: language, share, bits a character (nan: no letter), rejected."""
        m, n = self.model, len(texts)
        words: list[str] = []
        sizes = np.zeros(n, dtype=np.int64)
        for i, t in enumerate(texts):
            found = words_of(t.as_py()) if m else []
            sizes[i] = len(found)
            words += found
        if len(self.known) > CACHE:
            self.clear()
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            fresh = [m.word_bits(new[i : i + 20_000]).astype(np.float32) for i in range(0, len(new), 20_000)]
            self.bits = np.concatenate([self.bits, *fresh])
            self.chars = np.concatenate([self.chars, np.array([len(w) + 1 for w in new])])
        ids = np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))
        of = np.repeat(np.arange(n), sizes)
        length = np.bincount(of, weights=self.chars[ids], minlength=n) if len(ids) else np.zeros(n)
        has = length > 0
        lang, share, best, reject = np.full(n, "und", dtype=object), np.zeros(n), np.full(n, np.nan), np.ones(n, dtype=bool)
        if has.any():
            each = np.stack([np.bincount(of, weights=self.bits[ids, j], minlength=n) for j in range(len(m.langs))], axis=1)[has] / length[has, None]
            pick = each.argmin(axis=1)
            best[has] = each[np.arange(len(pick)), pick]
            lang[has] = np.array(m.langs, dtype=object)[pick]
            odds = np.exp2(-(each - best[has, None]) * np.minimum(length[has], 40)[:, None])
            share[has] = 1 / odds.sum(axis=1)
            reject[has] = best[has] > np.array(m.limit)[pick] * (1 + SHORT / length[has])
        return lang, share, best, reject


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, bits, rejected): per row of `docs` the language, its share among the languages (0 to 1),
    the cross-entropy in bits a character, and whether the calibrated limit rejects it.

    A null text, a text without letters, or no model at all: und, 0, null, rejected. Ties go to the language that
    sorts first. Repeated rows are scored each, texts of any length as a whole; other columns don't matter, and an empty
    table gives an empty result. The share weighs each language by 2 to the power of minus its cross-entropy times the characters, 40
    at most, so that long texts don't saturate it more than short ones.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            lang, share, best, reject = scorer(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(share), pa.array(best, mask=np.isnan(best)), pa.array(reject)], [id_col, "lang_pred", "score", "bits", "rejected"])

    return rows.mapInArrow(run, f"`{id_col}` {dict(rows.dtypes)[id_col]}, lang_pred string, score double, bits double, rejected boolean")


def keep_known(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns as they were, whose text the models tell a language of and don't reject.

    Null texts and texts without letters go; repeated rows are decided alike. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            yield b.filter(pa.array(~scorer(b.column(at))[3]))

    return docs.mapInArrow(run, docs.schema)
