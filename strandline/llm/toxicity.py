"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are present or not: its words, neighbouring pairs, and pairs with one or two words between them,
in lower case without outer punctuation, and its words' first STEM letters, so that inflected words count together;
all hashed to 2^BITS coordinates. Each coordinate learns at its own rate, and L1
keeps those without evidence at zero, so the weights that are broadcast are few and bounded by 2^BITS.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fraction_filter, materialise, small_batches
from .features import fold, joined

BITS = 20
#: Labelled rows that the weights are fitted on, about, at most.
FIT_ROWS = 8000
#: Bytes of the coordinates that these rows have together, at most; beyond that a smaller share of the rows is taken.
FIT_BYTES = 256 << 20
ALPHA, BETA, L1, L2, EPOCHS = 0.3, 1.0, 10.0, 1.0, 4
STEM = 4
CACHE = 300_000
EDGES = ".,;:!?\"'()[]{}|*&%$#"


def _digest(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))


class Words:
    """Hashes of words and of their stems, kept for those seen lately."""

    def __init__(self) -> None:
        self.place: dict[str, int] = {}
        self.table = np.zeros((1 << 12, 2), dtype=np.uint64)

    def hashes(self, text: str | None) -> np.ndarray:
        """Words × (word's hash, stem's hash)."""
        words = (text or "").lower().split()
        place = self.place
        if len(place) > CACHE:
            place.clear()
        new = {w for w in words if w not in place}
        while len(place) + len(new) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        for w in new:
            plain = w.strip(EDGES) or w
            self.table[len(place)] = _digest(plain), _digest(plain[:STEM])
            place[w] = len(place)
        return self.table[np.fromiter(map(place.__getitem__, words), dtype=np.int64, count=len(words))]


def coordinates(both: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The coordinates of a text's words, pairs, skip-grams and stems, with repeats."""
    h = both[:, 0]
    parts = [joined([h], 0), joined([both[:, 1]], 4)] + [joined([h[:-gap], h[gap:]], gap) for gap in (1, 2, 3) if len(h) > gap]
    return fold(np.concatenate(parts), bits)


@dataclass
class Weights:
    index: np.ndarray  # sorted
    value: np.ndarray
    bias: float
    bits: int

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << self.bits, dtype=np.float32)
        w[self.index] = self.value
        return w


def train(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, epochs: int = EPOCHS) -> Weights:
    """FTRL-proximal over the rows' distinct coordinates, in the order given."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    zb = nb = bias = 0.0
    for _ in range(epochs):
        for x, y in zip(rows, labels):
            zx, nx = z[x], n[x]
            w = np.where(np.abs(zx) <= L1, 0.0, -(zx - np.sign(zx) * L1) / ((BETA + np.sqrt(nx)) / ALPHA + L2))
            bias = -zb / ((BETA + math.sqrt(nb)) / ALPHA)
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, w.sum() + bias)))) - y
            sigma = (np.sqrt(nx + g * g) - np.sqrt(nx)) / ALPHA
            z[x] = zx + g - sigma * w
            n[x] = nx + g * g
            zb += g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / ALPHA * bias
            nb += g * g
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    index = np.flatnonzero(w)
    return Weights(index.astype(np.int32), w[index].astype(np.float32), float(-zb / ((BETA + math.sqrt(nb)) / ALPHA)), bits)


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, keep: Column, id_col: str, text_col: str, fit_rows: int) -> DataFrame:
    """(id, text, label): about `fit_rows` rows at most whose fold `keep` allows, by a hash of the id.

    Of several labels of an id the largest counts; null labels and ids don't.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).filter(keep).select(id_col, F.col(label_col).cast("int").alias("label"))
    n = max(1, known.count())
    some = fraction_filter(F.col(id_col), min(1.0, fit_rows / n))
    known = known.filter(some).groupBy(id_col).agg(F.max("label").alias("label"))
    return docs.filter(keep).filter(some).select(id_col, F.col(text_col).alias("text")).join(known, id_col)


def bounded(hashed: DataFrame, limit: int = FIT_BYTES) -> DataFrame:
    """The rows (id, label, x) written, or the share of them, by a hash of the id, whose coordinates take `limit` bytes."""
    held = materialise(hashed, "labelled")
    size = held.agg(F.sum(F.octet_length("x"))).first()[0] or 0
    return held if size <= limit else held.filter(fraction_filter(F.col("id"), limit / size, "bytes"))


def fit(docs: DataFrame, labels: DataFrame, keep: Column, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> Weights | None:
    """Weights from the sample of labelled rows, which is bounded in rows and bytes; texts are hashed as a whole on the
    executors and one task learns; None without rows of both labels.

    Null and empty texts have no coordinates; documents that repeat an id learn its label each; other columns don't matter.
    """
    small_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, label_col, keep, id_col, text_col, fit_rows)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            sets = [np.unique(coordinates(words.hashes(t.as_py()))).astype("<i4").tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(2), pa.array(sets, pa.binary())], ["id", "label", "x"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((xxhash.xxh64_intdigest(i), i, y, x) for b in batches for i, y, x in zip(*(b.column(c).to_pylist() for c in range(3))))
        y = np.array([f[2] for f in found], dtype=float)
        w = train([np.frombuffer(f[3], "<i4") for f in found], y) if 0 < y.sum() < len(y) else None
        if w:
            yield pa.RecordBatch.from_arrays([pa.array([w.index.astype("<i4").tobytes()]), pa.array([w.value.astype("<f4").tobytes()]), pa.array([w.bias])], ["i", "v", "b"])

    rows = sample.select(id_col, "text", "label").mapInArrow(hashed, "id string, label int, x binary")
    rows = bounded(rows).repartition(1).mapInArrow(learn, "i binary, v binary, b double").collect()
    if not rows:
        return None
    return Weights(np.frombuffer(rows[0].i, "<i4"), np.frombuffer(rows[0].v, "<f4"), rows[0].b, BITS)


def score(docs: DataFrame, weights: Weights | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): the probability of label 1 for each row; null and empty texts get that of no features, 0 without weights.

    Repeated rows and rows without id are scored each, texts of any length as a whole; other columns, whatever their
    names, don't matter. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(weights)
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Weights | None = shared.value
        w = m.dense() if m else None
        words = Words()
        for b in batches:
            total = np.full(b.num_rows, m.bias if m else 0.0)
            for i, t in enumerate(b.column(1) if m else []):
                h = words.hashes(t.as_py())
                if len(h):
                    x = coordinates(h, m.bits)
                    x = np.unique(x[w[x] != 0])
                    total[i] += w[x].sum(dtype=np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(total, -700, 700))) if m else total)], [id_col, "score"])

    return rows.mapInArrow(run, f"`{id_col}` {dict(rows.dtypes)[id_col]}, score double")
