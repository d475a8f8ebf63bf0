"""Quality by naive-Bayes support vectors: n-gram indicators scaled by class log-count ratios, and a linear hinge-loss
model fitted by dual coordinate descent.

Tokens are words and runs of punctuation. Besides token n-grams, n-grams of token shapes (capitals, lower case, digits,
the punctuation itself, a repeat of the token before) are indicators, so that the model sees layout and not only
words. A coordinate, of which there are 2^BITS, keeps its log-count ratio and its weight: a text's ratios also give the
length that its row is scaled by.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .features import fold, joined
from .toxicity import bounded, labelled_sample

BITS = 18
#: Labelled rows that the model is fitted on, about, at most.
FIT_ROWS = 8000
C, EPOCHS, SMOOTH = 0.5, 12, 1.0
CACHE = 300_000
#: What predicted = 1 asks for: the margin that separates the classes best maps to it.
CUT = 0.3
TOKEN = re.compile(r"\w+|[^\w\s]+")


def _shape(token: str) -> str:
    if not (token[0].isalnum() or token[0] == "_"):
        return token[:3]
    if token.isdigit():
        return "9"
    if token.isupper():
        return "X" if len(token) == 1 else "XX"
    return "Xx" if token[0].isupper() else "x" if token.isalpha() else "x9"


class Tokens:
    def __init__(self) -> None:
        self.known: dict[str, tuple[int, int]] = {}

    def hashes(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Of each token its hash and its shape's hash."""
        tokens = TOKEN.findall(text or "")
        known = self.known
        if len(known) > CACHE:
            known.clear()
        for t in tokens:
            if t not in known:
                known[t] = (xxhash.xxh64_intdigest(t.lower().encode("utf-8", "surrogatepass")), xxhash.xxh64_intdigest(_shape(t).encode("utf-8", "surrogatepass"), 7))
        pairs = list(map(known.__getitem__, tokens))
        both = np.array(pairs, dtype=np.uint64) if pairs else np.zeros((0, 2), np.uint64)
        return both[:, 0], both[:, 1]


def coordinates(h: np.ndarray, shape: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The distinct coordinates of a text."""
    if not len(h):
        return np.zeros(0, np.int32)
    again = np.append(False, h[1:] == h[:-1])
    shape = np.where(again, shape ^ np.uint64(0x5851F42D4C957F2D), shape)
    parts = [joined([h], 0), joined([shape], 2)]
    if len(h) > 1:
        parts += [joined([h[:-1], h[1:]], 1), joined([shape[:-1], shape[1:]], 3)]
    if len(h) > 2:
        parts.append(joined([shape[:-2], shape[1:-1], shape[2:]], 4))
    seen = np.zeros(1 << bits, dtype=bool)
    x = fold(np.concatenate(parts), bits)
    if len(x) < 4096:
        return np.unique(x)
    seen[x] = True
    return np.flatnonzero(seen).astype(np.int32)


@dataclass
class Model:
    weight: np.ndarray  # 2 × coordinates: hinge-loss weights, log-count ratios
    bias: float
    slope: float
    bits: int


def train(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, epochs: int = EPOCHS) -> Model:
    """Ratios from the label counts of each coordinate, then dual coordinate descent on the scaled unit-length rows."""
    size = 1 << bits
    up, down = np.full(size, SMOOTH), np.full(size, SMOOTH)
    for x, y in zip(rows, labels):
        (up if y else down)[x] += 1
    ratio = np.log((up / up.sum()) / (down / down.sum()))
    scaled = []
    for x in rows:
        v = ratio[x]
        scaled.append(v / max(1e-9, math.sqrt(float(v @ v))))
    sign = np.where(labels > 0, 1.0, -1.0)
    cost = np.where(labels > 0, C, C * (labels > 0).sum() / max(1, (labels == 0).sum()))  # classes weigh the same
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(len(rows))
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            x, v = rows[i], scaled[i]
            g = sign[i] * (float(w[x] @ v) + bias) - 1
            new = min(max(alpha[i] - g / 2.0, 0.0), cost[i])  # rows have length 1, and 1 for the bias
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[x] += step * v
                bias += step
                alpha[i] = new
    margin = np.array([float(w[x] @ v) + bias for x, v in zip(rows, scaled)])
    spread = max(1e-6, float(np.abs(margin).mean()))
    fused = np.concatenate([w, ratio]).reshape(2, size)
    return Model(fused.astype(np.float32), bias, 2.0 / spread, bits)


def fit(docs: DataFrame, labels: DataFrame, keep: Column, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> Model | None:
    """A model from the sample of labelled rows, which is bounded in rows and bytes; None without rows of both labels.

    Null and empty texts have no coordinates; documents that repeat an id learn its label each; other columns don't matter.
    """
    small_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, label_col, keep, id_col, text_col, fit_rows)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for b in batches:
            sets = [coordinates(*tokens.hashes(t.as_py())).astype("<i4").tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(2), pa.array(sets, pa.binary())], ["id", "label", "x"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((xxhash.xxh64_intdigest(i), i, y, x) for b in batches for i, y, x in zip(*(b.column(c).to_pylist() for c in range(3))))
        y = np.array([f[2] for f in found], dtype=float)
        if 0 < y.sum() < len(y):
            m = train([np.frombuffer(f[3], "<i4") for f in found], y)
            yield pa.RecordBatch.from_arrays([pa.array([m.weight.astype("<f4").tobytes()]), pa.array([m.bias]), pa.array([m.slope])], ["w", "b", "s"])

    rows = sample.select(id_col, "text", "label").mapInArrow(hashed, "id string, label int, x binary")
    rows = bounded(rows).repartition(1).mapInArrow(learn, "w binary, b double, s double").collect()
    if not rows:
        return None
    return Model(np.frombuffer(rows[0].w, "<f4").reshape(2, -1), rows[0].b, rows[0].s, BITS)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): for each row a value from 0 to 1 that is CUT at margin 0; null and empty texts have the bias as margin, all rows CUT without a model.

    Repeated rows and rows without id are scored each, texts of any length as a whole; other columns, whatever their
    names, don't matter. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    shift = math.log(CUT / (1 - CUT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model | None = shared.value
        tokens = Tokens()
        for b in batches:
            margin = np.zeros(b.num_rows)
            for i, t in enumerate(b.column(1) if m else []):
                x = coordinates(*tokens.hashes(t.as_py()), m.bits)
                w, r = m.weight[0][x].astype(float), m.weight[1][x].astype(float)
                margin[i] = float(w @ r) / max(1e-9, math.sqrt(float(r @ r))) * m.slope + m.bias * m.slope if len(x) else m.bias * m.slope
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(margin + shift, -700, 700))))], [id_col, "score"])

    return rows.mapInArrow(run, f"`{id_col}` {dict(rows.dtypes)[id_col]}, score double")
