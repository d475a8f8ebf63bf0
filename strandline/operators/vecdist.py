"""Distances of all pairs of rows of numbers, block against block.

Blocks meet as operators.blocks says; distances are computed as matrices, sums over components in their order. The
single-pair forms are column expressions in functions.vector; those here give the same values.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BAND_PAIRS, GROUP_ROWS, TILE, by_blocks, cuts_between, number_of_blocks, rounded

#: Cells (pairs) that sums over components are kept for at a time: about what a core's cache holds.
CELLS = 1 << 15
#: A squared distance below this part of the squared norms, and a share of open pairs above this, are left to the plain sums.
NEAR, MOST_OPEN = 1e-4, 0.1
#: The tile of distances that first make other numbers of a block's rows.
TALL = (512, 4096)
#: The tile of distances that are done in few steps: all of it as a core's cache holds, few rows on both sides that it is read from.
FLAT = (256, 256)
#: The tile of distances that go row by row of one side along all of the other.
WIDE = (256, 8192)
#: Rows whose distances say where those of all rows lie. Only which file a pair is written to follows from it.
SOME_ROWS = 512
EPS = float(np.finfo(float).eps)


def _safe(num: np.ndarray, den: np.ndarray, at_zero: float = 0.0) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(den == 0, at_zero, num / np.where(den == 0, 1, den))


def _totals(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x.sum(1)[:, None], y.sum(1)[None, :]


def _zero_rows(x: np.ndarray, y: np.ndarray, d: np.ndarray) -> np.ndarray:
    """0 for two rows without any amount, 1 for one such row."""
    a, b = (~x.any(1))[:, None], (~y.any(1))[None, :]
    if not a.any() and not b.any():
        return d
    return np.where(a & b, 0.0, np.where(a | b, 1.0, d))


def _shares(x: np.ndarray) -> np.ndarray:
    s = x.sum(1, keepdims=True)
    return x / np.where(s == 0, 1, s)


def _norms(x: np.ndarray) -> np.ndarray:
    s = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(s == 0, 1, s)


def _sum_of(x: np.ndarray, y: np.ndarray, part: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over components of what `part` makes of a column of x and a row of y, in a buffer that it may use."""
    out, across = np.zeros((len(x), len(y))), np.ascontiguousarray(y.T)
    step = max(1, CELLS // max(1, len(y)))
    for s in range(0, len(x), step):
        acc, down = out[s : s + step], x[s : s + step]
        room = np.empty_like(acc)
        for k in range(x.shape[1]):
            acc += part(down[:, k, None], across[k], room)
    return out


def _low(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return _sum_of(x, y, lambda p, q, room: np.minimum(p, q, out=room))


def _high(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return _sum_of(x, y, lambda p, q, room: np.maximum(p, q, out=room))


def manhattan(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return _sum_of(x, y, lambda p, q, room: np.abs(np.subtract(p, q, out=room), out=room))


def euclidean(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(_sum_of(x, y, lambda p, q, room: np.square(np.subtract(p, q, out=room), out=room)))


def _in_order(x: np.ndarray, y: np.ndarray, part: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over components, in their order, of each row of x and the same row of y."""
    out = np.zeros(len(x))
    for k in range(x.shape[1]):
        out += part(x[:, k], y[:, k])
    return out


def _settled(d: np.ndarray, x: np.ndarray, y: np.ndarray, digits: int, slack: float, plain: Callable, one: Callable, near: float = 0.0, done: bool = False) -> None:
    """d, whose values are off by slack at most, becomes such that it rounds as plain(x, y) does: where two values within the
    slack might round apart, or d is below `near`, one(rows of x, rows of y, i, j) takes its place, or plain where that is much.
    done: d, of no negative values, becomes what it rounds to."""
    scale = 10.0**digits
    last = (lambda v: rounded(v, digits)) if done else (lambda v: v)
    step = max(1, CELLS // max(1, len(y)))
    for s in range(0, len(x), step):
        part = d[s : s + step]
        rest = part * scale
        within = slack * scale + 8 * EPS * float(rest.max())
        whole = np.rint(rest)
        rest -= whole
        open_ = np.abs(rest, out=rest) >= 0.5 - within
        if near:
            open_ |= part < near
        if done:
            np.divide(whole, scale, out=part)
        at = np.flatnonzero(open_)
        if len(at) > MOST_OPEN * open_.size:
            d[s : s + step] = last(plain(x[s : s + step], y))
        elif len(at):
            i, j = np.divmod(at, len(y))
            part[i, j] = last(one(x[s + i], y[j], s + i, j))


def euclidean_to(x: np.ndarray, y: np.ndarray, digits: int, done: bool = False) -> np.ndarray:
    """What rounds to the same digits as euclidean(x, y), or is rounded already (done): by a product of matrices, and by the plain
    sums where that leaves them open."""
    xx, yy = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
    most = float(xx.max() + yy.max())
    if not 1e-100 < most < 1e100:  # nan, too
        return rounded(euclidean(x, y), digits) if done else euclidean(x, y)
    d = (-2 * x) @ y.T
    d += xx[:, None]
    d += yy
    np.sqrt(np.maximum(d, 0, out=d), out=d)
    near = float(np.sqrt(NEAR * most))
    slack = (8 * x.shape[1] + 64) * EPS * most / near  # of the squares, over a distance of `near` at least
    _settled(d, x, y, digits, slack, euclidean, lambda p, q, i, j: np.sqrt(_in_order(p, q, lambda a, b: np.square(a - b))), near, done)
    return d


euclidean.to, euclidean.done = euclidean_to, True


def with_squares(x: np.ndarray) -> np.ndarray:
    """Rows, the sum of their squares and 1: what a product of matrices makes all of a squared distance from."""
    return np.concatenate([x, np.einsum("ij,ij->i", x, x)[:, None], np.ones((len(x), 1))], 1)


def done_apart(f: Callable, m: np.ndarray, k: np.ndarray, digits: int) -> np.ndarray:
    """f.to(x, y, digits, True) to the bit, f being euclidean or _apart, of rows with_squares: distances leave one product of matrices
    times 10 to the digits, and few steps round them. The bounds are those of euclidean_to; where they don't apply it is asked, and
    plain sums are where they leave a rounding open."""
    w = m.shape[1] - 2
    x, y, xx, yy = m[:, :w], k[:, :w], m[:, w], k[:, w]
    most, least = float(xx.max() + yy.max()), float(min(xx.min(), yy.min()))
    if not (0 < least and 1e-100 < most < 1e100):  # nan and rows of zeros, too
        return f.to(x, y, digits, True)
    scale = 10.0**digits
    left = np.empty(m.shape)
    np.multiply(x, -2 * scale * scale, out=left[:, :w])
    left[:, w] = scale * scale
    np.multiply(xx, scale * scale, out=left[:, w + 1])
    d = left @ k.T
    near = float(np.sqrt(NEAR * most))
    within = ((8 * w + 64) * EPS * most / near + 8 * EPS * float(np.sqrt(2 * most))) * scale
    step = max(1, CELLS // len(y))
    room = np.empty((min(step, len(x)), len(y)))
    for s in range(0, len(x), step):
        part = d[s : s + step]
        rest, close = room[: len(part)], None
        if part.min() < (near * scale) ** 2:
            close = part < (near * scale) ** 2
            np.maximum(part, 0, out=part)
        np.sqrt(part, out=rest)
        np.rint(rest, out=part)
        rest -= part
        part /= scale
        if close is None and rest.max() < 0.5 - within and rest.min() > within - 0.5:
            continue
        open_ = np.abs(rest, out=rest) >= 0.5 - within
        if close is not None:
            open_ |= close
        at = np.flatnonzero(open_)
        if len(at) > MOST_OPEN * open_.size:
            part[:] = f.to(x[s : s + step], y, digits, True)
        elif len(at):
            i, j = np.divmod(at, len(y))
            part[i, j] = rounded(np.sqrt(_in_order(x[s + i], y[j], lambda a, b: np.square(a - b))), digits)
    return d


def _low_shares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The sum over components of the smaller one over both, for amounts; what x has nothing of adds nothing."""
    across = np.ascontiguousarray(y.T)
    out, low, both = np.zeros((len(x), len(y))), np.empty(len(y)), np.empty(len(y))
    for acc, row in zip(out, x):
        for k in np.flatnonzero(row).tolist():
            np.divide(np.minimum(across[k], row[k], out=low), np.add(across[k], row[k], out=both), out=low)
            np.add(acc, low, out=acc)
    return out


def _of_sums(x: np.ndarray, y: np.ndarray, digits: int, share: Callable, by: float, plain: Callable, one: Callable) -> np.ndarray:
    """What rounds to the same digits as plain(x, y), which is share(manhattan(x, y), totals of both together): of amounts, the
    differences are summed as whole numbers of 4 bytes. by: how much the result is off for what a sum is, over the least totals."""
    if not x.size:
        return plain(x, y)
    a, b = _totals(x, y)
    most, least, top = float(a.max() + b.max()), float(a.min() + b.min()), float(max(x.max(), y.max()))
    if not (x.min() >= 0 and y.min() >= 0 and 1e-100 < 1e-3 * most < least and most < 1e100):  # nan, too
        return plain(x, y)
    n = x.shape[1]
    scale = 2.0 ** int(np.floor(min(np.log2(((1 << 32) - 2 * n - 2) / most), np.log2(((1 << 31) - 2) / top))))  # so that a sum stays below 2³²
    off, whole = 0.0, []
    for side in (x, np.ascontiguousarray(y.T)):
        z = side * scale
        w = np.rint(z)
        off = max(off, float(np.abs(np.subtract(z, w, out=z), out=z).max()))
        whole.append(w)
    mine, across = whole[0].astype(np.int32), whole[1].astype(np.int32)
    out = np.empty((len(x), len(y)))
    step = max(1, 2 * CELLS // len(y))
    for s in range(0, len(x), step):
        down = mine[s : s + step]
        acc, room = np.zeros((len(down), len(y)), np.uint32), np.empty((len(down), len(y)), np.int32)
        for k in range(n):
            np.absolute(np.subtract(down[:, k, None], across[k], out=room), out=room)
            np.add(acc, room.view(np.uint32), out=acc)
        out[s : s + step] = share(acc / scale, a[s : s + step] + b)
    off = 2 * n * off / scale + (8 * n + 64) * EPS * most
    _settled(out, x, y, digits, by * off / least, plain, one)
    return out


def _apart_in_order(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return _in_order(x, y, lambda p, q: np.abs(p - q))


def manhattan_to(x: np.ndarray, y: np.ndarray, digits: int, done: bool = False) -> np.ndarray:
    """What rounds to the same digits as manhattan(x, y), or is rounded already (done): of amounts, both totals less twice the smaller
    components, which are summed as whole numbers of 4 bytes; what x has nothing of adds nothing."""
    def plainly() -> np.ndarray:
        return rounded(manhattan(x, y), digits) if done else manhattan(x, y)

    if not (x.size and y.size):
        return plainly()
    a, b = _totals(x, y)
    most, top = float(a.max() + b.max()), float(max(x.max(), y.max(), min(a.max(), b.max())))
    if not (x.min() >= 0 and y.min() >= 0 and 1e-100 < top and most < 1e100 and most < 1e6 * top):  # nan, too
        return plainly()
    n = x.shape[1]
    scale = 2.0 ** int(np.floor(np.log2(((1 << 32) - 2 * n - 2) / top)))  # so that a sum stays below 2³²
    off, whole = 0.0, []
    for side in (x, np.ascontiguousarray(y.T)):
        z = side * scale
        w = np.rint(z)
        off = max(off, float(np.abs(np.subtract(z, w, out=z), out=z).max()))
        whole.append(w)
    totals = whole[0].sum(1), whole[1].sum(0)
    mine, across = whole[0].astype(np.uint32), list(whole[1].astype(np.uint32))
    out, acc, low = np.empty((len(x), len(y))), np.empty(len(y), np.uint32), np.empty(len(y), np.uint32)
    for d, row, total in zip(out, mine, totals[0]):
        acc.fill(0)
        for k in np.flatnonzero(row).tolist():
            low.fill(row[k])  # two arrays are compared twice as fast as an array and a number
            np.add(acc, np.minimum(across[k], low, out=low), out=acc)
        np.multiply(acc, -2.0, out=d)
        d += totals[1]
        d += total
    out /= scale
    _settled(out, x, y, digits, 2 * n * off / scale + (8 * n + 64) * EPS * most, manhattan, lambda p, q, i, j: _apart_in_order(p, q), done=done)
    return out


manhattan.to, manhattan.many = manhattan_to, True


def bray_curtis(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    a, b = _totals(x, y)
    return np.where(a + b <= 0, 0.0, _safe(manhattan(x, y), a + b))


def bray_curtis_to(x: np.ndarray, y: np.ndarray, digits: int) -> np.ndarray:
    def one(p: np.ndarray, q: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return _apart_in_order(p, q) / (x.sum(1)[i] + y.sum(1)[j])

    return _of_sums(x, y, digits, np.divide, 1.5, bray_curtis, one)


bray_curtis.to, bray_curtis.tall = bray_curtis_to, True


def bray_curtis_magurran(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    a, b = _totals(x, y)
    return np.where(a + b <= 0, 0.0, 1 - _safe(2 * _low(x, y), a + b))


def canberra(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    a, b, both = _abc(x, y)
    return _safe(_sum_of(x, y, _share_apart), a + b - both)


def _share_apart(p: np.ndarray, q: np.ndarray, room: np.ndarray | None = None) -> np.ndarray:
    under = p + q
    np.copyto(under, np.inf, where=under == 0)
    room = np.subtract(p, q, out=room)
    np.abs(room, out=room)
    return np.divide(room, under, out=room)


def canberra_to(x: np.ndarray, y: np.ndarray, digits: int) -> np.ndarray:
    """What rounds to the same digits as canberra(x, y): of amounts, a component's share is 1 less twice the smaller one's."""
    if not (x.size and x.min() >= 0 and y.min() >= 0 and x.max() < 1e100 and y.max() < 1e100):  # nan, too
        return canberra(x, y)
    a, b, either = _abc(x, y)
    np.subtract(a + b, either, out=either)
    if not either.all():
        return canberra(x, y)
    d = _low_shares(x, y)
    d *= -2
    d /= either
    d += 1
    np.maximum(d, 0, out=d)
    _settled(d, x, y, digits, (8 * x.shape[1] + 64) * EPS, canberra, lambda p, q, i, j: _in_order(p, q, _share_apart) / either[i, j])
    return d


canberra.to, canberra.tall = canberra_to, True


def _prepared(prepare: Callable, f: Callable, name: str) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """f of both sides' rows, each prepared; pairwise prepares a row once a block."""
    def metric(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return f(prepare(x), prepare(y))

    metric.__name__, metric.prepare, metric.f = name, prepare, f
    return metric


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return _zero_rows(x, y, euclidean(x, y))


_apart.to = lambda x, y, digits, done=False: _zero_rows(x, y, euclidean_to(x, y, digits, done))
_apart.done = True


chord = _prepared(_norms, _apart, "chord")
hellinger = _prepared(lambda x: np.sqrt(_shares(x)), _apart, "hellinger")
specprof = _prepared(_shares, _apart, "specprof")


def kulczynski(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    (a, b), low = _totals(x, y), _low(x, y)
    return _zero_rows(x, y, 1 - (_safe(low, a) + _safe(low, b)) / 2)


def soergel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return _safe(manhattan(x, y), _high(x, y))


def soergel_to(x: np.ndarray, y: np.ndarray, digits: int) -> np.ndarray:
    def share(apart: np.ndarray, total: np.ndarray) -> np.ndarray:
        return 2 * apart / (total + apart)  # the larger components are half of both

    def one(p: np.ndarray, q: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return _apart_in_order(p, q) / _in_order(p, q, np.maximum)

    return _of_sums(x, y, digits, share, 3, soergel, one)


soergel.to, soergel.tall = soergel_to, True


def morisita_horn(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    a, b = _totals(x, y)
    d = _safe((x * x).sum(1)[:, None], a * a) + _safe((y * y).sum(1)[None, :], b * b)
    return _zero_rows(x, y, 1 - _safe(2 * (x @ y.T), d * a * b))


def abund_jaccard(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    (a, b), p, q = _totals(x, y), (x > 0).astype(float), (y > 0).astype(float)
    u, v = _safe(x @ q.T, a), _safe(p @ y.T, b)
    return _zero_rows(x, y, np.where((u == 0) & (v == 0), 1.0, 1 - _safe(u * v, u + v - u * v)))


def _centred(x: np.ndarray) -> np.ndarray:
    """Rows of one value become zeros."""
    return np.where(np.ptp(x, axis=1, keepdims=True) == 0, 0.0, x - x.mean(1, keepdims=True))


def _uncorrelated(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return _zero_rows(x, y, 1 - _safe(x @ y.T, np.sqrt((x * x).sum(1)[:, None] * (y * y).sum(1)[None, :])))


pearson = _prepared(_centred, _uncorrelated, "pearson")
pearson.many = True


def ranks(x: np.ndarray) -> np.ndarray:
    """Average ranks by row."""
    below = (x[:, None, :] < x[:, :, None]).sum(2)
    same = (x[:, None, :] == x[:, :, None]).sum(2)
    return below + (same + 1) / 2


def _rank_apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of ranks, which are halves, so that sums of their products are exact."""
    n = x.shape[1]
    if n < 2:
        return np.zeros((len(x), len(y)))
    kind = np.float32 if 4 * n**3 < 1 << 24 else float  # exact in 4 bytes, too
    d = (x.astype(kind) @ y.astype(kind).T).astype(float, copy=False)
    d *= -12
    d += 6 * np.einsum("ij,ij->i", x, x)[:, None]
    d += 6 * np.einsum("ij,ij->i", y, y)
    d /= n * (n * n - 1)
    return d


spearman_approx = _prepared(lambda x: np.concatenate([ranks(x[i : i + 1024]) for i in range(0, len(x), 1024)] or [x]), _rank_apart, "spearman_approx")


def _abc(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    p, q = (x != 0).astype(float), (y != 0).astype(float)
    return p.sum(1)[:, None], q.sum(1)[None, :], p @ q.T


def binary_hamming(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    a, b, c = _abc(x, y)
    return a + b - 2 * c


def binary_sorensen_dice(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    a, b, c = _abc(x, y)
    return np.where(a + b == 0, 0.0, 1 - _safe(2 * c, a + b))


def binary_jaccard(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    a, b, c = _abc(x, y)
    return np.where(a + b - c == 0, 0.0, 1 - _safe(c, a + b - c))


def binary_lennon(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    a, b, c = _abc(x, y)
    return np.where((a == 0) & (b == 0), 0.0, np.where(c == 0, 1.0, 1 - _safe(c, c + np.minimum(a - c, b - c))))


def binary_ochiai(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    a, b, c = _abc(x, y)
    return np.where((a == 0) & (b == 0), 0.0, np.where((a == 0) | (b == 0), 1.0, 1 - _safe(c, np.sqrt(a * b))))


def otu_gain(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Components of the first row that the second lacks: not symmetric."""
    a, _, c = _abc(x, y)
    return a - c


def _presence(f: Callable) -> Callable:
    return lambda x, y: f((x != 0).astype(float), (y != 0).astype(float))


METRICS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    f.__name__: f
    for f in (manhattan, euclidean, bray_curtis, bray_curtis_magurran, canberra, chord, hellinger, specprof, kulczynski, soergel, morisita_horn, abund_jaccard, pearson, spearman_approx, binary_hamming, binary_sorensen_dice, binary_jaccard, binary_lennon, binary_ochiai, otu_gain)
} | {"binary_euclidean": _presence(euclidean), "binary_chord": _presence(chord), "binary_pearson": _presence(pearson)}


#: Those whose value depends on which row comes first.
ORDERED = {"otu_gain"}


def _matrix(t: pa.Table) -> np.ndarray:
    """Rows of numbers; a null row or number is nan."""
    v = t["v"].combine_chunks()
    if v.null_count:
        return np.stack([np.asarray(x, dtype=float) if x is not None else np.full(max(map(len, (y for y in v.to_pylist() if y is not None)), default=0), np.nan) for x in v.to_pylist()])
    return v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(v), -1)


def pairwise(rows: DataFrame, metric: str, name: str = "name", vector: str = "v", block: int | None = None, digits: int | None = None) -> DataFrame:
    """(name1, name2, dist) with name1 < name2 of rows of one width, rounded to `digits`. block: rows of a block, else as memory allows."""
    spark = rows.sparkSession
    measure = METRICS[metric]
    prepare, f = getattr(measure, "prepare", None), getattr(measure, "f", measure)
    mine = rows.select(name, F.col(vector).cast("array<double>").alias("v"))
    single = F.forall("v", lambda x: x.cast("float").cast("double").eqNullSafe(x))  # half as much to send
    n, width, short = mine.agg(F.count(F.lit(1)), F.max(F.size("v")), F.bool_and(single)).first()
    many = digits is not None and getattr(measure, "many", False)  # so many values that Parquet's writer needs help to keep a dictionary
    blocks = max(2, -(-n // block)) if block else number_of_blocks(n, 8 * max(width or 0, 1), spark.sparkContext.defaultParallelism)
    if many and not block:
        blocks = max(blocks, 2 * -(-n // (2 * GROUP_ROWS)))
    sent = mine.withColumn("v", F.col("v").cast("array<float>")) if short else mine

    done = digits is not None and getattr(f, "done", False)

    def load(t: pa.Table) -> np.ndarray:
        x = prepare(_matrix(t)) if prepare else _matrix(t)
        return with_squares(x) if done else x

    def kernel(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        if done:
            return [done_apart(f, x, y, digits)]
        if whole:
            return [f.to(x, y, digits, True)]
        return [f(x, y) if digits is None or not hasattr(f, "to") else f.to(x, y, digits)]

    cuts, whole = [], many and f is manhattan  # rounded to the same value whatever it is made beside, as bands need
    if whole and (n / blocks) ** 2 >= BAND_PAIRS:
        some = _matrix(mine.orderBy(F.xxhash64(name)).limit(SOME_ROWS).select("v").toArrow())
        with np.errstate(invalid="ignore"):
            cuts = cuts_between(measure(some, some)[np.triu_indices(len(some), 1)], digits)

    tile = TALL if digits is not None and getattr(f, "tall", False) else WIDE if whole else FLAT if done or many else TILE
    return by_blocks(sent, load, kernel, {"dist": "double"}, blocks, name, symmetric=metric not in ORDERED, digits=None if done or whole else digits, tile=tile, opening=many, cuts=cuts)
