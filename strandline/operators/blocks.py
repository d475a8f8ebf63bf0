"""All pairs of rows, block against block, in Arrow batches.

Rows are dealt to blocks by hash and every pair of blocks is one task's, so a row travels once per block and not once
per pair. A task sorts both blocks by name and goes through them tile by tile; what it makes leaves tile by tile too, so
its memory is bounded by two blocks and a tile, and no value is rounded or filtered row by row afterwards.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

#: Rows and bytes of a block at most, rows and columns of a tile, and about how many pairs leave together: as a core's cache holds.
BLOCK_ROWS, BLOCK_BYTES = 65_536, 32 << 20
TILE, LEAVING = (64, 4096), 1 << 16
#: Bytes that a task asks for and gives back, so that the C library keeps matrices' memory instead of returning it each time.
KEPT_BYTES = 31 << 20
#: Pairs of blocks that are a partition each, at most; beyond, a partition has several.
PARTITIONS = 20_000
#: Rows of a block whose pairs are one row group of a Parquet file, and pairs that leave first then, those of the most usual values before others.
GROUP_ROWS, OPENING = 6000, 1 << 18
#: Values that the dictionary of a row group has room for, with some to spare (131,072 doubles); as many bands of values at most, for pairs
#: of blocks of as many pairs at least.
VALUES, BANDS, BAND_PAIRS = 120_000, 4, 1 << 20


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """To digits after the point, halves away from zero, as SQL's round does."""
    y = x * 10.0**digits
    special = ~np.isfinite(y)
    with np.errstate(invalid="ignore"):
        whole = np.trunc(y)
        rest = y - whole
        rest += rest
        whole += np.trunc(rest, out=rest)
        whole /= 10.0**digits
        np.copysign(whole, y, out=whole)
    if special.any():
        whole[special] = x[special]
    return whole


def number_of_blocks(rows: int, row_bytes: int, parallelism: int) -> int:
    """As few as memory allows, but so many that their pairs keep all cores busy: an even number, as its tasks end together more nearly."""
    most = max(1, min(BLOCK_ROWS, BLOCK_BYTES // max(1, row_bytes)))
    return max(2, -(-rows // most), min(2 * math.ceil(math.sqrt(8 * parallelism) / 2), -(-rows // 64)))


def cuts_between(some: np.ndarray, digits: int) -> list[float]:
    """Cuts, if few do, that part doubles like these into bands of no more rounded values than a dictionary holds, the most usual ones in as few as can be."""
    some = some[np.isfinite(some)]
    if not len(some):
        return []
    low, mid, high = np.quantile(some, [0.0005, 0.5, 0.9995])
    width = VALUES / 10.0**digits
    k = math.ceil((high - low) / width)
    return [float(mid + (i - k / 2) * width) for i in range(1, k)] if k <= BANDS else []


def pair_number(i: int | str, j: int | str, blocks: int) -> str:
    """SQL for the number of the pair of blocks i <= j. A block with itself, half the work, comes after all others: tasks start in
    this order, so the last ones are short."""
    return f"if({i} = {j}, {blocks * (blocks - 1) // 2} + {i}, {i} * {blocks - 1} - {i} * ({i} - 1) div 2 + {j} - {i} - 1)"


def by_blocks(
    rows: DataFrame,
    load: Callable[[pa.Table], np.ndarray],
    kernel: Callable[[np.ndarray, np.ndarray], Sequence[np.ndarray]],
    fields: dict[str, str],
    blocks: int,
    name: str = "name",
    symmetric: bool = True,
    digits: int | None = None,
    nan_to_null: bool = False,
    tile: tuple[int, int] = TILE,
    best: str | None = None,
    opening: bool = False,
    cuts: Sequence[float] = (),
) -> DataFrame:
    """(name1, name2, *fields) for every pair of rows once, name1 < name2; a null name has no pairs, nor have equal names.

    `load` makes an array, a row for each, of a block's other columns; `kernel` takes two such arrays and returns for each
    field (name: double, int or long) a matrix. Doubles are rounded to `digits`. best ("max" or "min"): only a pair of the largest or
    smallest first field for each pair of blocks.
    opening: a task's first pairs leave by how usual their first field is. Parquet's writer keeps a dictionary of a column's values, a quarter of the bytes
    of plain doubles, only if the first page of a row group has many of them more than once. cuts: a pair of blocks has a task for each band of the first
    field between two cuts, which makes all pairs and lets go of those in its band; each pair is in one, as a value must not depend on what it is made beside.
    """
    spark = rows.sparkSession
    ship(spark)
    kind = dict(rows.dtypes)[name]
    b = F.pmod(F.xxhash64(name), F.lit(blocks)).cast("int")
    mine = rows.filter(F.col(name).isNotNull()).withColumn("__b", b)
    pair = lambda i: F.struct(F.least("__b", i).alias("i"), F.greatest("__b", i).alias("j"))
    dealt = mine.withColumn("__p", F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), pair))).select("*", F.expr(pair_number("__p.i", "__p.j", blocks)).cast("int").alias("__g")).drop("__p")
    parts = min(blocks * (blocks + 1) // 2, PARTITIONS)
    numpy_type = {"double": np.float64, "int": np.int32, "long": np.int64}
    types = [numpy_type[t] for t in fields.values()]
    labels = ["name1", "name2", *fields]
    payload = [c for c in rows.columns if c != name]

    def column(x: np.ndarray, to: type) -> pa.Array:
        if to is not np.float64:
            return pa.array(x.astype(to))
        x = np.ascontiguousarray(x, dtype=np.float64)
        x = x if digits is None else rounded(x, digits)
        return pa.array(x, mask=np.isnan(x)) if nan_to_null else pa.array(x)

    def tiles(names: np.ndarray, rest: np.ndarray, other: np.ndarray, others: np.ndarray, same: bool) -> Iterator[tuple]:
        """(name1, name2, values) of the pairs, flat; both sides are sorted by name."""
        high, wide = tile
        for t in range(0, len(other), wide):
            c, y = other[t : t + wide], others[t : t + wide]
            step = max(1, LEAVING // len(c))
            again = np.tile(c, min(step, high, len(names)))  # shared by all that leave beside these columns
            for s in range(0, len(names), high):
                a, x = names[s : s + high], rest[s : s + high]
                if same and not a[0] < c[-1]:
                    continue
                values = kernel(x, y)
                if not symmetric and not same and not a[-1] < c[0]:
                    less = a[:, None] < c[None, :]
                    values = [np.where(less, v, w.T) for v, w in zip(values, kernel(y, x))]
                for r in range(0, len(a), step):
                    yield from flat(a[r : r + step], c, again, [v[r : r + step] for v in values], same)

    def flat(a: np.ndarray, c: np.ndarray, again: np.ndarray, values: Sequence[np.ndarray], same: bool) -> Iterator[tuple]:
        again = again[: len(a) * len(c)]
        if a[-1] < c[0]:
            yield np.repeat(a, len(c)), again, [v.ravel() for v in values]
        elif not same and c[-1] < a[0]:
            yield again, np.repeat(a, len(c)), [v.ravel() for v in values]
        else:
            less = a[:, None] < c[None, :]
            if same:
                p, q = np.nonzero(less)
                yield a[p], c[q], [v[p, q] for v in values]
            else:
                yield np.where(less, a[:, None], c[None, :]).ravel(), np.where(less, c[None, :], a[:, None]).ravel(), [v.ravel() for v in values]

    def band_of(x: np.ndarray) -> np.ndarray:
        """How many cuts a value isn't below; nan isn't below any."""
        out = np.full(len(x), len(cuts), np.int8)
        for c in cuts:
            out -= x < c
        return out

    def usual_first(made: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, n = [], 0
        for batch in made:
            first.append(batch)
            n += batch.num_rows
            if n >= OPENING:
                break
        if n:
            t = pa.Table.from_batches(first)
            v = t[labels[2]].to_numpy()
            some = v[np.isfinite(v)]
            t = t.take(np.argsort(np.abs(v - (np.median(some) if len(some) else 0)), kind="stable"))
            yield from t.to_batches(max_chunksize=LEAVING)
        yield from made

    def run_of(band: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        return lambda batches: usual_first(pairs(batches, band)) if opening else pairs(batches, band)

    def pairs(batches: Iterator[pa.RecordBatch], band: int) -> Iterator[pa.RecordBatch]:
        held = [x for x in batches if x.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        del held
        np.empty(KEPT_BYTES, np.uint8)
        groups = table["__g"].to_numpy()
        for g in np.unique(groups):
            t = table.filter(pa.array(groups == g)).combine_chunks() if groups[0] != g or (groups != g).any() else table
            kept, found, of = t[name].combine_chunks(), t["__b"].to_numpy(), load(t.select(payload))
            names = kept.to_numpy(zero_copy_only=False)
            low = found.min()
            at, to = np.flatnonzero(found == low), np.flatnonzero(found != low)
            on_diagonal = g >= blocks * (blocks - 1) // 2
            to = at if on_diagonal else to
            at, to = at[np.argsort(names[at], kind="stable")], to[np.argsort(names[to], kind="stable")]
            first = None
            if len(at) and len(to):
                for n1, n2, values in tiles(names[at], of[at], names[to], of[to], on_diagonal):
                    if cuts and len(n1):
                        inside = band_of(values[0]) == band
                        n1, n2, values = n1[inside], n2[inside], [v[inside] for v in values]
                    if not len(n1):
                        continue
                    if best:
                        k = int(values[0].argmax() if best == "max" else values[0].argmin())
                        v = values[0][k]
                        if first is None or (v > first[2][0][0] if best == "max" else v < first[2][0][0]):
                            first = n1[k : k + 1], n2[k : k + 1], [w[k : k + 1] for w in values]
                        continue
                    yield pa.RecordBatch.from_arrays([pa.array(n1, kept.type), pa.array(n2, kept.type), *map(column, values, types)], labels)
            if first is not None:
                yield pa.RecordBatch.from_arrays([pa.array(first[0], kept.type), pa.array(first[1], kept.type), *map(column, first[2], types)], labels)

    null = lambda v: "" if nan_to_null and v == "double" else " NOT NULL"  # noqa: E731  # what can't be null isn't looked up pair by pair
    schema = ", ".join([f"name1 {kind} NOT NULL", f"name2 {kind} NOT NULL", *[f"`{k}` {v}{null(v)}" for k, v in fields.items()]])
    parted = dealt.repartitionById(parts, F.col("__g") % parts)  # once for all bands, of which the middle ones have most
    return reduce(DataFrame.union, [parted.mapInArrow(run_of(k), schema) for k in sorted(range(len(cuts) + 1), key=lambda k: abs(2 * k - len(cuts)))])
