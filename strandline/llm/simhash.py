"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints that differ in at most `limit` of 64 bits agree on at least 2 of limit + 2 blocks of bits, so the topmost
nodes of the index are the pairs of blocks with the bits shared there; each holds the fingerprints with these bits,
sorted by Gray rank. Below, runs of `FAN` neighbours form nodes, level by level: a node keeps the bits that all its
members share and its parent doesn't have. A search carries each fingerprint down its nodes, adds up the differences in
the shared bits and drops a node, and all its members, once they exceed the limit. At the leaves the sum is the distance.

Topmost nodes are dealt to tasks by key. Within one that has more than `NODE_ROWS` fingerprints two that link agree on one
of limit + 1 blocks of the other bits as well, so it is parted by these; a part that is still too large is cut by hash into
chunks, and each pair of chunks is a task's work, so no task holds an unbounded group. A task emits a spanning forest of
what it links, never all pairs; components are found by star contraction over DataFrames.

With a wide limit unrelated fingerprints would meet by chance in a large corpus. A second fingerprint of the same shingles,
by another seed, then has to agree too: it isn't indexed but looked at where the first one links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_materialised, materialise, small_batches

SHINGLE, SEED, LIMIT = 4, 42, 4
#: The seed of the second fingerprint.
SECOND = 1042
#: What near_dedup takes: five words to a shingle; the bits that may differ in the first fingerprint and in the second.
NEAR_SHINGLE, NEAR_LIMIT, NEAR_SECOND = 5, 8, 12
FAN = 16
#: Fingerprints in a chunk of a topmost node.
NODE_ROWS = 4096
#: Nodes a search looks at together, and rows indexed together.
FRONTIER, ROWS = 1 << 18, 1 << 16

_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text's word shingles, as unsigned; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        hashes = [digest(b" ".join(words), seed)]
    else:
        hashes = [digest(b" ".join(s), seed) for s in zip(*(words[i:] for i in range(width)))]
    h = np.array(hashes, dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, second: bool = False) -> DataFrame:
    """(id, fp, fp2): one row per row of `docs`; fingerprints as signed longs, fp2 0 unless `second`. Null texts count as empty."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_py() for t in b.column(1)]
            columns = [np.array([fingerprint(t, width, seed) for t in texts] if wanted else [0] * len(texts), dtype=np.uint64).view(np.int64) for seed, wanted in ((SEED, True), (SECOND, second))]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in columns)], [id_col, "fp", "fp2"])

    return rows.mapInArrow(run, f"`{id_col}` {dict(rows.dtypes)[id_col]}, fp long, fp2 long")


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """The place of each value in the reflected Gray code."""
    out = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


def _levels(fp: np.ndarray, start: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Nodes per level from the leaves up, until each group is one node: (first child, first leaf, shared bits' mask, their values)."""
    leaf = np.arange(len(fp))
    levels = [(leaf, leaf, np.full(len(fp), _ONES), fp)]
    size, ones, any_ = np.diff(np.append(start, len(fp))), fp, fp
    first_leaf = leaf
    while (size > 1).any():
        begin = np.cumsum(size) - size
        up = -(-size // FAN)
        inside = np.arange(up.sum()) - np.repeat(np.cumsum(up) - up, up)
        child = np.repeat(begin, up) + inside * FAN
        ones, any_ = np.bitwise_and.reduceat(ones, child), np.bitwise_or.reduceat(any_, child)
        first_leaf = first_leaf[child]
        levels.append((child, first_leaf, ~(ones ^ any_), ones))
        size = up
    return levels


def _hook(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merges the classes of a[i] and b[i]; label[x] is the smallest member of x's class."""
    while True:
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            return label
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(up := label[label], label):
            label = up


def link_groups(group: np.ndarray, fp: np.ndarray, fp2: np.ndarray, limit: int = LIMIT, second: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Edges ((fp, fp2), (fp, fp2)) that connect what lies within both limits inside each group: at most one fewer than its members."""
    order = np.lexsort((gray_rank(fp), group))
    group, fp, fp2 = group[order], fp[order], fp2[order]
    start = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    levels = _levels(fp, start)
    of = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(fp))))
    label = np.arange(len(fp))
    alone = np.diff(np.append(start, len(fp)))[of] == 1
    todo = np.flatnonzero(~alone)
    step = 1 << 11
    for at in range(0, len(todo), step):
        stack = [(len(levels) - 1, todo[at : at + step], of[todo[at : at + step]], None)]
        while stack:
            level, q, node, acc = stack.pop()
            child, first, mask, bits = levels[level]
            if acc is None:
                acc = np.bitwise_count((fp[q] ^ bits[node]) & mask[node]).astype(np.int64)
            ok = (acc <= limit) & (first[node] < q)
            q, node, acc = q[ok], node[ok], acc[ok]
            if not len(q):
                continue
            if level == 0:
                near = np.bitwise_count(fp2[q] ^ fp2[node]) <= second
                label = _hook(label, q[near], node[near])
                continue
            if len(q) * FAN > FRONTIER and len(q) > 1:
                half = len(q) // 2
                stack += [(level, q[:half], node[:half], acc[:half]), (level, q[half:], node[half:], acc[half:])]
                continue
            stop = np.append(child[1:], len(levels[level - 1][0]))
            n = stop[node] - child[node]
            below = np.repeat(child[node] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            q2, up = np.repeat(q, n), np.repeat(node, n)
            own = levels[level - 1][2][below] & ~mask[up]  # what the child shares and its parent doesn't
            acc = np.repeat(acc, n) + np.bitwise_count((fp[q2] ^ levels[level - 1][3][below]) & own)
            stack.append((level - 1, q2, below, acc))
    far = np.flatnonzero(label != np.arange(len(fp)))
    return fp[far], fp2[far], fp[label[far]], fp2[label[far]]


def block_masks(limit: int) -> list[tuple[int, list[int]]]:
    """For each pair of limit + 2 blocks of bits: the mask of the pair, and masks that part the other bits in limit + 1."""
    bounds = [64 * i // (limit + 2) for i in range(limit + 3)]
    blocks = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(bounds, bounds[1:])]
    out = []
    for x, y in combinations(blocks, 2):
        left = [b for b in range(64) if not (x | y) >> b & 1]
        cuts = [len(left) * i // (limit + 1) for i in range(limit + 2)]
        out.append((x | y, [sum(1 << b for b in left[lo:hi]) for lo, hi in zip(cuts, cuts[1:])]))
    return out


def _signed(mask: int) -> Column:
    return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")


def _large(routed: DataFrame, node_rows: int) -> DataFrame:
    return routed.groupBy("key").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > node_rows)


def _route(fps: DataFrame, node_rows: int, limit: int) -> DataFrame:
    """(key, fp, fp2): each fingerprint under its topmost nodes; large ones parted by a third block, and then by pairs of chunks."""
    masks = block_masks(limit)
    tops = F.array(*[F.struct(F.lit(i).alias("i"), F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(_signed(m))).alias("key")) for i, (m, _) in enumerate(masks)])
    routed = fps.select("fp", "fp2", F.explode(tops).alias("t")).select("fp", "fp2", "t.i", "t.key")
    top = routed.join(_large(routed, node_rows), "key", "left")
    small = top.filter("__n is null").select("key", "fp", "fp2")
    table = F.array(*[F.array(*[_signed(m) for m in rest]) for _, rest in masks])
    thirds = F.transform(F.get(table, F.col("i")), lambda m, j: F.xxhash64("key", j, F.col("fp").bitwiseAND(m)))
    parts = top.filter("__n is not null").select("fp", "fp2", F.explode(thirds).alias("key"))
    cut = parts.join(_large(parts, node_rows), "key", "left").withColumn("__parts", F.ceil(F.coalesce(F.col("__n"), F.lit(1)) / node_rows).cast("int"))
    mine = F.pmod(F.xxhash64(F.lit("chunk"), "fp", "fp2"), F.col("__parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("__parts") - 1), lambda j: F.xxhash64("key", F.least(mine, j), F.greatest(mine, j)))
    whole, split = cut.filter("__n is null").select("key", "fp", "fp2"), cut.filter("__n is not null").select(F.explode(pairs).alias("key"), "fp", "fp2")
    return small.unionByName(whole).unionByName(split)


NODE = "struct<fp:long,fp2:long>"


def links(fps: DataFrame, node_rows: int = NODE_ROWS, limit: int = LIMIT, second: int = 64) -> DataFrame:
    """(a, b), a > b, each (fp, fp2) as signed longs: edges that connect all distinct fingerprints within the limits.
    `fps`: distinct non-null fp and fp2."""
    routed = _route(fps, node_rows, limit)
    names = ["fp", "fp2", "to", "to2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, rows
            k, f, g = (np.concatenate([h[i] for h in held]) for i in range(3))
            end = len(k) if last else int(np.flatnonzero(k != k[-1])[-1]) + 1 if (k != k[-1]).any() else 0
            if end:
                edges = link_groups(k[:end], f[:end].view(np.uint64), g[:end].view(np.uint64), limit, second)
                yield pa.RecordBatch.from_arrays([pa.array(e.view(np.int64)) for e in edges], names)
            held, rows = [(k[end:], f[end:], g[end:])], len(k) - end

        for batch in batches:
            held.append(tuple(batch.column(i).to_numpy() for i in range(3)))
            rows += batch.num_rows
            if rows >= ROWS:
                yield from flush(False)
        if rows:
            yield from flush(True)

    found = routed.repartition("key").sortWithinPartitions("key").mapInArrow(run, ", ".join(f"{n} long" for n in names))
    x, y = F.struct("fp", "fp2"), F.struct(F.col("to").alias("fp"), F.col("to2").alias("fp2"))
    return found.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each node of `edges` (a > b) reaches; large-star and small-star in turn."""

    def measure(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    now = materialise(edges, "edges")
    seen = measure(now)
    for _ in range(rounds if seen[0] else 0):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written first: a join with a grouping that isn't can't be parted where one node has many edges
        least = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b")
        large = materialise(large, "large")
        lows = materialise(large.groupBy("a").agg(F.min("b").alias("m")), "lows")
        down = large.join(lows, "a")
        small = down.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lows.select("a", F.col("m").alias("b")))
        after = materialise(small.filter("a > b").distinct(), "edges")
        drop_materialised(now.sparkSession, now, least, large, lows)
        now, before = after, seen
        seen = measure(now)
        if seen == before:
            break
    else:
        if seen[0]:
            raise RuntimeError(f"components aren't settled after {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, limit: int = LIMIT, second: int | None = None) -> DataFrame:
    """One row per row of `docs`: id, fp (signed long), component_id (the smallest id reachable; null where all are).

    `second`: the bits that may differ in a second fingerprint; None leaves it out. Null and empty texts, and texts
    without words, have fingerprint 0 and link like any other. Repeated rows and repeated ids each keep their row.
    Texts of any length are read as a whole. Other columns don't matter. An empty table gives an empty result.
    """
    plain = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    rows = materialise(fingerprints(plain, "__id", "__text", width, second is not None), "fingerprints")
    classes = materialise(rows.groupBy("fp", "fp2").agg(F.min("__id").alias("__first")), "classes")
    roots = components(links(classes, NODE_ROWS, limit, 64 if second is None else second))
    own = F.struct("fp", "fp2")
    rooted = classes.join(roots, own == F.col("node"), "left").select("fp", "fp2", "__first", F.coalesce("root", own).alias("root"))
    firsts = materialise(rooted.groupBy("root").agg(F.min("__first").alias("component_id")), "firsts")
    named = materialise(rooted.join(firsts, "root").select("fp", "fp2", "component_id"), "named")
    return rows.join(named, ["fp", "fp2"]).select(F.col("__id").alias(id_col), "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = NEAR_SHINGLE, limit: int = NEAR_LIMIT, second: int | None = NEAR_SECOND) -> DataFrame:
    """The rows of `docs`, all columns as they were, whose id is the smallest of its group of near-duplicates; a row
    without id stays if its whole group has none.

    Ids are taken to name documents: rows that repeat the id of one that stays, stay with it.
    """
    groups = near_groups(docs, id_col, text_col, width, limit, second)
    gone = groups.filter(~F.col(id_col).eqNullSafe(F.col("component_id")))
    stay = groups.filter(F.col(id_col).eqNullSafe(F.col("component_id")))
    away = materialise(gone.select(F.col(id_col).alias("__gone")).join(stay.select(F.col(id_col).alias("__stay")), F.col("__gone").eqNullSafe(F.col("__stay")), "left_anti").distinct(), "gone")
    return docs.join(away, F.col(id_col).eqNullSafe(F.col("__gone")), "left_anti")
