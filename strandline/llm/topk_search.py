"""Exact top-k by inner product through a dual-tree search over cover trees.

Vectors are dealt to cells around pivots, whose number grows with the rows; small cells join to groups and large ones are
cut, into blocks of about `BLOCK` rows. Each block's cover tree is built once and written. A task takes pairs of a query
block and a candidate block and visits pairs of nodes: the inner product of any two members is at most
c·d + r|d| + s|c| + rs for centres c, d and radii r, s, and a pair of nodes goes once that is below the worst kth score
of the query node. Rounds go from near to far: first the blocks of each query's own cell, then those of the highest
bounds, then the rest; after each round the kth scores so far rule out pairs of groups as a whole and are the floors of
the next round's searches.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, small_batches

#: Pivots: one for PIVOT_ROWS rows, within these bounds; they are chosen from SAMPLE rows each.
PIVOTS, PIVOT_ROWS, SAMPLE = (32, 1024), 4096, 64
#: Rows of a block of candidates; of queries, a quarter.
BLOCK = 8192
#: Candidate groups that a query group visits in the second round.
NEAR = 3
LEAF, SHRINK = 128, 1.4
SLACK = 1e-9


class CoverTree:
    """Nodes as arrays: centre, radius, children or a leaf's rows.

    A node's radius is measured, so it covers all its rows. Children's centres are chosen farthest first and lie further
    apart than the node's reach, which is its radius by SHRINK; there are at most as many as fill leaves, so where a node
    spreads in too many directions some of its rows lie beyond the reach of all of them. Nodes of LEAF rows aren't split.
    """

    def __init__(self, points: np.ndarray) -> None:
        self.points = points
        self.norm2 = np.einsum("ij,ij->i", points, points)
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.rows: list[np.ndarray] = []
        if len(points):
            self._build(np.arange(len(points)), 0)

    def _distance(self, rows: np.ndarray, to: int) -> np.ndarray:
        d = self.norm2[rows] + self.norm2[to] - 2 * (self.points[rows] @ self.points[to])
        return np.sqrt(np.maximum(d, 0))

    def _build(self, rows: np.ndarray, centre: int) -> int:
        todo = [(rows, centre, -1)]
        while todo:
            rows, centre, parent = todo.pop()
            far = self._distance(rows, centre)
            node = len(self.centre)
            self.centre.append(centre)
            self.radius.append(float(far.max()) * (1 + SLACK) + SLACK)
            self.children.append([])
            self.rows.append(rows)
            if parent >= 0:
                self.children[parent].append(node)
            if len(rows) <= LEAF or far.max() <= 0:
                continue
            reach = float(far.max()) / SHRINK
            nearest, own = far.copy(), np.full(len(rows), centre)
            for _ in range(max(2, len(rows) // LEAF * 2)):  # cover what lies beyond reach of all centres so far
                at = int(nearest.argmax())
                if nearest[at] <= reach:
                    break
                d = self._distance(rows, int(rows[at]))
                closer = d < nearest
                nearest[closer], own[closer] = d[closer], rows[at]
            order = np.argsort(own, kind="stable")
            cuts = np.flatnonzero(np.diff(own[order])) + 1
            for part in np.split(order, cuts):
                if len(part) == len(rows):
                    break
                todo.append((rows[part], int(own[part[0]]), node))
        return 0

    def leaf(self, node: int) -> bool:
        return not self.children[node]


def search(qt: CoverTree, query_ids: np.ndarray, ct: CoverTree, ids: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scores, places in the candidates' rows), each queries × k, best first, -inf where there are fewer; candidates with the query's id don't count.

    `floor`: for each query a score that k others are known to reach; what lies below needn't be returned.
    """
    queries, rows = qt.points, ct.points
    top = np.full((len(queries), k), -np.inf)
    place = np.zeros((len(queries), k), dtype=np.int64)
    if not len(rows) or not len(queries):
        return top, place
    qn, cn = np.sqrt(qt.norm2), np.sqrt(ct.norm2)

    def bound(a: int, b: int) -> float:
        c, d, r, s = qt.centre[a], ct.centre[b], qt.radius[a], ct.radius[b]
        ub = float(queries[c] @ rows[d]) + r * cn[d] + s * qn[c] + r * s
        return ub + abs(ub) * SLACK + SLACK

    todo = [(bound(0, 0), 0, 0)]
    while todo:
        ub, a, b = todo.pop()
        q = qt.rows[a]
        worst = np.maximum(top[q, -1], floor[q]).min()
        if ub < worst:
            continue
        if qt.leaf(a) and ct.leaf(b):
            for at in range(0, len(ct.rows[b]), 4096):
                c = ct.rows[b][at : at + 4096]
                for begin in range(0, len(q), 1024):
                    _leaf(queries, query_ids, rows, ids, top, place, q[begin : begin + 1024], c, k)
            continue
        if ct.leaf(b) or (not qt.leaf(a) and qt.radius[a] >= ct.radius[b]):
            pairs = [(bound(x, b), x, b) for x in qt.children[a]]
        else:
            pairs = [(bound(a, x), a, x) for x in ct.children[b]]
        todo += sorted(pairs)
    return top, place


def _leaf(queries, query_ids, rows, ids, top, place, q, c, k) -> None:
    s = queries[q] @ rows[c].T
    s[query_ids[q][:, None] == ids[c][None, :]] = -np.inf
    hit = np.flatnonzero((s >= top[q, -1][:, None]).any(axis=1))
    if not len(hit):
        return
    s, q = s[hit], q[hit]
    if s.shape[1] > k:  # keep what reaches the kth best, ties included by id
        by = np.argsort(ids[c], kind="stable")
        s, c = s[:, by], c[by]
        best = np.argsort(-s, axis=1, kind="stable")[:, :k]
        s, cols = np.take_along_axis(s, best, 1), c[best]
    else:
        cols = np.broadcast_to(c, s.shape)
    score = np.concatenate([top[q], s], axis=1)
    where = np.concatenate([place[q], cols], axis=1)
    order = np.lexsort((ids[where], -score), axis=1)[:, :k]
    top[q], place[q] = np.take_along_axis(score, order, 1), np.take_along_axis(where, order, 1)


def valid_vectors(table: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(key, id, v array<long>, dim): rows whose vector, floor(scale · x) by component, takes part; key tells rows apart.

    Null ids and null vectors, vectors with a null or non-finite component and empty vectors don't. Rows that repeat an
    id are rows of their own.
    """
    fine = F.forall("__v", lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")), F.lit(False)))
    v = F.transform("__v", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = table.select(F.col(id_col).alias("id"), F.col(vector_col).alias("__v")).filter(F.col("id").isNotNull() & F.col("__v").isNotNull() & fine & (F.size("__v") > 0))
    return rows.select(F.monotonically_increasing_id().alias("key"), "id", v.alias("v")).withColumn("dim", F.size("v"))


def _pivots(rows: DataFrame, count: int) -> dict[int, np.ndarray]:
    """For each dimension up to `count` vectors far from each other, of a bounded sample."""
    out: dict[int, np.ndarray] = {}
    sample = rows.select("dim", "v").orderBy(F.xxhash64("id"), "key").limit(count * SAMPLE).toArrow()
    dims = sample["dim"].to_numpy()
    for dim in np.unique(dims):
        part = sample["v"].filter(pa.array(dims == dim)).combine_chunks()
        points = part.values.to_numpy()[part.offsets.to_numpy()[0] : part.offsets.to_numpy()[-1]].reshape(-1, int(dim)).astype(float)
        chosen = [0]
        far = np.linalg.norm(points - points[0], axis=1)
        while len(chosen) < min(count, len(points)) and far.max() > 0:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, np.linalg.norm(points - points[chosen[-1]], axis=1))
        out[int(dim)] = points[chosen]
    return out


def _groups(rows: dict[tuple[int, int], int], block: int) -> dict[tuple[int, int], tuple[int, int]]:
    """For each (dimension, cell) its group and the parts that the group is cut to: small cells of a dimension share one."""
    out: dict[tuple[int, int], tuple[int, int]] = {}
    group, held, last = -1, 0, None
    for (d, c), n in sorted(rows.items()):
        if d != last or held + n > block:
            group, held, last = group + 1, 0, d
        held += n
        out[d, c] = (group, max(1, -(-n // block)))
    return out


def _packed(f: pa.Table) -> bytes:
    """A block's rows and their cover tree."""
    v = f["v"].combine_chunks()
    points = v.flatten().to_numpy().reshape(f.num_rows, -1)
    small = next((t for t in (np.int16, np.int32) if np.abs(points).max(initial=0) <= np.iinfo(t).max), np.int64)
    tree = CoverTree(points.astype(float))
    parts = (tree.centre, tree.radius, tree.children, tree.rows)
    return pickle.dumps((points.astype(small), np.array(f["id"].to_pylist()), f["key"].to_numpy(), parts), protocol=5)


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, CoverTree]:
    points, ids, keys, parts = pickle.loads(blob)
    tree = CoverTree(np.zeros((0, points.shape[1])))
    tree.points = points.astype(float)
    tree.norm2 = np.einsum("ij,ij->i", tree.points, tree.points)
    tree.centre, tree.radius, tree.children, tree.rows = parts
    return points, ids, keys, tree


def _blocks(rows: DataFrame, of: dict[tuple[int, int], tuple[int, int]]) -> DataFrame:
    """(grp, part, n, blob): the blocks of `rows`, which have dim and cell. A block's rows are bounded, so one task may hold them."""
    spark = rows.sparkSession
    places = F.broadcast(spark.createDataFrame([(d, c, g, n) for (d, c), (g, n) in of.items()], "dim int, cell long, grp int, parts int"))  # a row per cell
    dealt = rows.join(places, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))

    def build(key: tuple, f: pa.Table) -> pa.Table:
        return pa.table({"grp": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()), "n": pa.array([f.num_rows], pa.int64()), "blob": pa.array([_packed(f)], pa.binary())})

    return materialise(dealt.select("grp", "part", "key", "id", "v").groupBy("grp", "part").applyInArrow(build, "grp int, part int, n long, blob binary"), "blocks")


def top_k(table: DataFrame, queries: str, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, <id_col>, score): for each row that `queries` (a SQL condition on the id, there called id) keeps, the k largest inner
    products with rows of its dimension that have another id, ties to the smaller id; all, if there are fewer.

    Rows that repeat an id are queries and candidates each, and not candidates of one another. Of candidates with the
    same vector only 2k rows, k of an id at most, can rank, so a vector that many rows share is cut to these before it
    is dealt. Ids may be numbers or strings. See valid_vectors for what takes part. A score beyond a long is cut to its
    range. An empty table gives an empty result.
    """
    spark = table.sparkSession
    small_batches(spark)
    rows = materialise(valid_vectors(table, id_col, vector_col, scale), "vectors")
    kind = dict(rows.dtypes)["id"]
    count = min(max(PIVOTS[0], rows.count() // PIVOT_ROWS), PIVOTS[1])
    pivots = spark.sparkContext.broadcast(_pivots(rows, count))

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            cell, far = np.zeros(len(f), np.int64), np.zeros(len(f))
            for dim, at in f.groupby("dim").indices.items():
                x = np.array(f["v"].iloc[at].tolist(), dtype=float)
                p = pivots.value.get(int(dim))
                p = np.zeros((1, dim)) if p is None else p
                d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2 * x @ p.T, 0))
                cell[at], far[at] = d.argmin(1), d.min(1)
            yield f.assign(cell=cell, far=far * (1 + SLACK) + 1e-6)

    dealt = materialise(rows.mapInPandas(deal, f"key long, id {kind}, v array<long>, dim int, cell long, far double"), "dealt")
    of_id = W.partitionBy("dim", "v", "id").orderBy("key")
    few = dealt.withColumn("__n", F.row_number().over(of_id)).filter(F.col("__n") <= k)
    few = few.withColumn("__n", F.row_number().over(W.partitionBy("dim", "v").orderBy("id", "key"))).filter(F.col("__n") <= 2 * k).drop("__n")
    asked = dealt.filter(queries)
    sizes = lambda rows: {(r.dim, r.cell): (r.n, r.far) for r in rows.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()}
    few = materialise(few, "candidates")
    side_c, side_q = sizes(few), sizes(asked)
    q_of, c_of = _groups({k: v[0] for k, v in side_q.items()}, max(1, block // 4)), _groups({k: v[0] for k, v in side_c.items()}, block)
    found = f"qg int, qp int, pos int, query_id {kind}, id {kind}, key long, score long"
    if not q_of or not c_of:
        return spark.createDataFrame([], found).select("query_id", F.lit(1).alias("rank"), F.col("id").alias(id_col), "score")
    q_blocks, c_blocks = _blocks(asked, q_of), _blocks(few, c_of)
    bounds = _bounds(side_q, side_c, q_of, c_of, pivots.value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for b in batches:
            for r in range(b.num_rows):
                qg, qp, q_blob, floors, c_blob = (b.column(i)[r].as_py() for i in range(5))
                if held is None or held[0] != c_blob:
                    held = (c_blob, _unpacked(c_blob))
                q_points, q_ids, _, qt = _unpacked(q_blob)
                c_points, c_ids, c_keys, ct = held[1]
                codes = np.unique(np.concatenate([q_ids, c_ids]), return_inverse=True)[1]
                q_code, c_code = codes[: len(q_ids)], codes[len(q_ids) :]
                floor = np.full(len(q_ids), -np.inf)
                for f in floors or []:
                    floor[f["pos"]] = f["floor"]
                if float(np.abs(qt.points).max()) * float(np.abs(ct.points).max()) * q_points.shape[1] < 2.0**52:  # sums are exact
                    s, at = search(qt, q_code, ct, c_code, k, floor)
                else:
                    s, at = _plain(q_points, q_code, c_points, c_code, k)
                i, j = np.nonzero(s > -np.inf)
                columns = [pa.array([qg] * len(i), pa.int32()), pa.array([qp] * len(i), pa.int32()), pa.array(i, pa.int32()), pa.array(q_ids[i]), pa.array(c_ids[at[i, j]]), pa.array(c_keys[at[i, j]])]
                scores = pa.array([min(max(int(v), -(1 << 63)), (1 << 63) - 1) for v in s[i, j]], pa.int64())
                yield pa.Table.from_arrays([*columns, scores], ["qg", "qp", "pos", "query_id", "id", "key", "score"]).cast(kinds).to_batches()[0] if len(i) else pa.RecordBatch.from_pylist([], kinds)

    kinds = pa.schema([("qg", pa.int32()), ("qp", pa.int32()), ("pos", pa.int32()), ("query_id", _arrow(kind)), ("id", _arrow(kind)), ("key", pa.int64()), ("score", pa.int64())])
    best = W.partitionBy("qg", "qp", "pos").orderBy(F.desc("score"), "id", "key")

    def search_round(pairs: list[tuple[int, int]], before: DataFrame | None) -> DataFrame:
        """`before` and what the pairs of groups find, the best k of each query."""
        to = spark.createDataFrame(pairs, "qg int, cg int")
        q = q_blocks.select(F.col("grp").alias("qg"), F.col("part").alias("qp"), F.col("blob").alias("q_blob"))
        if before is not None:
            kth = before.filter(F.col("rank") == k).groupBy("qg", "qp").agg(F.collect_list(F.struct("pos", F.col("score").cast("double").alias("floor"))).alias("floors"))  # of one block
            q = q.join(kth, ["qg", "qp"], "left")
        else:
            q = q.withColumn("floors", F.lit(None).cast("array<struct<pos:int,floor:double>>"))
        c = c_blocks.select(F.col("grp").alias("cg"), F.col("part").alias("cp"), F.col("blob").alias("c_blob"))
        work = q.join(F.broadcast(to), "qg").join(c.hint("shuffle_merge"), "cg").select("qg", "qp", "q_blob", "floors", "c_blob", "cg", "cp")
        work = work.repartition("cg", "cp", F.pmod(F.xxhash64("qg", "qp"), F.lit(8))).sortWithinPartitions("cg", "cp").select("qg", "qp", "q_blob", "floors", "c_blob")
        new = work.mapInArrow(run, found)
        every = before.drop("rank").unionByName(new) if before is not None else new
        return materialise(every.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k), "round")

    own = sorted({(q_of[c][0], c_of[c][0]) for c in side_q if c in side_c})
    done, result = set(), None
    for step in range(3):
        worst = {} if result is None else _worst(result, k, q_blocks)
        open_ = [(p, ub) for p, ub in bounds.items() if p not in done and ub >= worst.get(p[0], -np.inf)]
        if step == 0:
            pairs = own
        elif step == 1:
            by: dict[int, list] = {}
            for (qg, cg), ub in open_:
                by.setdefault(qg, []).append((-ub, cg))
            pairs = sorted((qg, cg) for qg, some in by.items() for _, cg in sorted(some)[:NEAR])
        else:
            pairs = sorted(p for p, _ in open_)
        if pairs:
            result = search_round(pairs, result)
            done |= set(pairs)
    return result.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")


def _arrow(kind: str) -> pa.DataType:
    return {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}[kind]


def _bounds(side_q: dict, side_c: dict, q_of: dict, c_of: dict, pivots: dict[int, np.ndarray]) -> dict[tuple[int, int], float]:
    """For each pair of groups of one dimension the largest inner product that their members can have, by cells' radii."""
    out: dict[tuple[int, int], float] = {}
    for d in {d for d, _ in side_q}:
        p = pivots.get(d, np.zeros((1, d)))
        norm = np.linalg.norm(p, axis=1)
        cs = [c for dd, c in side_c if dd == d]
        s = np.array([side_c[d, c][1] for c in cs])
        for dd, qc in side_q:
            if dd == d and cs:
                r = side_q[d, qc][1]
                ub = p[cs] @ p[qc] + r * norm[cs] + s * norm[qc] + r * s
                ub = ub + np.abs(ub) * SLACK + 1e-6
                for c, x in zip(cs, ub.tolist()):
                    pair = (q_of[d, qc][0], c_of[d, c][0])
                    out[pair] = max(x, out.get(pair, -np.inf))
    return out


def _worst(result: DataFrame, k: int, blocks: DataFrame) -> dict[int, float]:
    """For each query group the smallest kth score of its queries so far; groups in which one has fewer than k aren't there."""
    held = result.groupBy("qg").agg(F.sum((F.col("rank") == k).cast("long")).alias("full"), F.min(F.when(F.col("rank") == k, F.col("score"))).alias("least"))
    n = blocks.groupBy(F.col("grp").alias("qg")).agg(F.sum("n").alias("n"))
    return {r.qg: float(r.least) for r in held.join(n, "qg").filter("full = n").collect()}


def _plain(a: np.ndarray, a_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The same by unbounded integers, for components so large that doubles would round."""
    top, place = np.full((len(a), k), -np.inf, dtype=object), np.zeros((len(a), k), dtype=np.int64)
    big = c.astype(object)
    for i in range(len(a)):
        s = big @ a[i].astype(object) if len(c) else np.zeros(0, object)
        order = sorted((j for j in range(len(c)) if c_ids[j] != a_ids[i]), key=lambda j: (-s[j], c_ids[j]))[:k]
        top[i, : len(order)] = [s[j] for j in order]
        place[i, : len(order)] = order
    return top, place
