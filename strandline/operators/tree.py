"""Trees in DataFrames: node tables with each node's path to the root, and rows of Newick text handled in batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tree as T
from ..session import ship

NODE_SCHEMA = "tree_id string, node int, parent int, name string, length double, support double, is_tip boolean, path array<int>, path_dist array<double>"


def node_table(trees: DataFrame, id_col: str = "tree_id", newick: str = "newick") -> DataFrame:
    """Rows of Newick text as nodes, one batch function; nodes are numbered in preorder. `path` lists a node and its
    ancestors up to the root, `path_dist` the distances to them (edges without a length count 1), so that queries over
    ancestors are explodes and not joins in a loop."""
    ship(trees.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for i, t in zip(f[id_col], f[newick]):
                paths: dict[int, tuple[list[int], list[float]]] = {}
                for node, parent, name, length, support, tip in T.parse_newick(t).table():
                    up, far = paths[parent] if parent is not None else ([], [])
                    step = 1.0 if length is None else length
                    paths[node] = [node, *up], [0.0, *(d + step for d in far)]
                    rows.append((str(i), node, parent, name, length, support, tip, *paths[node]))
            out = pd.DataFrame(rows, columns=["tree_id", "node", "parent", "name", "length", "support", "is_tip", "path", "path_dist"])
            yield out.astype({"parent": "Int32"})

    return trees.select(id_col, newick).mapInPandas(run, NODE_SCHEMA)


def make_tree(spark: SparkSession, newick: str, tree_id: str = "t") -> DataFrame:
    return node_table(spark.createDataFrame([(tree_id, newick)], "tree_id string, newick string"))


def ancestors(nodes: DataFrame) -> DataFrame:
    """(tree_id, node, ancestor, steps, dist), each node its own ancestor too."""
    rows = nodes.select("tree_id", "node", F.posexplode(F.arrays_zip("path", "path_dist")).alias("steps", "p"))
    return rows.select("tree_id", "node", F.col("p.path").alias("ancestor"), "steps", F.col("p.path_dist").alias("dist"))


def root_distances(nodes: DataFrame) -> DataFrame:
    """(tree_id, node, name, steps, dist) to the root."""
    return nodes.select("tree_id", "node", "name", (F.size("path") - 1).alias("steps"), F.element_at("path_dist", -1).alias("dist"))


def tip_to_tip(nodes: DataFrame) -> DataFrame:
    """(tree_id, name1, name2, dist): tips meet by shared ancestor, the lowest one, where the path is shortest, counts."""
    tips = nodes.filter("is_tip")
    up = ancestors(tips).join(tips.select("tree_id", "node", "name"), ["tree_id", "node"]).select("tree_id", "ancestor", "name", "steps", "dist")
    a, b = up.toDF("tree_id", "ancestor", "name1", "s1", "d1"), up.toDF("tree_id", "ancestor", "name2", "s2", "d2")
    pairs = a.join(b, ["tree_id", "ancestor"]).filter("name1 < name2")
    return pairs.groupBy("tree_id", "name1", "name2").agg(F.min_by(F.col("d1") + F.col("d2"), F.col("s1") + F.col("s2")).alias("dist"))


def total_length(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("tree_id").agg(F.sum(F.when(F.col("parent").isNotNull(), F.col("length"))).alias("total_length"))


def clades(nodes: DataFrame) -> DataFrame:
    """(tree_id, node, clade): the sorted tips below each inner node."""
    tips = nodes.filter("is_tip").select("tree_id", "node", "name")
    below = ancestors(nodes).join(tips, ["tree_id", "node"])
    sets = below.groupBy("tree_id", "ancestor").agg(F.array_sort(F.collect_set("name")).alias("clade"))
    inner = nodes.filter("NOT is_tip").select("tree_id", F.col("node").alias("ancestor"))
    return sets.join(inner, ["tree_id", "ancestor"]).withColumnRenamed("ancestor", "node")


def clade_support(nodes: DataFrame) -> DataFrame:
    """(clade, n, freq) over many trees: what a majority consensus counts."""
    n = F.broadcast(nodes.agg(F.count_distinct("tree_id").alias("trees")))
    c = clades(nodes).select("tree_id", "clade").distinct().groupBy("clade").agg(F.count(F.lit(1)).alias("n"))
    return c.crossJoin(n).select("clade", "n", (F.col("n") / F.col("trees")).alias("freq"))


def map_trees(trees: DataFrame, f, id_col: str = "tree_id", newick: str = "newick") -> DataFrame:
    """Every tree through a function of a tree, as Newick text again."""
    ship(trees.sparkSession)

    @F.pandas_udf("string")
    def apply(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: f(T.parse_newick(t)).newick(), na_action="ignore")

    return trees.withColumn(newick, apply(newick))


def tree_distances(trees: DataFrame, method: str = "unrooted_robinson_foulds", id_col: str = "tree_id") -> DataFrame:
    """(id1, id2, dist) of all pairs of trees, by pairs of blocks."""
    from .distance import all_pairs

    ship(trees.sparkSession)

    @F.pandas_udf("double")
    def dist(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([float(T.tree_distance(T.parse_newick(x), T.parse_newick(y), method)) for x, y in zip(a, b)])

    pairs = all_pairs(trees.select(F.col(id_col).alias("name"), "newick"))
    return pairs.select(F.col("name1").alias("id1"), F.col("name2").alias("id2"), dist("newick1", "newick2").alias("dist"))


def quick_trees(dists: DataFrame, by: Sequence[str] = (), method: str = "nj") -> DataFrame:
    """(by…, newick): a tree of each group's distances (name1, name2, dist); a group is one matrix, in one task."""
    import numpy as np

    ship(dists.sparkSession)
    keys = list(by)
    rows = dists if keys else dists.withColumn("__all", F.lit(1))
    build = T.nj if method == "nj" else T.upgma

    def run(g: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(g["name1"]) | set(g["name2"]))
        at = {n: i for i, n in enumerate(names)}
        m = np.zeros((len(names), len(names)))
        for a, b, d in zip(g["name1"], g["name2"], g["dist"]):
            m[at[a], at[b]] = m[at[b], at[a]] = d
        return pd.DataFrame([{k: g[k].iloc[0] for k in keys} | {"newick": build([str(n) for n in names], m).newick()}])

    kinds = dict(dists.dtypes)
    return rows.groupBy(*(keys or ["__all"])).applyInPandas(run, ", ".join([f"`{k}` {kinds[k]}" for k in keys] + ["newick string"]))


def consensus(trees: DataFrame, strict: bool = False) -> DataFrame:
    """(newick): the majority tree of a collection (newick, optionally weight), put together from clade counts."""
    rows = trees.select("newick", F.col("weight") if "weight" in trees.columns else F.lit(1.0).alias("weight")).collect()
    made = T.consensus([T.parse_newick(r[0]) for r in rows], [float(r[1]) for r in rows], strict)
    return trees.sparkSession.createDataFrame([(made.newick(),)], "newick string")


def tips_within(nodes: DataFrame, node: Column, distance: float) -> DataFrame:
    """Tips whose path up to the given ancestor node is no longer than `distance`."""
    near = ancestors(nodes).filter((F.col("ancestor") == node) & (F.col("dist") <= distance))
    return near.join(nodes.filter("is_tip"), ["tree_id", "node"]).select("tree_id", "name", "dist")
