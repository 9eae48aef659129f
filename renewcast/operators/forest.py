"""Random forests grown level by level from distributed histograms, with a true minimum of rows to split a node.

Every feature is cut into bins once.  For each level, one aggregate over the rows counts classes per (tree, node, feature, bin), combined before
the shuffle; running sums over the bins give both sides of every candidate split, and the best of each node
(at most trees x 2 ** level rows) comes to the driver.  Rows carry their bins and their weight in each tree's bag; a
row's node is found again from the splits so far, so no row is rewritten between levels.

* A bag gives each row a weight for each tree, Poisson with mean 1, from a hash of its key: the same in every run and partition.
* A node of fewer than ``min_split`` rows is a leaf; a split leaves at least ``min_leaf`` rows on both sides (rows of the bag, however
  often drawn).  A node of one class, or without a split that lowers the impurity, is a leaf.
* Each node chooses among as many features as ``feature_subset`` says, those with the smallest hash of seed, tree, node and name.
* Of equal gains (to ten decimals) the first feature by name wins, then the smallest cut.
* Null features count as NaN, which is above every cut.  Rows that share a key share their weights.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from renewcast.operators.compiled import Tree
from renewcast.session import written

BINS, ACCURACY = 32, 100_000
#: Cells of a level's histogram that a task holds at once, 24 bytes each.
MAX_CELLS = 4_000_000
#: Upper bounds of the first eight hex digits of a hash for a weight of 0, 1, ...: Poisson with mean 1.
POISSON = [f"{int(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) * 2 ** 32):08x}" for k in range(9)]


@dataclass
class Node:
    """A node by its place in the full binary tree (root 1, children 2n and 2n + 1): rows, weight and weight of class 1."""
    place: int
    rows: int
    weight: int
    ones: int
    feature: str | None = None
    cut: float | None = None
    gain: float | None = None


@dataclass
class GrownForest:
    features: list[str]
    nodes: list[dict[int, Node]]                    # one dict per tree, by place
    params: dict = field(default_factory=dict)

    @property
    def getNumTrees(self) -> int:
        """As Spark's models have it."""
        return len(self.nodes)

    @property
    def trees(self) -> list[Tree]:
        """Node tables for scoring; a leaf's value is its share of class 1 by weight."""
        out = []
        for nodes in self.nodes:
            places = sorted(nodes)
            at = {p: i for i, p in enumerate(places)}
            inner = [nodes[p].feature is not None for p in places]
            out.append(Tree([self.features.index(nodes[p].feature) if i else 0 for p, i in zip(places, inner)],
                            [nodes[p].cut if i else 0.0 for p, i in zip(places, inner)],
                            [at[2 * p] if i else at[p] for p, i in zip(places, inner)],
                            [at[2 * p + 1] if i else at[p] for p, i in zip(places, inner)],
                            [nodes[p].ones / nodes[p].weight if nodes[p].weight else 0.0 for p in places]))
        return out

    def node_table(self, spark: SparkSession) -> DataFrame:
        """(tree, node, feature, cut, gain, rows, weight, ones); feature, cut and gain are null for leaves."""
        rows = [(t, n.place, n.feature, n.cut, n.gain, n.rows, n.weight, n.ones) for t, nodes in enumerate(self.nodes) for n in nodes.values()]
        return spark.createDataFrame(rows, "tree int, node int, feature string, cut double, gain double, rows long, weight long, ones long")

    @staticmethod
    def from_table(nodes: DataFrame, features: Sequence[str], params: Mapping | None = None) -> GrownForest:
        found: dict[int, dict[int, Node]] = {}
        for r in nodes.collect():                       # at most trees x 2 ** (depth + 1) rows
            found.setdefault(r["tree"], {})[r["node"]] = Node(r["node"], r["rows"], r["weight"], r["ones"], r["feature"], r["cut"], r["gain"])
        return GrownForest(list(features), [found[t] for t in sorted(found)], dict(params or {}))


def candidate_cuts(rows: DataFrame, features: Sequence[str], bins: int = BINS, accuracy: int = ACCURACY) -> dict[str, list[float]]:
    """Cut values per feature: the distinct i/bins quantiles, values of the column itself (exact up to accuracy / 2 rows, beyond that within
    1 / accuracy of the rank); one aggregate, one row."""
    at = [i / bins for i in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(F.col(f"`{c}`").cast("double"), at, accuracy).alias(c) for c in features]).first()
    return {c: sorted({v for v in found[c] or [] if math.isfinite(v)}) for c in features}


def bin_of(column: str, cuts: Sequence[float]) -> Column:
    """How many cuts are below the value: bin k is at or below cut k.  A comparison tree, as deep as the logarithm of the cuts."""
    x = f"coalesce(CAST(`{column}` AS DOUBLE), double('NaN'))"

    def tree(low: int, high: int) -> str:
        if low == high:
            return str(low)
        mid = (low + high) // 2
        return f"CASE WHEN {x} <= double('{cuts[mid]!r}') THEN {tree(low, mid)} ELSE {tree(mid + 1, high)} END"

    return F.expr(tree(0, len(cuts)))


def bag_weight(key: Sequence[str], seed: int, tree: int) -> Column:
    """Weight of a row in a tree's bag, from the first eight hex digits of md5(key | seed | tree)."""
    digits = F.substring(F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in key], F.lit(f"{seed}|{tree}"))), 1, 8)
    weight = F.lit(len(POISSON))
    for k in range(len(POISSON) - 1, -1, -1):
        weight = F.when(digits < POISSON[k], F.lit(k)).otherwise(weight)
    return weight


def subset_size(rule: str, n: int) -> int:
    """How many features a node chooses from: sqrt, log2, all, or a share of them as text."""
    if rule in ("sqrt", "log2"):
        return max(1, int(math.sqrt(n) if rule == "sqrt" else math.log2(n)))
    return n if rule == "all" else max(1, int(float(rule) * n))


def node_features(features: Sequence[str], rule: str, seed: int, tree: int, place: int) -> list[str]:
    ranked = sorted(features, key=lambda f: hashlib.md5(f"{seed}|{tree}|{place}|{f}".encode()).hexdigest())
    return ranked[:subset_size(rule, len(features))]


def impurity(ones: Column, weight: Column, rule: str) -> Column:
    p = ones / weight
    if rule == "gini":
        return F.lit(1.0) - p * p - (F.lit(1.0) - p) * (F.lit(1.0) - p)
    log = lambda q: F.when(q > 0, q * F.log2(q)).otherwise(F.lit(0.0))
    return -log(p) - log(F.lit(1.0) - p)


def best_splits(histogram: DataFrame, min_leaf: int, rule: str) -> DataFrame:
    """(tree, node, gain, feature, bin, rows, weight, ones of the left side): each node's best split of those that lower the impurity."""
    node = ["tree", "node", "feature"]
    upto = Window.partitionBy(*node).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*node)
    h = histogram.select(*node, "bin", *[F.sum(c).over(upto).alias(c) for c in ("rows", "weight", "ones")],
                         *[F.sum(c).over(every).alias(f"all_{c}") for c in ("rows", "weight", "ones")])
    h = h.where((F.col("rows") >= max(1, min_leaf)) & (F.col("all_rows") - F.col("rows") >= max(1, min_leaf)))
    wl, wr = F.col("weight"), F.col("all_weight") - F.col("weight")
    right = impurity(F.col("all_ones") - F.col("ones"), wr, rule)
    gain = impurity(F.col("all_ones"), F.col("all_weight"), rule) - wl / F.col("all_weight") * impurity(F.col("ones"), wl, rule) \
        - wr / F.col("all_weight") * right
    h = h.withColumn("gain", F.round(gain, 10)).where("gain > 0")
    return h.groupBy("tree", "node").agg(F.min(F.struct((-F.col("gain")).alias("less"), "feature", "bin", "rows", "weight", "ones")).alias("s")) \
        .select("tree", "node", (-F.col("s.less")).alias("gain"), "s.feature", "s.bin", "s.rows", "s.weight", "s.ones")


def grow_forest(rows: DataFrame, features: Sequence[str], label: str = "churn", key: Sequence[str] = ("msno",), num_trees: int = 50,
                max_depth: int = 5, min_split: int = 2, min_leaf: int = 1, feature_subset: str = "sqrt", rule: str = "gini",
                seed: int = 42, cuts: Mapping[str, Sequence[float]] | None = None, bins: int = BINS, bagged: bool = True) -> GrownForest:
    """Grows ``num_trees`` trees of at most ``max_depth`` levels; rows without a label are left out."""
    features = list(features)
    rows = rows.where(F.col(label).isNotNull())
    cuts = {f: list(cuts[f]) for f in features} if cuts is not None else candidate_cuts(rows, features, bins)
    weights = [bag_weight(key, seed, t) if bagged else F.lit(1) for t in range(num_trees)]
    base = written(rows.select(F.col(label).cast("int").alias("y"), F.array(*[bin_of(f, cuts[f]) for f in features]).alias("b"),
                               F.array(*weights).cast("array<tinyint>").alias("w")), "binned_rows")
    sums = {r["tree"]: r for r in base.select("y", F.posexplode("w").alias("tree", "w")).where("w > 0").groupBy("tree").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("w").alias("weight"), F.sum(F.col("w") * F.col("y")).alias("ones")).collect()}
    none = {"rows": 0, "weight": 0, "ones": 0}
    forest = [{1: Node(1, *[int((sums.get(t) or none)[c]) for c in ("rows", "weight", "ones")])} for t in range(num_trees)]
    params = {"num_trees": num_trees, "max_depth": max_depth, "min_split": min_split, "min_leaf": min_leaf, "feature_subset": feature_subset,
              "impurity": rule, "seed": seed}
    for level in range(max_depth):
        open_ = {(t, p): node_features(features, feature_subset, seed, t, p) for t, nodes in enumerate(forest) for p, n in nodes.items()
                 if p >> level == 1 and n.rows >= max(2, min_split) and 0 < n.ones < n.weight}
        if not open_:
            break
        counted = level_histogram(base, features, cuts, forest, open_, level)
        for r in best_splits(counted, min_leaf, rule).collect():          # at most one row for each open node
            nodes = forest[r["tree"]]
            n = nodes[r["node"]]
            n.feature, n.cut, n.gain = r["feature"], cuts[r["feature"]][r["bin"]], r["gain"]
            nodes[2 * n.place] = Node(2 * n.place, r["rows"], r["weight"], r["ones"])
            nodes[2 * n.place + 1] = Node(2 * n.place + 1, n.rows - r["rows"], n.weight - r["weight"], n.ones - r["ones"])
    return GrownForest(features, forest, params)


def level_histogram(base: DataFrame, features: Sequence[str], cuts: Mapping[str, Sequence[float]], forest: Sequence[dict[int, Node]],
                    open_: Mapping[tuple[int, int], Sequence[str]], level: int) -> DataFrame:
    """(tree, node, feature, bin, rows, weight, ones) over the open nodes of a level, for the features each of them may split on.

    Each task walks its rows down every tree and counts them by cell, a batch at a time; the counts of the tasks are summed by Spark.  Counts are
    held over a task's batches up to ``MAX_CELLS``; larger levels hand on those of each tree and batch."""
    index = {f: i for i, f in enumerate(features)}
    width = 1 + max((len(c) for c in cuts.values()), default=0)
    tables = []                                             # per tree: split feature and cut by place, row of ``chosen`` by place, chosen
    for t in sorted({t for t, _ in open_}):
        split, cut, slot = np.full(1 << level, -1), np.zeros(1 << level, int), np.full(2 << level, -1)
        for p, n in forest[t].items():
            if n.feature is not None and p < len(split):
                split[p], cut[p] = index[n.feature], cuts[n.feature].index(n.cut)
        places = sorted(p for u, p in open_ if u == t)
        slot[places] = range(len(places))
        tables.append((t, split, cut, slot, np.array(places), np.array([sorted(index[f] for f in open_[t, p]) for p in places])))
    kept = sum(chosen.size for *_, chosen in tables) * width <= MAX_CELLS

    def counted(batches):
        sums = {}
        for batch in batches:
            y, b, w = (batch.column(c) for c in ("y", "b", "w"))
            y, b, w = (y.to_numpy(zero_copy_only=False), *(x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1) for x in (b, w)))
            for table in tables:
                t, split, cut, slot, _, chosen = table
                rows = np.flatnonzero(w[:, t])
                at = np.ones(len(rows), int)
                for _ in range(level):                      # from the root down to this level's nodes; 0 where a row ends in a leaf
                    at = np.where(split[at] < 0, 0, 2 * at + (b[rows, split[at]] > cut[at]))
                rows, s = rows[slot[at] >= 0], slot[at][slot[at] >= 0]
                cell = ((s[:, None] * chosen.shape[1] + np.arange(chosen.shape[1])) * width + b[rows[:, None], chosen[s]]).ravel()
                weight = np.repeat(w[rows, t].astype(float), chosen.shape[1])
                ones = weight * np.repeat(y[rows], chosen.shape[1])
                found = [np.bincount(cell, x, chosen.size * width) for x in (None, weight, ones)]
                if kept:
                    sums[t] = [a + b for a, b in zip(sums[t], found)] if t in sums else found
                else:
                    yield cells(table, found)
        for table in tables:
            if table[0] in sums:
                yield cells(table, sums[table[0]])

    def cells(table, found):
        t, _, _, _, places, chosen = table
        at = np.flatnonzero(found[0])
        pick = at // width
        return pa.RecordBatch.from_pydict({
            "tree": pa.array(np.full(len(at), t), pa.int32()), "node": pa.array(places[pick // chosen.shape[1]], pa.int32()),
            "f": pa.array(chosen.ravel()[pick], pa.int32()), "bin": pa.array(at % width, pa.int32()),
            **{c: pa.array(x[at].astype("int64")) for c, x in zip(("rows", "weight", "ones"), found)}})

    parts = base.mapInArrow(counted, "tree int, node int, f int, bin int, rows long, weight long, ones long")
    names = F.array(*[F.lit(f) for f in features])
    return parts.groupBy("tree", "node", "f", "bin").agg(*[F.sum(c).alias(c) for c in ("rows", "weight", "ones")]) \
        .select("tree", "node", F.get(names, F.col("f")).alias("feature"), "bin", "rows", "weight", "ones")
