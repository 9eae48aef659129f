"""Random forests grown from binned rows, for searches that fit many large ones.

The rules are those of ``operators.forest``: bags with Poisson weights, nodes that choose among a subset of the features, a true minimum of rows
to split a node, the first feature by name and the smallest cut of equal gains.  What differs is how rows and counts travel:

* A row is its bins, a byte for each feature, cut once for a whole search; its weight in a tree's bag is a hash of its key and the tree.
* Each task counts the classes by (node, feature, bin), a tree at a time over some thousand rows, so that a tree's counts stay in the
  processor's cache.  They are handed on as one block of small numbers for each tree, not as a row for each cell.
* The blocks of a tree meet in one task, which sums them and finds the best split of every node; the splits come to the driver.
* Trees of a level are taken in groups of at most ``MAX_CELLS`` cells, which bounds a task's memory.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from renewcast.operators.compiled import number
from renewcast.operators.forest import BINS, GrownForest, Node, subset_size

#: Cells of a level's counts that a task holds at once, two numbers of 8 bytes each.
MAX_CELLS = 6_000_000
#: Rows that are counted or scored together.
CHUNK = 32_768
#: Quantiles that candidate cuts are chosen from, and the accuracy of their ranks.
GRID, ACCURACY = 128, 10_000
#: A cell's sum holds its rows below this and its weight above; both are exact in a double up to as many rows.
ROWS = 1 << 26
#: Upper bounds of 32 bits of a hash for a weight of 0, 1, ...: Poisson with mean 1.
POISSON = [int(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) * 2 ** 32) for k in range(9)]


def spread_cuts(rows: DataFrame, features: Sequence[str], bins: int = BINS) -> dict[str, list[float]]:
    """Cut values per feature, fewer than ``bins``: all of the distinct 1/GRID quantiles, or as many of them evenly by rank.  A value that many rows share
    takes one cut, not those of all its quantiles.  One aggregate, one row."""
    at = [i / GRID for i in range(GRID + 1)]
    found = rows.agg(*[F.percentile_approx(F.nanvl(number(c), F.lit(None).cast("double")), at, ACCURACY).alias(c) for c in features]).first()
    out = {}
    for c in features:
        values = sorted({v for v in found[c] or [] if math.isfinite(v)})
        pick = np.unique(np.linspace(0, len(values) - 1, min(len(values), bins - 1)).round().astype(int)) if values else []
        out[c] = [values[i] for i in pick]
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """64 bits in, 64 well mixed bits out."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def salt(*numbers: int) -> np.uint64:
    """One number of several, the same in every process."""
    x = np.zeros(1, np.uint64)
    for n in numbers:
        x = mixed((x + np.uint64(n & (2 ** 64 - 1))) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    return x[0]


def bag(ids: np.ndarray, seed: int, tree: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a tree's bag and their weights."""
    digits = mixed(ids ^ salt(seed, tree)) >> np.uint64(32)
    rows = np.flatnonzero(digits >= POISSON[0])
    digits = digits[rows]
    weight = np.ones(len(rows), np.uint8)
    for p in POISSON[1:]:
        weight += digits >= p
    return rows, weight


def layout(seed: int, tree: int, places: np.ndarray, widths: np.ndarray, choose: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(chosen, start, cells) of a tree's open nodes: the features each may split on, ascending, the first cell of each, all cells."""
    ranks = mixed(mixed(places.astype(np.uint64)[:, None] + salt(seed, tree, 1)) + np.arange(len(widths), dtype=np.uint64))
    chosen = np.sort(np.argsort(ranks, axis=1, kind="stable")[:, :choose], axis=1)
    upto = np.cumsum(widths[chosen].ravel())
    return chosen, (upto - widths[chosen].ravel()).reshape(chosen.shape), int(upto[-1]) if len(upto) else 0


def bytes_column(rows: np.ndarray) -> pa.Array:
    """A binary value for each row of a table of bytes."""
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def bytes_table(column: pa.Array, width: int) -> np.ndarray:
    column = column.cast(pa.binary())
    if not len(column):
        return np.zeros((0, width), np.uint8)
    first = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    return np.frombuffer(column.buffers()[2], np.uint8)[first:first + len(column) * width].reshape(-1, width)


def bin_rows(df: DataFrame, features: Sequence[str], cuts: Mapping[str, Sequence[float]], key: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """(keep.., row_id, bins): how many cuts are below the value of each feature, a byte each; nulls and NaN are above every cut."""
    edges = [np.array(cuts[f], float) for f in features]
    if any(len(e) > 255 for e in edges):
        raise ValueError("more than 255 cuts")
    out = df.select(*keep, F.xxhash64(*key).alias("row_id"))

    def binned(batches):
        for batch in batches:
            values = batch.column(batch.num_columns - 1)
            values = values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)
            found = np.empty(values.shape, np.uint8)
            for j, e in enumerate(edges):
                found[:, j] = np.searchsorted(e, values[:, j], "left")
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], bytes_column(found)], [*batch.schema.names[:-1], "bins"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema]
    return df.select(*keep, F.xxhash64(*key).alias("row_id"), F.array(*[number(f) for f in features]).alias("_values")) \
        .mapInArrow(binned, ", ".join([*kinds, "bins binary"]))


def walked(at: np.ndarray, flat: np.ndarray, base: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """``at``, the place of each row, moved ``levels`` down in place; below a leaf it is any place of the leaf's."""
    for _ in range(levels):
        value = feature.take(at)
        value += base
        right = flat.take(value) > cut.take(at)
        at += at
        at += right
    return at


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``CHUNK``."""
    held, n = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            held.append(batch.slice(at, CHUNK))
            n += held[-1].num_rows
            if n >= CHUNK:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


@dataclass
class BinnedForest:
    """Trees by place (root 1, children 2n and 2n + 1): feature (-1 for leaves), number of the cut, gain, rows, weight and weight of class 1."""
    features: list[str]
    cuts: dict[str, list[float]]
    params: dict
    feature: np.ndarray
    cut: np.ndarray
    gain: np.ndarray
    sums: np.ndarray                                # (3, trees, places)

    def transform(self, df: DataFrame, label: str = "churn") -> DataFrame:
        """(label, rawPrediction) of binned rows: the mean over trees of the share of class 1 in the leaf reached."""
        width, depth = len(self.features), self.params["max_depth"]
        feature, cut, value = by_place(self.feature, self.cut, self.sums)

        def scored(batches):
            for batch in chunks(batches):
                bins = bytes_table(batch.column(1), width)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(mean_value(bins, feature, cut, value, depth))], [label, "rawPrediction"])

        return df.select(F.col(label).cast("double").alias(label), "bins").mapInArrow(scored, f"`{label}` double, rawPrediction double")

    def grown(self) -> GrownForest:
        """The same forest with its nodes as objects, its cuts as values."""
        out = []
        for t in range(len(self.feature)):
            nodes = {}
            for p in np.flatnonzero((self.sums[0, t] > 0) | (np.arange(self.feature.shape[1]) == 1)).tolist():
                rows, weight, ones = self.sums[:, t, p].tolist()
                f = int(self.feature[t, p])
                nodes[p] = Node(p, rows, weight, ones) if f < 0 else Node(
                    p, rows, weight, ones, self.features[f], self.cuts[self.features[f]][self.cut[t, p]], float(self.gain[t, p]))
            out.append(nodes)
        return GrownForest(list(self.features), out, dict(self.params))


def by_place(feature: np.ndarray, cut: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, cut, value) to walk down: leaves hand their value on to all places below them, so every walk goes to the last level."""
    value = np.where(sums[1] > 0, sums[2] / np.maximum(sums[1], 1), 0.0)
    places = np.arange(feature.shape[1] // 2)
    for low in (1 << k for k in range(feature.shape[1].bit_length() - 2)):
        at = places[low:2 * low]
        leaf = feature[:, at] < 0
        for child in (2 * at, 2 * at + 1):
            value[:, child] = np.where(leaf, value[:, at], value[:, child])
    return np.maximum(feature, 0).astype(np.intp), cut, value


def mean_value(rows: np.ndarray, feature: np.ndarray, cut: np.ndarray, value: np.ndarray, depth: int) -> np.ndarray:
    flat, base, total = rows.ravel(), np.arange(len(rows)) * rows.shape[1], np.zeros(len(rows))
    for f, c, v in zip(feature, cut, value):
        total += v.take(walked(np.ones(len(rows), np.intp), flat, base, f, c, depth))
    return total / len(feature)


def grow_binned(rows: DataFrame, features: Sequence[str], cuts: Mapping[str, Sequence[float]], label: str = "churn", num_trees: int = 50, max_depth: int = 5,
                min_split: int = 2, min_leaf: int = 1, feature_subset: str = "sqrt", rule: str = "gini", seed: int = 42) -> BinnedForest:
    """Grows a forest from rows of ``bin_rows``, whose features are in the order of their names; rows without a label are left out."""
    if list(features) != sorted(features):
        raise ValueError("features by name")
    rows = rows.where(F.col(label).isNotNull()).select(F.col(label).cast("int").cast("tinyint").alias("y"), "row_id", "bins")
    widths = np.array([len(cuts[f]) + 1 for f in features])
    choose = subset_size(feature_subset, len(features))
    shape = (num_trees, 2 << max_depth)
    feature, cut, gain, sums = np.full(shape, -1, np.int16), np.zeros(shape, np.uint8), np.zeros(shape), np.zeros((3, *shape), np.int64)
    most = int(np.sort(widths)[-choose:].sum())
    for level in range(max_depth):
        places = np.arange(1 << level, 2 << level)
        n, weight, ones = sums[:, :, places]
        open_ = (n >= max(2, min_split)) & (ones > 0) & (ones < weight) if level else np.ones((num_trees, 1), bool)
        for group in tree_groups(open_.sum(axis=1) * most):
            task = Level(seed, level, len(features), widths, choose, max(2, min_split), max(1, min_leaf), rule, group,
                         [np.flatnonzero(open_[t]) + (1 << level) for t in group], feature[group, :1 << level], cut[group, :1 << level])
            blocks = rows.mapInArrow(task.counted, "tree int, size int, counts binary")
            parts = min(len(group), rows.sparkSession.sparkContext.defaultParallelism)
            best = blocks.repartition(parts, "tree").sortWithinPartitions("tree").mapInArrow(task.best, "tree int, found binary")
            for r in best.collect():                            # a row for each tree: its open nodes' splits
                t, found = r["tree"], np.frombuffer(r["found"], FOUND)
                at = found["place"]
                sums[:, t, at] = found["all"].T
                split = found[found["feature"] >= 0]
                at = split["place"]
                feature[t, at], cut[t, at], gain[t, at] = split["feature"], split["cut"], split["gain"]
                sums[:, t, 2 * at], sums[:, t, 2 * at + 1] = split["left"].T, (split["all"] - split["left"]).T
    params = {"num_trees": num_trees, "max_depth": max_depth, "min_split": min_split, "min_leaf": min_leaf, "feature_subset": feature_subset,
              "impurity": rule, "seed": seed}
    return BinnedForest(list(features), {f: list(cuts[f]) for f in features}, params, feature, cut, gain, sums)


#: What is found of an open node: its sums (rows, weight, ones), and those left of its best split; feature -1 where there is none.
FOUND = np.dtype([("place", "i4"), ("feature", "i2"), ("cut", "u1"), ("gain", "f8"), ("all", "i8", 3), ("left", "i8", 3)])


def tree_groups(cells: np.ndarray) -> list[list[int]]:
    """Trees with open nodes, in groups of at most ``MAX_CELLS`` cells or one tree."""
    out, total = [], 0
    for t in np.flatnonzero(cells).tolist():
        if not out or total + cells[t] > MAX_CELLS:
            out.append([])
            total = 0
        out[-1].append(t)
        total += int(cells[t])
    return out


@dataclass
class Level:
    """One level of some trees: what the tasks that count, and those that choose the splits, have to know."""
    seed: int
    level: int
    features: int
    widths: np.ndarray
    choose: int
    min_split: int
    min_leaf: int
    rule: str
    trees: list[int]
    places: list[np.ndarray]                        # open nodes of each tree
    feature: np.ndarray                             # splits above this level, by place
    cut: np.ndarray

    def counted(self, batches):
        tables, kind = [], np.uint8 if self.widths.max() <= 127 else np.int16
        for i, (t, places) in enumerate(zip(self.trees, self.places)):
            chosen, _, _ = layout(self.seed, t, places, self.widths, self.choose)
            slot = np.full(2 << self.level, -1)
            slot[places] = np.arange(len(places))
            # counted a chosen feature after the other, the nodes side by side: what a count touches stays small
            upto = np.cumsum(self.widths[chosen.T], axis=1)
            start = 2 * np.hstack([np.zeros((self.choose, 1), int), upto])
            # doubled with the class added, as the bins below are
            tables.append((t, np.maximum(self.feature[i], 0).astype(np.intp), 2 * self.cut[i].astype(kind) + 1, slot,
                           np.ascontiguousarray(chosen.T), start[:, :-1].copy(), start[:, -1].tolist()))
        sums, seen = {}, 0
        for batch in chunks(batches):
            if seen + batch.num_rows > ROWS >> 4:
                yield from self.blocks(sums)
                sums, seen = {}, 0
            seen += batch.num_rows
            y, ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint8), batch.column(1).to_numpy().view(np.uint64)
            bins = bytes_table(batch.column(2), self.features)
            bins = 2 * bins.astype(kind) + y[:, None]
            flat, base = bins.ravel(), np.arange(len(y)) * self.features
            for t, feature, cut, slot, chosen, start, cells in tables:
                rows, weight = bag(ids, self.seed, t)
                first = base[rows]
                s = slot.take(walked(np.ones(len(rows), np.intp), flat, first, feature, cut, self.level))
                if s.min(initial=0) < 0:
                    kept = np.flatnonzero(s >= 0)
                    s, first, weight = s[kept], first[kept], weight[kept]
                weight = weight * float(ROWS) + 1.0
                if t not in sums:
                    sums[t] = [np.zeros(n) for n in cells]
                for found, features, low, n in zip(sums[t], chosen, start, cells):
                    at = features.take(s)
                    at += first
                    cell = low.take(s)
                    cell += flat.take(at)
                    found += np.bincount(cell, weight, n)
        yield from self.blocks(sums)

    def blocks(self, sums):
        """A tree's counts (rows, weight, ones) in the order of ``layout``: node by node."""
        for t, found in sums.items():
            chosen, start, _ = layout(self.seed, t, self.places[self.trees.index(t)], self.widths, self.choose)
            lengths = self.widths[chosen]
            own = np.cumsum(lengths.T.ravel()).reshape(lengths.T.shape).T - lengths
            at = np.repeat((own - start).ravel(), lengths.ravel()) + np.arange(lengths.sum())
            packed = np.concatenate(found).astype(np.int64).reshape(-1, 2)[at]
            rows, weight = packed & (ROWS - 1), packed >> 26
            counts = np.stack([rows.sum(axis=1), weight.sum(axis=1), weight[:, 1]])
            kind = np.min_scalar_type(int(counts.max(initial=0)))
            yield pa.RecordBatch.from_pydict({"tree": pa.array([t], pa.int32()), "size": pa.array([kind.itemsize], pa.int32()),
                                              "counts": pa.array([counts.astype(kind).tobytes()], pa.binary())})

    def best(self, batches):
        tree, total = None, None
        for batch in batches:
            for t, size, counts in zip(*(batch.column(c) for c in range(3))):
                found = np.frombuffer(counts.as_buffer(), f"u{size.as_py()}").reshape(3, -1)
                if t.as_py() == tree:
                    total += found
                    continue
                if tree is not None:
                    yield self.splits(tree, total)
                tree, total = t.as_py(), found.astype(np.int64)
        if tree is not None:
            yield self.splits(tree, total)

    def splits(self, tree: int, counts: np.ndarray) -> pa.RecordBatch:
        places = self.places[self.trees.index(tree)]
        chosen, start, _ = layout(self.seed, tree, places, self.widths, self.choose)
        segments, lengths = start.ravel(), self.widths[chosen].ravel()
        upto = np.cumsum(counts, axis=1)
        before = upto[:, segments] - counts[:, segments]
        left = upto - np.repeat(before, lengths, axis=1)
        everything = np.add.reduceat(counts, segments, axis=1)[:, ::self.choose]
        cells = self.widths[chosen].sum(axis=1)
        whole = np.repeat(everything, cells, axis=1)
        n, weight, ones = everything
        is_open = (n >= self.min_split) & (ones > 0) & (ones < weight)
        right = whole - left
        valid = (left[0] >= self.min_leaf) & (right[0] >= self.min_leaf) & np.repeat(is_open, cells)
        gain = np.full(counts.shape[1], -1.0)
        l, r, a = left[:, valid].astype(float), right[:, valid].astype(float), whole[:, valid].astype(float)
        gain[valid] = np.round(self.impurity(a) - l[1] / a[1] * self.impurity(l) - r[1] / a[1] * self.impurity(r), 10)
        top = np.maximum.reduceat(gain, start[:, 0])
        tops = np.flatnonzero(gain == np.repeat(top, cells))
        at = tops[np.searchsorted(tops, start[:, 0])]           # the first of each node: the first feature by name, then the smallest cut
        segment = np.searchsorted(segments, at, "right") - 1
        found = np.zeros(len(places), FOUND)
        found["place"], found["all"], found["left"], found["gain"] = places, everything.T, left[:, at].T, top
        found["feature"], found["cut"] = np.where(top > 0, chosen.ravel()[segment], -1), at - segments[segment]
        return pa.RecordBatch.from_pydict({"tree": pa.array([tree], pa.int32()), "found": pa.array([found.tobytes()], pa.binary())})

    def impurity(self, sums: np.ndarray) -> np.ndarray:
        p = sums[2] / sums[1]
        if self.rule == "gini":
            return 1.0 - p * p - (1.0 - p) * (1.0 - p)
        return -sum(q * np.log2(q, where=q > 0, out=np.zeros_like(q)) for q in (p, 1.0 - p))


def with_walked_probability(df: DataFrame, forest: GrownForest, name: str = "probability") -> DataFrame:
    """Adds the probability of a grown forest of any size: rows walk down its trees in Arrow batches.  NaN and null go right."""
    size = 2 << max((p.bit_length() - 1 for nodes in forest.nodes for p in nodes), default=0)
    feature, cut, sums = np.full((len(forest.nodes), size), -1, np.int16), np.zeros((len(forest.nodes), size)), np.zeros((3, len(forest.nodes), size), np.int64)
    index = {f: i for i, f in enumerate(forest.features)}
    for t, nodes in enumerate(forest.nodes):
        for p, n in nodes.items():
            sums[:, t, p] = n.rows, n.weight, n.ones
            if n.feature is not None:
                feature[t, p], cut[t, p] = index[n.feature], n.cut
    feature, cut, value = by_place(feature, cut, sums)
    depth = size.bit_length() - 2

    def score(values: pa.Array) -> pa.Array:
        rows = values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)
        rows = np.where(np.isnan(rows), np.inf, rows)
        return pa.array(np.concatenate([mean_value(rows[at:at + CHUNK], feature, cut, value, depth) for at in range(0, len(rows), CHUNK)] or [np.zeros(0)]))

    return df.withColumn(name, F.arrow_udf(score, "double")(F.array(*[number(f) for f in forest.features])))


# what runs in the tasks is sent with them: workers need not find this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
