"""Forests of a search are grown from binned rows and blocks of counts: the trees of a recursive grower, whatever the parts and groups."""
import math
import os
import random
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from renewcast.operators import binned as B
from renewcast.operators import forest as G
from renewcast.operators import models as ML
from renewcast.operators.compiled import with_forest_probability
from test_forest import gini_or_entropy

FEATURES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(8)
    out = []
    for i in range(700):
        a, b, c = rng.randrange(40) / 4, rng.gauss(0, 1), float(rng.randrange(2))
        y = int(rng.random() < 1 / (1 + math.exp(-(a - 5 + 2 * c * b))))
        out.append((f"u{i}", a, [None, math.nan][i % 100 // 50] if i % 50 == 0 else b, c, 1.0, y, i % 3))
    return spark.createDataFrame(out, "msno string, a double, b double, c double, d double, churn int, fold int").repartition(6).localCheckpoint()


def plain_tree(rows, widths, tree, p):
    """place -> (rows, weight, ones, feature, cut number, gain), grown by recursion from (row_id, label, bins)."""
    kept, weights = B.bag(np.array([r[0] for r in rows], "i8").view("u8"), p["seed"], tree)
    choose = G.subset_size(p["feature_subset"], len(widths))
    out = {}

    def grow(part, place, depth):
        w, ones = sum(x for _, x in part), sum(x * r[1] for r, x in part)
        best = None
        if depth < p["max_depth"] and len(part) >= max(2, p["min_split"]) and 0 < ones < w:
            for f in B.layout(p["seed"], tree, np.array([place]), np.array(widths), choose)[0][0].tolist():
                for k in range(widths[f]):
                    left = [(r, x) for r, x in part if r[2][f] <= k]
                    if not p["min_leaf"] <= len(left) <= len(part) - p["min_leaf"]:
                        continue
                    lw, lo = sum(x for _, x in left), sum(x * r[1] for r, x in left)
                    gain = round(gini_or_entropy(ones, w, p["rule"]) - lw / w * gini_or_entropy(lo, lw, p["rule"])
                                 - (w - lw) / w * gini_or_entropy(ones - lo, w - lw, p["rule"]), 10)
                    if gain > 0 and (best is None or (-gain, f, k) < best):
                        best = (-gain, f, k)
        out[place] = (len(part), w, ones, *((best[1], best[2], -best[0]) if best else (-1, 0, 0.0)))
        if best:
            grow([x for x in part if x[0][2][best[1]] <= best[2]], 2 * place, depth + 1)
            grow([x for x in part if x[0][2][best[1]] > best[2]], 2 * place + 1, depth + 1)

    grow([(rows[i], int(x)) for i, x in zip(kept, weights)], 1, 0)
    return out


@pytest.mark.parametrize("params", [
    {"num_trees": 3, "max_depth": 4, "min_split": 30, "min_leaf": 4, "feature_subset": "sqrt", "rule": "gini", "seed": 1},
    {"num_trees": 2, "max_depth": 3, "min_split": 2, "min_leaf": 1, "feature_subset": "all", "rule": "entropy", "seed": 5}])
def test_same_trees_as_a_recursive_grower(table, monkeypatch, params):
    cuts = B.spread_cuts(table, FEATURES, 12)
    assert [len(cuts[f]) for f in FEATURES] == [11, 11, 2, 1]
    x = B.bin_rows(table, FEATURES, cuts, ["msno"], ["churn"])
    rows = [(r["row_id"], r["churn"], list(r["bins"])) for r in x.collect()]
    raw = {tuple(r)[1:5] for r in table.collect()}
    below = lambda v, f: len(cuts[f]) if v is None or math.isnan(v) else sum(c < v for c in cuts[f])
    assert {tuple(b) for *_, b in rows} == {tuple(below(v, f) for v, f in zip(r, FEATURES)) for r in raw}
    found = B.grow_binned(x, FEATURES, cuts, **params)
    for t in range(params["num_trees"]):
        want = plain_tree(rows, [len(cuts[f]) + 1 for f in FEATURES], t, params)
        at = np.flatnonzero(found.sums[0, t]).tolist()
        got = {p: (*found.sums[:, t, p].tolist(), int(found.feature[t, p]), int(found.cut[t, p]), float(found.gain[t, p])) for p in at}
        assert got.keys() == want.keys() and len(at) > 3
        assert all(got[p][:5] == want[p][:5] and got[p][5] == pytest.approx(want[p][5], abs=1e-9) for p in at)
    # other parts, a tree at a time, a few rows at a time, sums handed on early
    monkeypatch.setattr(B, "MAX_CELLS", 1)
    monkeypatch.setattr(B, "CHUNK", 64)
    again = B.grow_binned(x.coalesce(1), FEATURES, cuts, **params)
    for a, b in ((found.sums, again.sums), (found.feature, again.feature), (found.cut, again.cut), (found.gain, again.gain)):
        assert (a == b).all()


def test_walked_scores_equal_the_compiled_ones(table):
    cuts = B.spread_cuts(table, FEATURES)
    x = B.bin_rows(table, FEATURES, cuts, ["msno"], ["churn", "msno"])
    model = B.grow_binned(x, FEATURES, cuts, num_trees=8, max_depth=5)
    grown = model.grown()
    assert grown.getNumTrees == 8 and any(n.feature is None and n.place < 16 for n in grown.nodes[0].values())
    both = with_forest_probability(B.with_walked_probability(table, grown, "walked"), FEATURES, grown.trees, "compiled")
    got = both.select("churn", "walked", "compiled").collect()
    assert len(got) == 700 and all(r["walked"] == pytest.approx(r["compiled"], abs=1e-12) for r in got)
    binned = sorted((r["churn"], round(r["rawPrediction"], 9)) for r in model.transform(x).collect())
    assert binned == sorted((r["churn"], round(r["walked"], 9)) for r in got)
    assert with_forest_probability(table.limit(0), FEATURES, grown.trees, "p").isEmpty() and B.with_walked_probability(table.limit(0), grown, "p").isEmpty()


def test_large_grown_forests_score_without_conditions(table, monkeypatch):
    grown = G.grow_forest(table, FEATURES, num_trees=3, max_depth=3)
    want = sorted(map(tuple, ML.churn_probability(grown, table).select("msno", "p_churn").collect()))
    monkeypatch.setattr(ML, "COMPILED_NODES", 5)
    scored = ML.churn_probability(grown, table)
    assert "CASE WHEN" not in scored._jdf.queryExecution().optimizedPlan().toString()
    got = sorted(map(tuple, scored.select("msno", "p_churn").collect()))
    assert [k for k, _ in got] == [k for k, _ in want] and [p for _, p in got] == pytest.approx([p for _, p in want], abs=1e-12)


def test_odd_tables(spark, table):
    cuts = B.spread_cuts(table, FEATURES)
    x = B.bin_rows(table, FEATURES, cuts, ["msno"], ["churn"])
    empty = B.grow_binned(x.limit(0), FEATURES, cuts, num_trees=2, max_depth=3).grown()
    assert [list(t) for t in empty.nodes] == [[1], [1]]
    one = B.grow_binned(x.withColumn("churn", F.lit(1)), FEATURES, cuts, num_trees=1, max_depth=3).grown()
    assert list(one.nodes[0]) == [1]
    unlabelled = B.grow_binned(x.withColumn("churn", F.when(F.col("row_id") % 2 == 0, F.col("churn"))), FEATURES, cuts, num_trees=1, max_depth=2)
    even = B.grow_binned(x.where("row_id % 2 = 0"), FEATURES, cuts, num_trees=1, max_depth=2)
    assert (unlabelled.sums == even.sums).all() and even.sums[0, 0, 1] > 100
    nulls = spark.range(10).select(F.lit(None).cast("double").alias("x"), F.col("id").cast("string").alias("msno"))
    assert B.spread_cuts(nulls, ["x"]) == {"x": []}
    # three quarters of one value: the other values keep their cuts
    tied = spark.range(4000).select(F.when(F.col("id") % 4 > 0, F.lit(0.0)).otherwise(F.col("id").cast("double")).alias("x"))
    assert len(B.spread_cuts(tied, ["x"])["x"]) == 31


def test_bags_have_poisson_weights():
    ids = B.mixed(np.arange(200_000, dtype=np.uint64))
    seen = []
    for tree in (0, 1):
        rows, weight = B.bag(ids, 3, tree)
        seen.append(np.zeros(len(ids)))
        seen[-1][rows] = weight
        for k in range(5):
            assert (seen[-1] == k).mean() == pytest.approx(math.exp(-1) / math.factorial(k), abs=0.005)
    assert abs(np.corrcoef(*seen)[0, 1]) < 0.01


def test_a_level_hands_on_a_block_for_each_tree():
    """Of 1,000 rows, 40 trees and 3 features a task hands on 40 rows, not one for each of the cells."""
    task = B.Level(7, 0, 3, np.array([4, 4, 4]), 2, 2, 1, "gini", list(range(40)), [np.array([1])] * 40, np.full((40, 1), -1, np.int16), np.zeros((40, 1), np.uint8))
    rng = np.random.default_rng(1)
    batch = pa.RecordBatch.from_arrays([pa.array(rng.integers(0, 2, 1000), pa.int8()), pa.array(rng.integers(0, 2 ** 62, 1000)),
                                        B.bytes_column(rng.integers(0, 4, (1000, 3)).astype(np.uint8))], ["y", "row_id", "bins"])
    out = list(task.counted(iter([batch.slice(0, 300), batch.slice(300)])))
    assert [b.column(0).to_pylist() for b in out] == [[t] for t in range(40)]
    whole = list(task.counted(iter([batch])))
    assert [b.column(2) for b in out] == [b.column(2) for b in whole] and all(len(b.column(2)[0].as_py()) == 3 * 8 * b.column(1)[0].as_py() for b in out)


def test_workers_need_not_find_the_package(tmp_path):
    path = tmp_path / "mixed.pickle"
    path.write_bytes(cloudpickle.dumps(B.Level.counted))
    code = f"from pyspark import cloudpickle; cloudpickle.loads(open({str(path)!r}, 'rb').read()); import sys; print(any('renewcast' in m for m in sys.modules))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert got.stdout.strip() == "False", got.stderr


def test_tuned_forests_keep_min_split_and_do_not_depend_on_the_parts(table, monkeypatch):
    monkeypatch.setattr(ML, "FOREST_SPACE", {**ML.FOREST_SPACE, "num_trees": ("int", 3, 6), "max_depth": ("int", 3, 4), "min_leaf": ("int", 1, 2)})
    model, draws, scores = ML.tune_model(table, FEATURES, "forest", trials=3, seed=9)
    best = draws[max(range(3), key=lambda i: (scores[i], -i))]
    nodes = [n for tree in model.nodes for n in tree.values()]
    split = [n for n in nodes if n.feature is not None]
    # Spark's estimator would have asked for half of ``min_split`` rows in every child
    assert min(n.rows for n in split) >= best["min_split"] and min(n.rows for n in nodes) < -(-best["min_split"] // 2)
    model2, draws2, scores2 = ML.tune_model(table.repartition(3), FEATURES, "forest", trials=3, seed=9)
    assert draws2 == draws and scores2 == pytest.approx(scores, abs=1e-9) and model2.nodes == model.nodes
    # scores are the mean over the folds of the AUC of a forest that did not see the fold
    cuts = B.spread_cuts(table, FEATURES)
    x = B.bin_rows(table, FEATURES, cuts, ["msno"], ["churn", "fold"])
    areas = []
    for f in range(3):
        fitted = ML.BinnedForestFit(FEATURES, cuts, draws[0], 9).fit(x.where(F.col("fold") != f))
        s = [(r["churn"], r["rawPrediction"]) for r in fitted.transform(x.where(F.col("fold") == f)).collect()]
        pos, neg = [p for y, p in s if y == 1], [p for y, p in s if y == 0]
        areas.append(sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg)))
    assert scores[0] == pytest.approx(sum(areas) / 3, abs=1e-9)
