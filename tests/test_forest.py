"""Level-wise forests against a recursive one in plain Python; compiled scoring against the models themselves."""
import hashlib
import math
import random

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from renewcast.operators import forest as G
from renewcast.operators import models as ML
from renewcast.operators.compiled import Tree, with_forest_probability, with_probability
from renewcast.session import scratch_path

FEATURES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    out = []
    for i in range(700):
        a, b, c = rng.randrange(40) / 4, rng.gauss(0, 1), float(rng.randrange(2))
        y = int(rng.random() < 1 / (1 + math.exp(-(a - 5 + 2 * c * b))))
        out.append((f"u{i % 640}", a, None if i % 50 == 0 else b, c, 1.0, y))
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "msno string, a double, b double, c double, d double, churn int").repartition(6)


def weight(key, seed, tree):
    digits = hashlib.md5(f"{key}|{seed}|{tree}".encode()).hexdigest()[:8]
    return sum(digits >= p for p in G.POISSON)


def gini_or_entropy(ones, w, rule):
    p = ones / w
    if rule == "gini":
        return 1 - p * p - (1 - p) * (1 - p)
    return -sum(q * math.log2(q) for q in (p, 1 - p) if q > 0)


def plain_tree(rows, cuts, tree, p):
    """place -> (rows, weight, ones, feature, cut), grown by recursion."""
    value = lambda r, f: math.inf if r[1 + FEATURES.index(f)] is None else r[1 + FEATURES.index(f)]
    out = {}

    def grow(part, place, depth):
        w = sum(x for _, x in part)
        ones = sum(x * r[5] for r, x in part)
        best = None
        if depth < p["max_depth"] and len(part) >= p["min_split"] and 0 < ones < w:
            for f in G.node_features(FEATURES, p["feature_subset"], p["seed"], tree, place):
                for k, cut in enumerate(cuts[f]):
                    left = [(r, x) for r, x in part if value(r, f) <= cut]
                    if not p["min_leaf"] <= len(left) <= len(part) - p["min_leaf"]:
                        continue
                    lw, lo = sum(x for _, x in left), sum(x * r[5] for r, x in left)
                    gain = round(gini_or_entropy(ones, w, p["rule"]) - lw / w * gini_or_entropy(lo, lw, p["rule"])
                                 - (w - lw) / w * gini_or_entropy(ones - lo, w - lw, p["rule"]), 10)
                    if gain > 0 and (best is None or (-gain, f, k) < best[:3]):
                        best = (-gain, f, k, cut)
        out[place] = (len(part), w, ones, best and best[1], best and best[3])
        if best:
            grow([x for x in part if value(x[0], best[1]) <= best[3]], 2 * place, depth + 1)
            grow([x for x in part if value(x[0], best[1]) > best[3]], 2 * place + 1, depth + 1)

    bag = [(r, weight(r[0], p["seed"], tree)) for r in rows]
    grow([x for x in bag if x[1]], 1, 0)
    return out


@pytest.mark.parametrize("params", [
    {"num_trees": 3, "max_depth": 4, "min_split": 30, "min_leaf": 4, "feature_subset": "sqrt", "rule": "gini", "seed": 1},
    {"num_trees": 2, "max_depth": 3, "min_split": 2, "min_leaf": 1, "feature_subset": "all", "rule": "entropy", "seed": 5}])
def test_same_trees_as_a_recursive_grower(table, rows, params):
    cuts = G.candidate_cuts(table, FEATURES, 12)
    found = G.grow_forest(table, FEATURES, cuts=cuts, **params)
    for t, nodes in enumerate(found.nodes):
        assert {p: (n.rows, n.weight, n.ones, n.feature, n.cut) for p, n in nodes.items()} == plain_tree(rows, cuts, t, params)
    again = G.grow_forest(table.coalesce(1), FEATURES, cuts=cuts, **params)
    assert again.nodes == found.nodes


def test_min_split_is_kept_where_a_leaf_minimum_is_stricter(spark):
    """A node of 20 rows parts into 1 and 19, which no leaf minimum for a split minimum of 20 would allow; one of 19 rows is not split."""
    def grown(n):
        df = spark.createDataFrame([(str(i), float(i), int(i == 0)) for i in range(n)], "msno string, x double, churn int")
        return G.grow_forest(df, ["x"], num_trees=1, max_depth=3, min_split=20, bagged=False, cuts={"x": [float(i) for i in range(n)]}).nodes[0]
    assert {p: n.rows for p, n in grown(20).items()} == {1: 20, 2: 1, 3: 19}
    assert {p: n.rows for p, n in grown(19).items()} == {1: 19}


def test_odd_tables(spark, table):
    empty = G.grow_forest(table.limit(0), FEATURES, num_trees=2, max_depth=3)
    assert [list(t) for t in empty.nodes] == [[1], [1]]
    assert with_forest_probability(table.limit(3), FEATURES, empty.trees, "p").select("p").distinct().collect() == [(0.0,)]
    one = G.grow_forest(table.withColumn("churn", F.lit(1)), FEATURES, num_trees=1, max_depth=3)
    assert list(one.nodes[0]) == [1]
    unlabelled = table.withColumn("churn", F.when(F.col("c") == 1, F.col("churn")))
    some = G.grow_forest(unlabelled, FEATURES, num_trees=1, max_depth=1, bagged=False)
    assert some.nodes[0][1].rows == unlabelled.where("churn IS NOT NULL").count()


def test_bags_have_poisson_weights(spark):
    df = spark.range(20_000).select(F.col("id").cast("string").alias("k"), G.bag_weight(["id"], 3, 0).alias("w"))
    got = {r["w"]: r["count"] for r in df.groupBy("w").count().collect()}
    for k in range(5):
        assert got[k] / 20_000 == pytest.approx(math.exp(-1) / math.factorial(k), abs=0.012)


def test_saved_forest_scores_alike(spark, table):
    forest = G.grow_forest(table, FEATURES, num_trees=25, max_depth=4, min_split=20)
    path = scratch_path(spark, "grown_bundle")
    ML.save_bundle(spark, ML.Bundle(forest, 0.4, {"a": (1.0, 2.0)}, {}, ["a"], {"model_type": "grown_forest"}), path)
    back = ML.load_bundle(spark, path)
    assert back.threshold == 0.4 and back.model.nodes == forest.nodes and back.model.params["min_split"] == 20
    got = {tuple(r)[:-1]: r["p_churn"] for r in ML.churn_probability(back.model, table).collect()}
    trees = forest.trees

    def plain(r):
        total = 0.0
        for t in trees:
            n = 0
            while t.left[n] != n:
                v = r[1 + t.feature[n]]
                n = t.left[n] if v is not None and v <= t.cut[n] else t.right[n]
            total += t.value[n]
        return total / len(trees)

    assert len(got) == 700 and all(p == pytest.approx(plain(k), abs=1e-12) for k, p in got.items())


@pytest.mark.parametrize("estimator", [
    lambda: ML.logistic(700, 1.0, "l2"), lambda: ML.logistic(700, 0.02, "l1"), lambda: ML.forest(30, 5, min_split=4), lambda: ML.forest(3, 8, "0.6")])
def test_compiled_models_equal_transform(spark, table, estimator):
    full = table.fillna(0.25)
    model = ML.vector_model(FEATURES, estimator()).fit(full)
    df = with_probability(model.transform(full), model, "mine")
    off = ML.positive_probability(df).agg(F.max(F.abs(F.col("mine") - F.col("p_churn"))), F.count("mine")).first()
    assert off[0] < 1e-9 and off[1] == 700
    plan = with_probability(full, model, "mine")._jdf.queryExecution().executedPlan().toString()
    assert "UDF" not in plan and "Python" not in plan


def test_a_filter_on_the_probability_stays_linear_in_the_nodes(spark, table):
    """Pushed through the scoring, a condition repeats each split once, not once for each level below it."""
    model = ML.vector_model(FEATURES, ML.forest(20, 8)).fit(table.fillna(0.0))
    scored = with_probability(table.fillna(0.0), model, "p").where("p IS NOT NULL AND p > 0.2")
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    splits = sum(l != n for t in with_trees(model) for n, l in enumerate(t.left))
    assert splits > 100 and plan.count("CASE WHEN") <= 4 * splits and scored.count() > 100


def with_trees(model):
    from renewcast.operators.compiled import spark_trees
    return spark_trees(model.stages[-1])


def test_a_null_feature_counts_as_nan(spark, table):
    model = ML.vector_model(FEATURES, ML.logistic(700)).fit(table.fillna(0.0))
    got = with_probability(table, model, "p").where("b IS NULL").select(F.isnan("p").alias("n")).distinct().collect()
    assert [r["n"] for r in got] == [True]


def test_single_leaf_and_deep_trees(spark):
    stump = Tree([0], [0.0], [0], [0], [0.7])
    chain = Tree([0] * 41, [float(-k) for k in range(41)], [2 * k + 1 if k < 20 else k for k in range(41)],
                 [2 * k + 2 if k < 20 else k for k in range(41)], [k / 41 for k in range(41)])
    df = spark.createDataFrame([(1.0,), (-3.5,), (None,)], "x double")
    assert {r["p"] for r in with_forest_probability(df, ["x"], [stump], "p").collect()} == {0.7}
    assert with_forest_probability(df, ["x"], [stump, chain], "p").count() == 3


# ------------------------------------------------------------------ certificate, intercept, sampler

def test_certificate_tells_an_optimum_from_another_point(spark, table):
    full = table.fillna(0.0)
    model = ML.vector_model(FEATURES, ML.logistic(700, 0.5, "l2", tol=1e-12)).fit(full)
    names, w, b = ML.coefficients(model)
    at = ML.optimality(full, names, w, b, 0.5, "l2")
    assert at.agg(F.max("violation")).first()[0] < 1e-3 and at.count() == 5
    off = {r["name"]: r["violation"] for r in ML.optimality(full, names, [w[0] + 0.1, *w[1:]], b, 0.5, "l2").collect()}
    assert off["a"] > 1
    sparse = ML.vector_model(FEATURES, ML.logistic(700, 0.01, "l1", tol=1e-12)).fit(full)
    names, w, b = ML.coefficients(sparse)
    assert 0 in w and ML.optimality(full, names, w, b, 0.01, "l1").agg(F.max("violation")).first()[0] < 1e-2
    # a gradient by finite differences
    y = [r["churn"] for r in full.collect()]
    xs = [[r[n] for n in FEATURES] for r in full.collect()]
    loss = lambda v: 0.01 * sum(math.log1p(math.exp(-(2 * t - 1) * (sum(p * q for p, q in zip(v, x)) + b))) for x, t in zip(xs, y))
    got = {r["name"]: r["gradient"] for r in ML.optimality(full, names, w, b, 0.01, "l1").collect()}
    for k, n in enumerate(FEATURES):
        up, down = [v + 1e-5 * (i == k) for i, v in enumerate(w)], [v - 1e-5 * (i == k) for i, v in enumerate(w)]
        assert got[n] == pytest.approx((loss(up) - loss(down)) / 2e-5, abs=1e-4)


def test_penalised_intercept_is_smaller_and_certified(spark, table):
    full = table.fillna(0.0).drop("d")
    names = ["a", "b", "c"]
    free = ML.coefficients(ML.vector_model(names, ML.logistic(700, 0.01, tol=1e-12)).fit(full))
    rows, more = ML.with_penalised_intercept(full, names, ["msno"])
    held = ML.vector_model(more, ML.logistic(700, 0.01, tol=1e-12, penalise_intercept=True)).fit(rows)
    own = ML.coefficients(held)
    assert own[0] == names and abs(own[2]) < abs(free[2])
    assert ML.optimality(full, *own, 0.01, penalise_intercept=True).agg(F.max("violation")).first()[0] < 1e-3
    assert ML.optimality(full, *free, 0.01).agg(F.max("violation")).first()[0] < 1e-3
    assert ML.churn_probability(held, full).where("p_churn IS NULL").isEmpty()


def curve(d):
    """Best at C = 4 with l2."""
    return -abs(math.log(d["C"] / 4)) - (d["penalty"] == "l1") - abs(d["depth"] - 7) / 8


SPACE = {"C": ("log", 0.01, 1000.0), "penalty": ("choice", ("l1", "l2")), "depth": ("int", 2, 30)}


def run(sampler, n):
    trials, scores = [], []
    for _ in range(n):
        trials.append(sampler.next(trials, scores))
        scores.append(curve(trials[-1]))
    return trials, scores


def test_same_seed_same_trials_within_range():
    a, b = run(ML.ParzenSampler(SPACE, 7), 20), run(ML.ParzenSampler(SPACE, 7), 20)
    assert a == b and a != run(ML.ParzenSampler(SPACE, 8), 20)
    assert all(0.01 <= t["C"] <= 1000 and t["penalty"] in ("l1", "l2") and t["depth"] in range(2, 31) for t in a[0])
    assert run(ML.ParzenSampler(SPACE, 7, startup=0), 2)[0]


def test_adaptive_draws_beat_as_many_random_ones():
    adaptive = [max(run(ML.ParzenSampler(SPACE, s), 25)[1]) for s in range(40)]
    chance = [max(run(ML.ParzenSampler(SPACE, s, startup=25), 25)[1]) for s in range(40)]
    assert sum(adaptive) / 40 > sum(chance) / 40 + 0.1
    assert sum(a > c for a, c in zip(adaptive, chance)) >= 24


def test_later_draws_follow_the_scores():
    trials = [{"C": c, "penalty": "l2", "depth": 5} for c in (0.02, 0.05, 3.0, 400.0, 900.0)]
    sampler = ML.ParzenSampler(SPACE, 3, startup=3)
    low, high = (sampler.next(trials, scores)["C"] for scores in ([5, 4, 3, 2, 1], [1, 2, 3, 4, 5]))
    assert low < 3 < high


def test_tuning_is_repeatable_and_its_scores_are_fold_means(spark, table):
    full = table.fillna(0.0).withColumn("fold", F.pmod(F.xxhash64("msno"), F.lit(3)).cast("int"))
    full = full.coalesce(1)
    model, draws, scores = ML.tune_model(full, FEATURES, "logistic", trials=3, seed=5, startup=2)
    _, draws2, scores2 = ML.tune_model(full.repartition(3), FEATURES, "logistic", trials=2, seed=5, startup=2)
    assert draws[:2] == draws2 and scores[:2] == pytest.approx(scores2, abs=1e-6)
    sampler = ML.ParzenSampler(ML.LOGISTIC_SPACE, 5, 2)
    assert draws[2] == sampler.next(draws[:2], scores[:2])
    x = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(full)
    from renewcast.operators import metrics as M
    for d, s in zip(draws[2:], scores[2:]):
        per_fold = []
        for f in range(3):
            rest = x.where(F.col("fold") != f)
            fitted = ML.logistic(rest.count(), d["C"], d["penalty"]).fit(rest)
            own = ML.positive_probability(fitted.transform(x.where(F.col("fold") == f))).select(F.col("churn").alias("y_true"), F.col("p_churn").alias("score"))
            per_fold.append(M.roc_auc(own).first()["auc"])
        assert s == pytest.approx(sum(per_fold) / 3, abs=1e-6)


def test_forests_are_tuned_over_their_own_space(spark, table, monkeypatch):
    small = {**ML.FOREST_SPACE, "num_trees": ("int", 2, 5), "max_depth": ("int", 2, 3)}
    monkeypatch.setattr(ML, "FOREST_SPACE", small)
    full = table.fillna(0.0).withColumn("fold", F.pmod(F.xxhash64("msno"), F.lit(2)).cast("int")).coalesce(1)
    model, draws, scores = ML.tune_model(full, FEATURES, "forest", trials=3, seed=9)
    assert len(draws) == 3 and all(set(d) == set(small) and 2 <= d["num_trees"] <= 5 for d in draws) and all(0.5 < s <= 1 for s in scores)
    assert model.getNumTrees == draws[scores.index(max(scores))]["num_trees"]


def test_cv_report_equals_plain_fold_runs(spark, table):
    full = table.fillna(0.0).withColumn("fold", F.pmod(F.xxhash64("msno"), F.lit(3)).cast("int"))
    d = {"C": 1.0, "penalty": "l2"}
    got = {r["part"]: r for r in ML.cv_report(full, FEATURES, lambda d, n: ML.logistic(n, d["C"], d["penalty"]), [d], k=3).collect()}
    want = {"train": [], "validation": []}
    for f in range(3):
        own = full.where(F.col("fold") != f)
        model = ML.vector_model(FEATURES, ML.logistic(own.count(), 1.0, "l2")).fit(own)
        for part, rows_ in (("train", full.where(F.col("fold") != f)), ("validation", full.where(F.col("fold") == f))):
            s = [(r["churn"], r["p_churn"]) for r in ML.positive_probability(model.transform(rows_)).collect()]
            pos, neg = [p for y, p in s if y == 1], [p for y, p in s if y == 0]
            auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
            tp, fn = sum(p >= 0.5 for p in pos), sum(p < 0.5 for p in pos)
            fp, tn = sum(p >= 0.5 for p in neg), sum(p < 0.5 for p in neg)
            want[part].append((auc, 3.25 * tp / (3.25 * tp + 2.25 * fn + fp), fn / (tn + fn)))
    for part, values in want.items():
        mean = [sum(v) / 3 for v in zip(*values)]
        assert [got[part][c] for c in ("auc", "f1_5", "fn_rate")] == pytest.approx(mean, abs=1e-9)
