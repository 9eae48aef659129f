"""What round 3 found at size: steps that ran twice, and rows wider than the exchange needs."""

import pytest

from sf_paths import SF_SMALL
from renewcast import registry
from renewcast.operators import forest as G
from renewcast.operators import metrics as M
from renewcast.operators import models as ML

registry.load_all()
QUERIES = registry.QUERIES


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString().splitlines()


@pytest.mark.parametrize("name", ["usage_features", "usage_features__dedupe_periods", "period_usage", "feature_store__dedupe_periods"])
def test_raw_logs_and_bare_periods_meet_by_quarter(spark, name):
    lines = _optimized(QUERIES[name](spark, SF_SMALL))
    at = next(i for i, x in enumerate(lines) if "Join Inner" in x and "_q#" in x)
    indent = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    end = next((i for i in range(at + 1, len(lines)) if indent[i] <= indent[at]), len(lines))
    sides = "\n".join(lines[at + 1:end])
    # the values of a log row and the attributes of a transaction are no part of what the join is dealt
    assert "d_songs" not in sides and "d_ratio_sum" not in sides and "_copies" not in sides
    assert "QUARTER" in sides


@pytest.mark.parametrize("name", ["stratified_split", "stratified_folds", "fit_scaler", "fit_vocabulary"])
def test_the_split_reads_written_rows(spark, name):
    """The split looks at its rows twice or more: the model set must not be built again for each look."""
    files = QUERIES[name](spark, SF_SMALL).inputFiles()
    assert files and all("training_rows" in f for f in files)


def _labelled(spark):
    rows = [(i, i % 3, float((i * 7) % 11) / 10, float(i % 5), int((i * 13) % 17 > 8)) for i in range(240)]
    return spark.createDataFrame(rows, "id int, fold int, a double, b double, churn int").repartition(3)


def _area(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


def test_fold_models_score_in_one_pass(spark, monkeypatch):
    """No union of a scan for each model, and no rows joined with offsets; the report equals one made by hand from the models."""
    plans, fitted = [], []
    real = ML.written

    def spied(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(df, name)

    class Kept(ML.Pipeline):
        def fit(self, *args, **kw):
            fitted.append(super().fit(*args, **kw))
            return fitted[-1]

    monkeypatch.setattr(ML, "written", spied)
    monkeypatch.setattr(ML, "vector_model", lambda cols, est: Kept(stages=[ML.VectorAssembler(inputCols=cols, outputCol="features"), est]))
    train = _labelled(spark)
    draws = [{"C": 1.0}, {"C": 0.05}]
    got = {(r["trial"], r["part"]): r["auc"] for r in ML.cv_report(train, ["a", "b"], lambda d, n: ML.logistic(n, d["C"]), draws, parallelism=1).collect()}
    assert len(plans) == 1 and "Union" not in plans[0]
    want = {}
    for j, model in enumerate(fitted):
        rows = ML.positive_probability(model.transform(train)).select("fold", "churn", "p_churn").collect()
        for part in ("train", "validation"):
            want.setdefault((j // 3, part), []).append(_area([(round(r["p_churn"], 12), r["churn"]) for r in rows
                                                              if (r["fold"] == j % 3) == (part == "validation")]))
    assert got.keys() == want.keys()
    assert all(abs(got[k] - sum(v) / 3) < 1e-9 for k, v in want.items())


def test_area_of_grouped_counts_joins_no_rows(spark):
    rows = [(g, float((i * 5) % 9), (i * 7) % 4, (i * 3) % 5) for g in ("a", None, "b") for i in range(9)] + [("one", 1.0, 3, 0)]
    counts = spark.createDataFrame(rows, "g string, score double, pos long, neg long")
    area = M.auc_of_counts(counts, "score", ["g"])
    assert "Join" not in area._jdf.queryExecution().optimizedPlan().toString()
    for r in area.collect():
        own = [x for x in rows if x[0] == r["g"]]
        pairs = [(s, y) for _, s, p, n in own for y in [1] * p + [0] * n]
        assert r["auc"] is None if r["g"] == "one" else abs(r["auc"] - _area(pairs)) < 1e-12


@pytest.mark.parametrize("cells", [G.MAX_CELLS, 1])
def test_histogram_of_a_level_is_one_step_for_all_trees(spark, monkeypatch, cells):
    """The plan is as large for 30 trees as for 3 (it held an entry for each tree and level), and the counts are those made by hand."""
    monkeypatch.setattr(G, "MAX_CELLS", cells)
    plans = {}
    real = G.best_splits

    def spied(h, *rest):
        plans.setdefault(len(trees), []).append(len(h._jdf.queryExecution().optimizedPlan().toString()))
        assert h.groupBy("tree", "node", "feature").agg({"rows": "sum"}).where("`sum(rows)` < 2").count() == 0
        return real(h, *rest)

    monkeypatch.setattr(G, "best_splits", spied)
    for trees in (range(3), range(30)):
        forest = G.grow_forest(_labelled(spark), ["a", "b"], key=["id"], num_trees=len(trees), max_depth=3)
    assert max(plans[30]) < 1.2 * max(plans[3])
    one = G.grow_forest(_labelled(spark), ["a", "b"], key=["id"], num_trees=1, max_depth=3, bagged=False)
    rows = _labelled(spark).collect()
    for place, n in one.nodes[0].items():
        here = rows
        for d in range(place.bit_length() - 1, 0, -1):
            up, right = one.nodes[0][place >> d], (place >> d - 1) & 1
            here = [r for r in here if (r[up.feature] > up.cut) == bool(right)]
        assert (n.rows, n.weight, n.ones) == (len(here), len(here), sum(r["churn"] for r in here))
    assert len(one.nodes[0]) > 3 and len(forest.nodes) == 30
