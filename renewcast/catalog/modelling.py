"""Model queries.

Fitted coefficients are not SQL, so the plain queries are checked by their rows only.  The ``__checked`` ones return what SQL
can state of the same run: the keys and labels of the scored rows, that every decision follows from its
probability and cut-off, counts of trials, folds and classes, and metrics that add up.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from renewcast.catalog.prep import _ms_sql, model_set
from renewcast.operators import metrics as M
from renewcast.operators import models as ML
from renewcast.operators.forest import GrownForest
from renewcast.plans import training as T
from renewcast.registry import query
from renewcast.session import scratch_path

KEY = T.KEY


def _prep(spark, sf):
    return T.prepare(spark, model_set(spark, sf))


@query("train_logistic")
def train_logistic(spark, sf):
    """L2 logistic regression (C = 1) fitted on the training rows; hold-out predictions."""
    p = _prep(spark, sf)
    b = T.fit_bundle(spark, p, "logistic", {"C": 1.0, "penalty": "l2"})
    return T.score_batch(b, p.test, threshold=b.threshold)


@query("train_forest")
def train_forest(spark, sf):
    """Random forest (50 trees, depth 5, sqrt features); hold-out predictions."""
    p = _prep(spark, sf)
    b = T.fit_bundle(spark, p, "forest", {"num_trees": 50, "max_depth": 5})
    return T.score_batch(b, p.test, threshold=b.threshold)


def _test_auc(spark, p, model):
    """AUC of the refit best model on the hold-out rows."""
    from pyspark.ml.feature import VectorAssembler
    if isinstance(model, GrownForest):
        scored = ML.churn_probability(model, p.matrix(p.test))
    else:
        Xt = VectorAssembler(inputCols=p.names, outputCol="features", handleInvalid="keep").transform(p.matrix(p.test))
        scored = ML.positive_probability(model.transform(Xt))
    s = scored.select(F.col("churn").cast("int").alias("y_true"), F.col("p_churn").alias("score"))
    return M.roc_auc(s).first()["auc"]


@query("tune_model")
def tune_model(spark, sf):
    """5 draws (3 random, then adaptive) x 3 stratified folds, scored by mean validation AUC;
    the best draw is refit on all fitting rows and its hold-out AUC reported."""
    p = _prep(spark, sf)
    X = T.materialize(spark, p.matrix(p.fit, extra=["fold"]), "cv_matrix")
    model, draws, metrics = ML.tune_model(X, p.names, "logistic", trials=5, seed=42)
    best = max(range(len(metrics)), key=lambda i: (metrics[i], -i))
    test_auc = _test_auc(spark, p, model)
    rows = [(i, float(d["C"]), d["penalty"], float(m), i == best, float(test_auc) if i == best else None)
            for i, (d, m) in enumerate(zip(draws, metrics))]
    return spark.createDataFrame(rows, "trial int, C double, penalty string, cv_auc double, is_best boolean, "
                                       "test_auc double")


@query("cv_report")
def cv_report(spark, sf):
    """Per trial: mean train / validation AUC, F1.5, FN rate at cut 0.5."""
    p = _prep(spark, sf)
    X = T.materialize(spark, p.matrix(p.fit, extra=["fold"]), "cv_matrix")
    draws = ML.draw_logistic_params(5, 42)
    return ML.cv_report(X, p.names, lambda d, n: ML.logistic(n, d["C"], d["penalty"]), draws, k=3)


@query("score_batch", headline=True)
def score_batch(spark, sf):
    """Inference rows scored with the training scaler, vocabulary and model (served at 0.5)."""
    p = _prep(spark, sf)
    b = T.fit_bundle(spark, p, "logistic", {"C": 1.0, "penalty": "l2"})
    inf = p.model_set.where(F.col("split") == "inference")
    return T.score_batch(b, inf)


@query("save_load_bundle")
def save_load_bundle(spark, sf):
    """Bundle round trip (pipeline + threshold + scaler + vocabulary + info with hold-out
    metrics), then OOT scoring with the loaded bundle."""
    p = _prep(spark, sf)
    b = T.fit_bundle(spark, p, "logistic", {"C": 1.0, "penalty": "l2"}, evaluate=True)
    path = scratch_path(spark, "bundle")
    ML.save_bundle(spark, b, path)
    loaded = ML.load_bundle(spark, path)
    oot = p.model_set.where(F.col("split") == "oot")
    return T.score_batch(loaded, oot, threshold=loaded.threshold)


@query("evaluate_model")
def evaluate_model(spark, sf):
    """Per (model, data set): AUC, F1.5, precision, recall, counts and campaign metrics of the
    logistic and forest models on the hold-out and OOT rows, each at its own tuned threshold
    (metrics keyed by model, Q9)."""
    p = _prep(spark, sf)
    oot_rows = p.model_set.where(F.col("split") == "oot")
    parts = []
    for kind, params in (("logistic", {"C": 1.0, "penalty": "l2"}), ("forest", {"num_trees": 50, "max_depth": 5})):
        b = T.fit_bundle(spark, p, kind, params)
        for name, rows in (("test", p.test), ("oot", oot_rows)):
            s = T.score_batch(b, rows).select(
                F.lit(kind).alias("model"), F.lit(name).alias("dataset"),
                F.col("churn").cast("int").alias("y_true"), F.col("probability").alias("score"),
                F.lit(b.threshold).alias("threshold"))
            parts.append(s)
    preds = parts[0]
    for x in parts[1:]:
        preds = preds.unionByName(x)
    # each model's own cut-off is a column, so one grouped pass evaluates every (model, data set)
    return M.evaluate_split(preds, ["model", "dataset"], F.col("threshold"))


@query("daily_monitor__model")
def daily_monitor_model(spark, sf):
    """Daily monitor over the model's stored inference predictions, by expiry day."""
    p = _prep(spark, sf)
    b = T.fit_bundle(spark, p, "logistic", {"C": 1.0, "penalty": "l2"})
    preds = T.score_batch(b, p.model_set.where(F.col("split") == "inference"))
    stored = T.materialize(spark, preds, "predictions")
    s = stored.select(F.col("membership_expire_date").alias("day"), F.col("churn").cast("int").alias("y_true"),
                      F.col("prediction").alias("y_pred"), F.col("probability").alias("score"))
    return M.daily_monitor(s, "day", score="score")


@query("tune_model__forest")
def tune_model_forest(spark, sf):
    """Random-forest tuning: 5 seeded draws over trees / depth / features / leaf / impurity, 3 folds."""
    p = _prep(spark, sf)
    X = T.materialize(spark, p.matrix(p.fit, extra=["fold"]), "cv_matrix")
    model, draws, metrics = ML.tune_model(X, p.names, "forest", trials=5, seed=42)
    best = max(range(len(metrics)), key=lambda i: (metrics[i], -i))
    test_auc = _test_auc(spark, p, model)
    rows = [(i, int(d["num_trees"]), int(d["max_depth"]), d["feature_subset"], int(d["min_leaf"]),
             d["impurity"], float(m), i == best, float(test_auc) if i == best else None)
            for i, (d, m) in enumerate(zip(draws, metrics))]
    return spark.createDataFrame(rows, "trial int, num_trees int, max_depth int, feature_subset string, "
                                       "min_leaf int, impurity string, cv_auc double, is_best boolean, "
                                       "test_auc double")


# ------------------------------------------------------------------ the same operators in a form SQL can check

_KEYS = "msno, membership_start_date, membership_expire_date"


def _decisions(df, cut, *keep):
    """Keys, whether the probability is one, and whether the decision is the probability against the cut-off."""
    p = F.col("probability")
    return df.select(*KEY, *keep, ((p >= 0) & (p <= 1)).alias("is_probability"),
                     (F.col("prediction") == (p >= F.lit(cut)).cast("int")).alias("decided"))


@query("train_logistic__checked", _ms_sql(f"SELECT {_KEYS}, churn, true AS is_probability, true AS decided FROM tr WHERE is_test = 1"))
def train_logistic_checked(spark, sf):
    p = _prep(spark, sf)
    b = T.fit_bundle(spark, p, "logistic", {"C": 1.0, "penalty": "l1"})
    return _decisions(T.score_batch(b, p.test, threshold=b.threshold), b.threshold, "churn")


@query("train_forest__checked", _ms_sql(f"SELECT {_KEYS}, churn, true AS is_probability, true AS decided FROM tr WHERE is_test = 1"))
def train_forest_checked(spark, sf):
    """A grown forest, no node of fewer than 20 rows split, saved and loaded before it scores."""
    p = _prep(spark, sf)
    path = scratch_path(spark, "forest_bundle")
    ML.save_bundle(spark, T.fit_bundle(spark, p, "grown_forest", {"num_trees": 20, "max_depth": 5, "min_split": 20}), path)
    b = ML.load_bundle(spark, path)
    return _decisions(T.score_batch(b, p.test, threshold=b.threshold), b.threshold, "churn")


@query("score_batch__unlabelled", _ms_sql(f"SELECT {_KEYS}, true AS is_probability, true AS decided FROM ms WHERE split = 'inference'"))
def score_batch_unlabelled(spark, sf):
    """Inference rows that have no label column, scored and served at 0.5."""
    p = _prep(spark, sf)
    b = T.fit_bundle(spark, p, "logistic", {"C": 1.0, "penalty": "l2"})
    return _decisions(T.score_batch(b, p.model_set.where(F.col("split") == "inference").drop("churn")), 0.5)


@query("score_batch__one_day", _ms_sql(f"""
SELECT {_KEYS}, true AS is_probability, true AS decided FROM ms WHERE split = 'inference'
  AND membership_expire_date = (SELECT max(membership_expire_date) FROM ms WHERE split = 'inference')"""))
def score_batch_one_day(spark, sf):
    """The last day's partition of the inference layer, read with a pruned scan and scored."""
    from renewcast.sources.io import read_layer, write_by_day
    p = _prep(spark, sf)
    path = scratch_path(spark, "inference_by_day")
    write_by_day(p.model_set.where(F.col("split") == "inference"), path)
    last = spark.read.parquet(path).agg(F.max("membership_expire_date")).first()[0]
    b = T.fit_bundle(spark, p, "logistic", {"C": 1.0, "penalty": "l2"})
    return _decisions(T.score_batch(b, read_layer(spark, path, "membership_expire_date", [str(last)])), 0.5)


def best_trials(info: dict, draws: list[dict], scores: list[float]) -> int:
    """The number of trials with the bundle's score and the bundle's draw."""
    return sum(s == info["cv_score"] and d == info["best_params"] for d, s in zip(draws, scores, strict=True))


@query("tune_model__checked", _ms_sql("""
SELECT CAST(i AS INTEGER) AS trial, true AS is_auc, true AS best_has_top_auc, 1 AS best_trials, true AS bundle_is_best,
       CAST((SELECT count(*) FROM fit) AS BIGINT) AS sample_size
FROM range(5) t(i)"""))
def tune_model_checked(spark, sf):
    """Tune, refit, choose the threshold, bundle, save and load: what the bundle says against the trials."""
    p = _prep(spark, sf)
    bundle, draws, scores = T.tune_bundle(spark, p, "logistic")
    path = scratch_path(spark, "tuned_bundle")
    ML.save_bundle(spark, bundle, path)
    info = ML.load_bundle(spark, path).info
    top = max(scores)
    same = info["cv_score"] == top and info["best_params"] == draws[scores.index(top)] and info["params"] == info["best_params"]
    best = best_trials(info, draws, scores)
    rows = [(i, 0.0 <= s <= 1.0, s <= info["cv_score"], best, bool(same), int(info["sample_size"])) for i, s in enumerate(scores)]
    return spark.createDataFrame(rows, "trial int, is_auc boolean, best_has_top_auc boolean, best_trials int, bundle_is_best boolean, "
                                       "sample_size long")


@query("cv_report__checked", _ms_sql("""
SELECT CAST(i AS INTEGER) AS trial, part, true AS has_rates FROM range(5) t(i), (VALUES ('train'), ('validation')) v(part)"""))
def cv_report_checked(spark, sf):
    """Trials and parts of the report, and that every mean metric is a share."""
    r = cv_report(spark, sf)
    share = [F.col(c).between(0, 1) for c in ("auc", "f1_5", "fn_rate")]
    return r.select(F.col("trial").cast("int").alias("trial"), "part", (share[0] & share[1] & share[2]).alias("has_rates"))


@query("save_load_bundle__checked", _ms_sql(f"SELECT {_KEYS}, churn, true AS same FROM ms WHERE split = 'oot'"))
def save_load_bundle_checked(spark, sf):
    """Out-of-time rows scored by a bundle and by its saved and loaded copy: the same probabilities and decisions."""
    p = _prep(spark, sf)
    b = T.fit_bundle(spark, p, "logistic", {"C": 1.0, "penalty": "l2"})
    path = scratch_path(spark, "bundle")
    ML.save_bundle(spark, b, path)
    loaded = ML.load_bundle(spark, path)
    oot = p.model_set.where(F.col("split") == "oot")
    a = T.score_batch(b, oot, threshold=b.threshold)
    c = T.score_batch(loaded, oot, threshold=loaded.threshold).select(*KEY, F.col("probability").alias("p2"), F.col("prediction").alias("d2"))
    return a.join(c, KEY).select(*KEY, "churn", ((F.col("probability") == F.col("p2")) & (F.col("prediction") == F.col("d2"))).alias("same"))


@query("evaluate_model__checked", _ms_sql("""
SELECT model, dataset, CAST(count(*) AS BIGINT) AS total_users, CAST(sum(churn) AS BIGINT) AS total_churn, true AS adds_up
FROM (SELECT 'test' AS dataset, churn FROM tr WHERE is_test = 1 UNION ALL SELECT 'oot', churn FROM ms WHERE split = 'oot') d,
     (VALUES ('logistic'), ('forest')) m(model)
GROUP BY 1, 2"""))
def evaluate_model_checked(spark, sf):
    """Rows and churners of every (model, data set), and that counts and rates agree."""
    e = evaluate_model(spark, sf)
    right = (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp") == F.col("total_users")) & (F.col("tp") + F.col("fn") == F.col("total_churn")) \
        & F.coalesce(F.col("auc").between(0, 1), F.lit(True))
    return e.select("model", "dataset", "total_users", "total_churn", right.alias("adds_up"))


@query("daily_monitor__model_checked", _ms_sql("""
SELECT membership_expire_date AS day, CAST(count(*) AS BIGINT) AS rows, CAST(sum(churn) AS BIGINT) AS churned, true AS adds_up
FROM ms WHERE split = 'inference' GROUP BY 1"""))
def daily_monitor_model_checked(spark, sf):
    """Rows and churners per expiry day of the monitored model predictions."""
    m = daily_monitor_model(spark, sf)
    return m.select("day", "rows", (F.col("tp") + F.col("fn")).alias("churned"),
                    (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp") == F.col("rows")).alias("adds_up"))
