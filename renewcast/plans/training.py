"""Train -> choose threshold -> score -> monitor, on top of the assembled model set."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from renewcast.operators import metrics as M
from renewcast.operators import models as ML
from renewcast.operators import prep as PR
from renewcast.operators.forest import GrownForest, grow_forest
from renewcast.plans.assembly import CATEGORICAL, NUMERIC
from renewcast.session import written

KEY = ["msno", "membership_start_date", "membership_expire_date"]


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage (so the plan is
    computed once, and a lost executor re-reads files instead of re-running it)."""
    return written(df, name)


@dataclass
class Prepared:
    model_set: DataFrame
    fit: DataFrame           # training rows minus the hold-out, with the fold column
    test: DataFrame          # hold-out rows of the training period
    scaler: dict
    vocabulary: dict
    names: list[str]

    def matrix(self, df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
        return PR.feature_matrix(df, self.scaler, self.vocabulary, list(NUMERIC),
                                 keep=[*KEY, *[c for c in ("churn",) if c in df.columns], *extra])


def prepare(spark: SparkSession, model_set: DataFrame, test_fraction: float = 0.2, split_seed: int = 611,
            folds: int = 3, fold_seed: int = 42) -> Prepared:
    ms = materialize(spark, model_set, "model_set")
    train = PR.stratified_split(ms.where(F.col("split") == "train"), "churn", KEY, test_fraction, split_seed)
    fit = PR.stratified_folds(train.where(F.col("is_test") == 0), "churn", KEY, folds, fold_seed)
    test = train.where(F.col("is_test") == 1).withColumn("fold", F.lit(None).cast("int"))
    # one written table holds both parts: the ranking runs once, not once per fitted statistic
    pool = materialize(spark, fit.unionByName(test), "train_pool")
    fit, test = pool.where(F.col("is_test") == 0), pool.where(F.col("is_test") == 1)
    params = PR.scaler_params(PR.fit_scaler(fit, list(NUMERIC)))
    vocab = PR.vocabulary(PR.fit_vocabulary(PR.apply_rare_maps(fit), list(CATEGORICAL)))
    vocab.update({"is_auto_renew": ["0", "1"], "is_cancel": ["0", "1"]})
    return Prepared(ms, fit, test, params, vocab, PR.feature_names(list(NUMERIC), vocab))


def fit_bundle(spark: SparkSession, prep: Prepared, kind: str = "logistic", params: dict | None = None,
               metric: str = "f1_5", evaluate: bool = False, info: dict | None = None, model: GrownForest | None = None) -> ML.Bundle:
    """Fit one model on all fitting rows, pick the cut-off with the best ``metric`` on
    the training predictions, and bundle scaler, vocabulary and threshold with it.
    ``evaluate=True`` adds the hold-out AUC, F1.5 and FN rate at that cut-off to the
    bundle's info (keyed by this model, Q9).  A ``model`` that is fitted already is taken as it is."""
    params = params or {}
    # a projection of the written training pool: cheap to recompute, and the
    # estimators cache their own training instances
    X = prep.matrix(prep.fit)
    n = X.count()
    names, rows = prep.names, X
    if model is not None:
        pass
    elif kind == "grown_forest":
        # distributed histograms level by level: ``min_split`` is kept exactly
        model = grow_forest(X, prep.names, "churn", KEY, params.get("num_trees", 50), params.get("max_depth", 5), params.get("min_split", 2),
                            params.get("min_leaf", 1), params.get("feature_subset", "sqrt"), params.get("impurity", "gini"))
    else:
        if kind == "logistic":
            free = not params.get("penalise_intercept", False)
            est = ML.logistic(n, params.get("C", 1.0), params.get("penalty", "l2"), tol=params.get("tol", 1e-4), penalise_intercept=not free)
            if not free:
                rows, names = ML.with_penalised_intercept(X, names, KEY)
        else:
            est = ML.forest(params.get("num_trees", 50), params.get("max_depth", 5),
                            params.get("feature_subset", "sqrt"), params.get("min_leaf", 1),
                            params.get("impurity", "gini"), min_split=params.get("min_split", 2))
        model = ML.vector_model(names, est).fit(rows)
    # written: the sweep compares a score with many cut-offs and would have the model applied anew inside its conditions
    tr = materialize(spark, ML.churn_probability(model, X).select(
        F.col("churn").cast("int").alias("y_true"), F.col("p_churn").alias("score")), "training_scores")
    best = M.best_threshold(M.threshold_sweep(spark, tr), metric).first()
    thr = float(best["threshold"]) if best else 0.5
    info = (info or {}) | {"model_type": kind, "params": params, "threshold": thr, "sample_size": n,
            "feature_count": len(prep.names), "feature_names": prep.names}
    if evaluate:
        te = ML.churn_probability(model, prep.matrix(prep.test)).select(
            F.col("churn").cast("int").alias("y_true"), F.col("p_churn").alias("score"))
        counts = M.with_rates(M.confusion_counts(te.withColumn("y_pred", (F.col("score") >= thr).cast("int"))))
        c = counts.first()
        info.update({"test_auc": M.roc_auc(te).first()["auc"], "test_f1_5": c["f1_5"],
                     "test_fn_rate": c["fn_rate"]})
    return ML.Bundle(model, thr, prep.scaler, prep.vocabulary, list(NUMERIC), info)


def tune_bundle(spark: SparkSession, prep: Prepared, kind: str = "logistic", trials: int = 5, seed: int = 42,
                metric: str = "f1_5") -> tuple[ML.Bundle, list[dict], list[float]]:
    """Tune, refit the best draw on all fitting rows, choose its threshold and bundle it: (bundle, draws, mean validation
    AUC of each).  The bundle's info has ``cv_score`` and ``best_params``."""
    X = materialize(spark, prep.matrix(prep.fit, extra=["fold"]), "cv_matrix")
    model, draws, scores = ML.tune_model(X, prep.names, kind, trials=trials, seed=seed)
    best = max(range(len(scores)), key=lambda i: (scores[i], -i))
    info = {"cv_score": float(scores[best]), "best_params": draws[best]}
    # a tuned forest is refitted on all fitting rows already; a logistic model comes without the pipeline that a bundle saves
    model = model if isinstance(model, GrownForest) else None
    return fit_bundle(spark, prep, kind, draws[best], metric, evaluate=True, info=info, model=model), draws, scores


def score_batch(bundle: ML.Bundle, df: DataFrame, threshold: float | None = None,
                keep: Sequence[str] = ()) -> DataFrame:
    """Scale with the *training* statistics, encode with the training vocabulary, apply
    the model as column expressions; ``threshold=None`` serves at 0.5 (what the reference's service does, Q8).
    Rows need no label; where they have one it is handed through."""
    X = PR.feature_matrix(df, bundle.scaler, bundle.vocabulary, list(bundle.numeric),
                          keep=[*KEY, *[c for c in ("churn",) if c in df.columns], *keep])
    return ML.predict(bundle.model, X, [*KEY, *keep], 0.5 if threshold is None else threshold)
