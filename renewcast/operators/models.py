"""Spark ML models, tuning, scoring and model bundles.

Estimators are Spark ML's own or forests grown from counts (distributed fits).  The only driver loops are
over trials and folds -- a handful of model fits, each a Spark job --
never over rows.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from renewcast.operators import metrics as M
from renewcast.operators.binned import BinnedForest, bin_rows, grow_binned, spread_cuts, with_walked_probability
from renewcast.operators.compiled import logistic_probability, number, with_probability
from renewcast.operators.forest import GrownForest
from renewcast.operators.tuning import ParzenSampler
from renewcast.session import written

#: The feature that stands for a penalised intercept: 1 in every row.
INTERCEPT = "_intercept"


def logistic(n_rows: int, C: float = 1.0, penalty: str = "l2", label: str = "churn",
             features: str = "features", max_iter: int = 1000, tol: float = 1e-4,
             penalise_intercept: bool = False) -> LogisticRegression:
    """L1/L2 logistic regression with the inverse-strength ``C`` mapped to Spark's
    ``regParam = 1 / (C * n)`` (Spark averages the loss, liblinear sums it); at most
    1000 iterations and a 1e-4 convergence tolerance, the reference's settings.
    Spark leaves the intercept free; ``penalise_intercept`` fits none, for use with the rows and features of ``with_penalised_intercept``, which is
    what the reference's solver does."""
    return LogisticRegression(featuresCol=features, labelCol=label, maxIter=max_iter, tol=tol,
                              regParam=1.0 / (C * max(n_rows, 1)), fitIntercept=not penalise_intercept,
                              elasticNetParam=1.0 if penalty == "l1" else 0.0,
                              standardization=False, family="binomial")


def with_penalised_intercept(df: DataFrame, names: Sequence[str], key: Sequence[str], label: str = "churn") -> tuple[DataFrame, list[str]]:
    """Rows and features to fit a penalised intercept on: the intercept is the weight of one more feature, ``INTERCEPT``.

    Spark gives a constant column the weight 0, so half of the rows (by a hash of the key) have all features negated and
    the other label, which leaves their loss as it is: log(1 + exp(-s w.x)) is the same for (x, s) and (-x, -s)."""
    sign = F.when(F.pmod(F.xxhash64(*key), F.lit(2)) == 1, F.lit(-1.0)).otherwise(F.lit(1.0))
    y = F.col(label).cast("double")
    flipped = df.withColumn(INTERCEPT, sign)
    rest = [c for c in flipped.columns if c not in {*names, label}]
    return flipped.select(*rest, *[(F.col(f"`{n}`").cast("double") * F.col(INTERCEPT)).alias(n) for n in names],
                          F.when(F.col(INTERCEPT) > 0, y).otherwise(1 - y).alias(label)), [*names, INTERCEPT]


def coefficients(model: PipelineModel) -> tuple[list[str], list[float], float]:
    """(features, weights, intercept) of a fitted logistic pipeline; a penalised intercept comes as the intercept."""
    assembler, fitted = model.stages
    names, weights, intercept = list(assembler.getInputCols()), fitted.coefficients.toArray().tolist(), float(fitted.intercept)
    if INTERCEPT in names:
        intercept += weights.pop(names.index(INTERCEPT))
        names.remove(INTERCEPT)
    return names, weights, intercept


def optimality(df: DataFrame, names: Sequence[str], weights: Sequence[float], intercept: float, C: float = 1.0, penalty: str = "l2",
               label: str = "churn", penalise_intercept: bool = False) -> DataFrame:
    """Certificate of a logistic fit: (name, weight, gradient, violation), one aggregate over the rows.

    The objective is penalty(w) + C x sum of losses.  ``gradient`` is that of the losses; at the optimum it balances the
    penalty: -w for L2, -sign(w) for L1 and anything in [-1, 1] at a weight of 0.  ``violation`` is what is left, 0 at the optimum,
    whoever found the weights.
    """
    p = logistic_probability(names, weights, intercept)
    rows = df.select((F.lit(float(C)) * (p - F.col(label).cast("double"))).alias("_r"), *[number(n).alias(n) for n in names])
    parts = [F.sum(F.col("_r") * F.col(f"`{n}`")).alias(n) for n in names] + [F.sum("_r").alias(INTERCEPT)]
    wide = rows.agg(*parts)
    every = [*names, INTERCEPT]
    w = dict(zip(every, [*map(float, weights), float(intercept)], strict=True))
    pairs = ", ".join(f"'{n}', double('{w[n]!r}'), `{n}`" for n in every)
    long = wide.select(F.expr(f"stack({len(every)}, {pairs}) AS (name, weight, gradient)"))
    weight, g = F.col("weight"), F.col("gradient")
    if penalty == "l1":
        own = F.when(weight != 0, F.abs(g + F.signum(weight))).otherwise(F.greatest(F.abs(g) - 1, F.lit(0.0)))
    else:
        own = F.abs(g + weight)
    free = (F.col("name") == INTERCEPT) & F.lit(not penalise_intercept)
    return long.withColumn("violation", F.when(free, F.abs(g)).otherwise(own))


def forest(num_trees: int = 100, max_depth: int = 5, feature_subset: str = "sqrt",
           min_leaf: int = 1, impurity: str = "gini", seed: int = 42, label: str = "churn",
           features: str = "features", min_split: int = 2, max_bins: int = 32) -> RandomForestClassifier:
    """Random forest.  Spark has no min-samples-split: a node that may only be split from ``min_split`` rows on
    is approached by ``leaf_rows`` rows in each child.  ``max_bins``: split candidates per feature, which
    Spark takes from a sample of the rows (a fitting parameter of the model, not a limit on the data)."""
    return RandomForestClassifier(featuresCol=features, labelCol=label, numTrees=num_trees,
                                  maxDepth=max_depth, featureSubsetStrategy=feature_subset, maxBins=max_bins,
                                  minInstancesPerNode=leaf_rows(min_leaf, min_split), impurity=impurity, seed=seed)


#: Ranges of the reference's searches.
LOGISTIC_SPACE = {"C": ("log", 0.1, 50.0), "penalty": ("choice", ("l1", "l2"))}
FOREST_SPACE = {"num_trees": ("int", 50, 400), "max_depth": ("int", 5, 10), "feature_subset": ("choice", ("sqrt", "log2", "0.6", "0.8")),
                "min_leaf": ("int", 1, 10), "impurity": ("choice", ("gini", "entropy")), "min_split": ("int", 10, 50)}
#: Random draws before adaptive ones.
STARTUP = {"logistic": 3, "forest": 2}


def leaf_rows(min_leaf: int, min_split: int) -> int:
    """Rows each child must have so that no node of fewer than ``min_split`` rows is split."""
    return max(min_leaf, -(-min_split // 2))


@dataclass
class BinnedForestFit:
    """Fits a forest of ``params`` (a draw of ``FOREST_SPACE``) to binned rows, with ``min_split`` kept exactly."""
    features: Sequence[str]
    cuts: Mapping[str, Sequence[float]]
    params: Mapping
    seed: int = 42
    label: str = "churn"

    def fit(self, rows: DataFrame) -> BinnedForest:
        d = self.params
        return grow_binned(rows, self.features, self.cuts, self.label, d["num_trees"], d["max_depth"], d["min_split"], d["min_leaf"],
                           d["feature_subset"], d["impurity"], self.seed)


def vector_model(feature_cols: Sequence[str], estimator) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=list(feature_cols), outputCol="features",
                                            handleInvalid="keep"), estimator])


def draw_logistic_params(trials: int = 5, seed: int = 42) -> list[dict]:
    """Seeded random draw over the reference's ranges: C log-uniform in [0.1, 50], L1 or L2."""
    rng = random.Random(seed)
    out = []
    for _ in range(trials):
        c = math.exp(rng.uniform(math.log(0.1), math.log(50.0)))
        out.append({"C": c, "penalty": rng.choice(["l1", "l2"])})
    return out


def draw_forest_params(trials: int = 5, seed: int = 42) -> list[dict]:
    """Seeded draw over 50-400 trees, depth 5-10, sqrt/log2/0.6/0.8, leaf 1-10, gini/entropy, split 10-50."""
    rng = random.Random(seed)
    return [{"num_trees": rng.randint(50, 400), "max_depth": rng.randint(5, 10),
             "feature_subset": rng.choice(["sqrt", "log2", "0.6", "0.8"]),
             "min_leaf": rng.randint(1, 10), "impurity": rng.choice(["gini", "entropy"]),
             "min_split": rng.randint(10, 50)}
            for _ in range(trials)]


#: Nodes of the largest grown forest that scores as nested conditions.
COMPILED_NODES = 2_000
#: Rows of one task of a fit, at most.
TASK_ROWS = 500_000


def even_parts(df: DataFrame, rows: int) -> int:
    """Partitions for a fit over ``rows`` rows: a multiple of the cores, so that no core waits for a last task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return cores * max(1, -(-rows // (cores * TASK_ROWS)))


def fitting_rows(train: DataFrame, fold_col: str) -> dict[int, int]:
    """Fold -> rows of all other folds; one aggregate, a row per fold."""
    n = {r[fold_col]: r["count"] for r in train.where(F.col(fold_col).isNotNull()).groupBy(fold_col).count().collect()}
    return {f: sum(n.values()) - own for f, own in sorted(n.items())}


def fold_scores(train: DataFrame, estimator: Callable[[int], Estimator], fold_col: str, folds: Mapping[int, int], label: str,
                parallelism: int) -> list[float]:
    """Validation AUC of each fold: fitted on the other folds, scored on it.  ``folds`` has the rows each fit sees, which the estimator is
    made for (its penalty is relative to them).  The fits are Spark jobs, submitted together."""
    from concurrent.futures import ThreadPoolExecutor

    judge = BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC", numBins=0)

    def one(f: int) -> float:
        model = estimator(folds[f]).fit(train.where(F.col(fold_col) != f))
        return float(judge.evaluate(model.transform(train.where(F.col(fold_col) == f))))

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        return list(pool.map(one, folds))


def tune_model(train: DataFrame, feature_cols: Sequence[str], kind: str = "logistic",
               trials: int = 5, seed: int = 42, fold_col: str = "fold", label: str = "churn",
               parallelism: int = 3, adaptive: bool = True, startup: int | None = None):
    """Trial after trial: a draw of parameters, scored by its mean validation AUC over the user's stratified folds; the best draw is
    refit on all rows.  (model, draws, scores).

    ``adaptive`` draws follow the trials before (``ParzenSampler``, after ``startup`` random ones); otherwise all are random.
    Logistic models are Spark's.  Forests are grown from rows that are binned once (``operators.binned``); the model is a ``GrownForest``, and a
    row's weights in the bags follow from the columns that are neither features, label nor fold, or from all where there are no others.
    """
    n = train.count()
    draws: list[dict] = []
    scores: list[float] = []
    if adaptive:
        sampler = ParzenSampler(LOGISTIC_SPACE if kind == "logistic" else FOREST_SPACE, seed, STARTUP[kind] if startup is None else startup)
    else:
        fixed = draw_logistic_params(trials, seed) if kind == "logistic" else draw_forest_params(trials, seed)

    def estimator(d: dict, rows: int):
        if kind == "logistic":
            return logistic(rows, d["C"], d["penalty"], label=label)
        return BinnedForestFit(names, cuts, d, seed, label)

    if kind == "logistic":
        x = VectorAssembler(inputCols=list(feature_cols), outputCol="features", handleInvalid="keep").transform(train).select("features", label, fold_col)
    else:
        names = sorted(feature_cols)
        cuts = spread_cuts(train, names)
        key = [c for c in train.columns if c not in {*names, label, fold_col}] or train.columns
        x = bin_rows(train, names, cuts, key, [label, fold_col])
    # every fit and every score reads the rows, a forest's once a level: assembled or binned once, kept in memory or on disk, the same number in every task
    x = x.repartition(even_parts(x, n)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        folds = fitting_rows(x, fold_col)          # also fills the store, before the fits of the folds ask for it together
        for t in range(trials):
            d = sampler.next(draws, scores) if adaptive else fixed[t]
            found = fold_scores(x, lambda rows, d=d: estimator(d, rows), fold_col, folds, label, parallelism)
            draws.append(d)
            scores.append(sum(found) / len(found))
        best = max(range(trials), key=lambda i: (scores[i], -i))
        model = estimator(draws[best], n).fit(x)
        return model.grown() if isinstance(model, BinnedForest) else model, draws, scores
    finally:
        x.unpersist()


def positive_probability(df: DataFrame, col: str = "probability", name: str = "p_churn") -> DataFrame:
    return df.withColumn(name, vector_to_array(F.col(col))[1])


def churn_probability(model: PipelineModel | GrownForest, df: DataFrame, compiled: bool = True, name: str = "p_churn") -> DataFrame:
    """Adds the probability of churn, as column expressions where the model has such a form (``compiled``), else by its ``transform``.

    Spark's own forests score by ``transform``: the nested conditions of their trees are more code than the JVM compiles.  For the same reason grown
    forests of more than ``COMPILED_NODES`` nodes are walked down in Arrow batches."""
    if isinstance(model, PipelineModel) and INTERCEPT in getattr(model.stages[0], "getInputCols", list)() and INTERCEPT not in df.columns:
        df = df.withColumn(INTERCEPT, F.lit(1.0))
    if isinstance(model, GrownForest) and sum(map(len, model.nodes)) > COMPILED_NODES:
        return with_walked_probability(df, model, name)
    spark_forest = isinstance(model, PipelineModel) and isinstance(model.stages[-1], RandomForestClassificationModel)
    if compiled and not spark_forest or isinstance(model, GrownForest):
        out = with_probability(df, model, name)
        if out is not None:
            return out
    return positive_probability(model.transform(df), name=name)


def predict(model: PipelineModel | GrownForest, df: DataFrame, keep: Sequence[str], threshold: float = 0.5,
            label: str = "churn", compiled: bool = True) -> DataFrame:
    """key, label (where the rows have one), probability of churn and the 0/1 decision at ``threshold`` (0.5 serves, Q8)."""
    out = churn_probability(model, df, compiled)
    return out.select(*keep, *[c for c in (label,) if c in df.columns], F.col("p_churn").alias("probability"),
                      (F.col("p_churn") >= F.lit(threshold)).cast("int").alias("prediction"))


def cv_report(train: DataFrame, feature_cols: Sequence[str], make_estimator: Callable[[dict, int], Estimator], draws: Sequence[dict],
              k: int = 3, fold_col: str = "fold", label: str = "churn", cut: float = 0.5,
              parallelism: int = 4) -> DataFrame:
    """Per trial: mean train and validation AUC, F1.5 and FN rate at cut 0.5 over the folds.

    ``make_estimator`` gets a draw and the rows of the fit.  The (trial, fold) fits are independent Spark jobs and are submitted from
    ``parallelism`` threads (as ``CrossValidator`` does).  All models score the
    whole training set in one pass, which keeps only positives and negatives per (trial, fold, part, score); all
    metrics come from these counts.
    """
    from concurrent.futures import ThreadPoolExecutor

    def fit_one(job):
        _, d, f = job
        return vector_model(feature_cols, make_estimator(d, rows[f])).fit(train.where(F.col(fold_col) != f))

    rows = fitting_rows(train, fold_col)
    jobs = [(t, d, f) for t, d in enumerate(draws) for f in range(k)]
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        models = list(pool.map(fit_one, jobs))
    wide = train
    for i, model in enumerate(models):
        # logistic models are one expression each; others score by their ``transform``
        wide = churn_probability(model, wide, isinstance(model.stages[-1], LogisticRegressionModel), f"_p{i}").select(*wide.columns, f"_p{i}")
    part = [F.when(F.col(fold_col) == f, F.lit("validation")).otherwise(F.lit("train")) for _, _, f in jobs]
    scores = F.array(*[F.struct(F.lit(t).alias("trial"), F.lit(f).alias("fold"), part[i].alias("part"), F.col(f"_p{i}").alias("score"))
                       for i, (t, _, f) in enumerate(jobs)])
    long = wide.select(F.col(label).cast("int").alias("_y"), F.inline(scores))
    # the counts feed two aggregates: written once, so the fold models are not applied twice
    scored = written(long.groupBy("trial", "fold", "part", "score").agg(
        F.count_if(F.col("_y") == 1).alias("pos"), F.count_if(F.col("_y") == 0).alias("neg")), "cv_counts")
    by = ["trial", "fold", "part"]
    hit = F.col("score") >= F.lit(cut)

    def total(col, where):
        return F.coalesce(F.sum(F.when(where, F.col(col))), F.lit(0)).cast("long")

    counts = M.with_rates(scored.groupBy(*by).agg(total("neg", ~hit).alias("tn"), total("neg", hit).alias("fp"),
                                                  total("pos", ~hit).alias("fn"), total("pos", hit).alias("tp")))
    auc = M.auc_of_counts(scored, "score", by)
    per_fold = counts.join(auc, by, "left")
    return per_fold.groupBy("trial", "part").agg(F.avg("auc").alias("auc"), F.avg("f1_5").alias("f1_5"),
                                                 F.avg("fn_rate").alias("fn_rate"))


@dataclass
class Bundle:
    """A fitted model with everything needed to score new rows the same way."""
    model: PipelineModel | GrownForest
    threshold: float = 0.5
    scaler: Mapping[str, tuple[float, float]] = field(default_factory=dict)
    vocabulary: Mapping[str, Sequence[str]] = field(default_factory=dict)
    numeric: Sequence[str] = ()
    info: Mapping[str, object] = field(default_factory=dict)


def save_bundle(spark: SparkSession, bundle: Bundle, path: str) -> None:
    """Pipeline via Spark ML persistence, or a grown forest as its table of nodes, + one-row metadata table (parquet)."""
    grown = isinstance(bundle.model, GrownForest)
    if grown:
        bundle.model.node_table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
    else:
        bundle.model.write().overwrite().save(f"{path}/model")
    meta = {"forest": json.dumps({"features": bundle.model.features, "params": bundle.model.params}) if grown else "",
            "threshold": float(bundle.threshold),
            "scaler": json.dumps({k: list(v) for k, v in bundle.scaler.items()}),
            "vocabulary": json.dumps({k: list(v) for k, v in bundle.vocabulary.items()}),
            "numeric": json.dumps(list(bundle.numeric)),
            "info": json.dumps(bundle.info, default=str)}
    spark.createDataFrame([meta]).coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load_bundle(spark: SparkSession, path: str) -> Bundle:
    m = spark.read.parquet(f"{path}/meta").first().asDict()
    if m.get("forest"):
        about = json.loads(m["forest"])
        model = GrownForest.from_table(spark.read.parquet(f"{path}/nodes"), about["features"], about["params"])
    else:
        model = PipelineModel.load(f"{path}/model")
    return Bundle(model=model, threshold=m["threshold"],
                  scaler={k: tuple(v) for k, v in json.loads(m["scaler"]).items()},
                  vocabulary=json.loads(m["vocabulary"]), numeric=json.loads(m["numeric"]),
                  info=json.loads(m["info"]))
