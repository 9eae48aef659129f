"""Scores are computed once, where they are written; Spark's forests score by their own ``transform`` and are tuned over even parts."""
import pytest
from pyspark.sql import functions as F

from sf_paths import SF_SMALL
from renewcast.catalog.prep import prepared
from renewcast.operators import models as ML
from renewcast.plans import training as T


@pytest.fixture(scope="module")
def prep(spark):
    return prepared(spark, SF_SMALL)


@pytest.mark.parametrize("kind, params", [("logistic", {}), ("forest", {"num_trees": 3, "max_depth": 3})])
def test_the_threshold_sweep_reads_written_scores(spark, prep, monkeypatch, kind, params):
    seen = []
    sweep = T.M.threshold_sweep
    monkeypatch.setattr(T.M, "threshold_sweep", lambda spark, df, *a, **k: seen.append(df) or sweep(spark, df, *a, **k))
    bundle = T.fit_bundle(spark, prep, kind, params)
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "training_scores" in seen[0].inputFiles()[0] and "Project" not in plan
    want = ML.churn_probability(bundle.model, prep.matrix(prep.fit)).select(F.col("churn").cast("int").alias("y_true"), F.col("p_churn").alias("score"))
    assert sorted(map(tuple, seen[0].collect())) == sorted(map(tuple, want.collect()))


def test_a_spark_forest_scores_without_conditions(spark, prep):
    X = prep.matrix(prep.fit)
    model = ML.vector_model(prep.names, ML.forest(4, 4)).fit(X)
    rows = X.select(*prep.names)
    scored = ML.churn_probability(model, T.materialize(spark, rows, "features"))
    assert "CASE WHEN" not in scored._jdf.queryExecution().optimizedPlan().toString()
    both = ML.with_probability(scored, model, "compiled").where(F.abs(F.col("compiled") - F.col("p_churn")) > 1e-9)
    assert both.isEmpty() and not scored.isEmpty()


def test_forests_are_tuned_over_rows_in_even_parts(spark, monkeypatch):
    seen = []
    scores = ML.fold_scores

    def spy(x, *a):
        seen.append((x.storageLevel, [r["count"] for r in x.groupBy(F.spark_partition_id()).count().collect()]))
        return scores(x, *a)

    monkeypatch.setattr(ML, "fold_scores", spy)
    monkeypatch.setattr(ML, "FOREST_SPACE", {**ML.FOREST_SPACE, "num_trees": ("int", 2, 2), "max_depth": ("int", 2, 2)})
    rows = spark.range(4000, numPartitions=1).select(F.col("id").cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"),
                                                     (F.col("id") % 3).cast("int").alias("fold"), (F.col("id") % 2).cast("int").alias("churn"))
    ML.tune_model(rows, ["a", "b"], "forest", trials=1)
    (level, sizes), cores = seen[0], spark.sparkContext.defaultParallelism
    assert level.useMemory and level.useDisk and len(sizes) == cores and max(sizes) <= 1.5 * 4000 / cores
    monkeypatch.setattr(ML, "TASK_ROWS", 100)
    assert ML.even_parts(rows, 4000) * 100 >= 4000 and ML.even_parts(rows, 4000) % cores == 0
