"""The model set builds the periods it keeps; the large sides of its joins are hashed past, not sorted; every trial reads rows kept assembled."""
from contextlib import contextmanager

from pyspark.sql import functions as F

from sf_paths import SF_SMALL
from renewcast.catalog import prep as CP
from renewcast.catalog.features import gold
from renewcast.operators import models as ML
from renewcast.operators.joins import interval_join
from renewcast.plans import assembly as A
from renewcast.sources import fixtures as fx


@contextmanager
def settings(spark, **values):
    names = {f"spark.sql.{k.replace('__', '.')}": v for k, v in values.items()}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_the_model_set_builds_labelled_periods_only(spark, monkeypatch):
    seen = []
    assemble = A.assemble_model_set
    monkeypatch.setattr(CP.A, "assemble_model_set", lambda labels, features, **k: seen.append((labels, features)) or assemble(labels, features, **k))
    rows = CP.model_set(spark, SF_SMALL)
    labels, features = seen[0]
    assert features.join(labels, CP.KEY, "left_anti").isEmpty() and not features.isEmpty()
    whole = assemble(CP.labels_with_tie(spark, SF_SMALL), gold(spark, SF_SMALL), plan_days=A.PLAN_DAYS, train_before=fx.SPLIT_TRAIN_BEFORE,
                     oot_end=fx.SPLIT_OOT_END, inference_after=fx.SPLIT_INFERENCE_AFTER)
    assert sorted(map(repr, rows.collect())) == sorted(map(repr, whole.collect()))


def test_large_sides_are_not_sorted(spark):
    with settings(spark, autoBroadcastJoinThreshold="-1"):
        logs, tx = fx.user_logs(spark, SF_SMALL), fx.transactions(spark, SF_SMALL)
        periods = tx.select("msno", F.col("transaction_date").alias("membership_start_date"), "membership_expire_date").distinct()
        for df in (logs, tx, interval_join(logs, periods)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_the_logs_of_a_heavy_user_are_split(spark):
    user = F.when(F.col("id") % 20 > 0, "heavy").otherwise(F.concat(F.lit("u"), F.col("id").cast("string"))).alias("msno")
    first = F.lit("2000-01-01").cast("date")
    logs = spark.range(200_000, numPartitions=16).select(user, F.date_add(first, (F.col("id") % 30).cast("int")).alias("date"), F.xxhash64("id").alias("v"))
    periods = spark.range(0, 200_000, 19).select(user, F.date_add(first, (F.col("id") * 0).cast("int")).alias("membership_start_date")).distinct() \
        .withColumn("membership_expire_date", F.date_add("membership_start_date", 30))
    with settings(spark, autoBroadcastJoinThreshold="-1", adaptive__advisoryPartitionSizeInBytes="64k",
                  adaptive__skewJoin__skewedPartitionThresholdInBytes="128k", adaptive__skewJoin__skewedPartitionFactor="2"):
        out = interval_join(logs, periods)
        rows = out.groupBy().agg(F.count_if(F.col("msno") == "heavy"), F.count_distinct("v"))
        assert rows.collect()[0][0] == 190_000
        plan = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert "ShuffledHashJoin(skew=true)" in plan, plan


def test_logistic_trials_read_kept_rows(spark, monkeypatch):
    seen = []
    scores = ML.fold_scores

    def spy(x, *a):
        seen.append((x.storageLevel.useMemory, x.storageLevel.useDisk, x.rdd.getNumPartitions(), x.count()))
        return scores(x, *a)

    monkeypatch.setattr(ML, "fold_scores", spy)
    rows = spark.range(4000, numPartitions=1).select((F.col("id") % 13).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"),
                                                     (F.col("id") % 3).cast("int").alias("fold"), (F.xxhash64("id") % 2 == 0).cast("int").alias("churn"))
    model, draws, found = ML.tune_model(rows, ["a", "b"], "logistic", trials=2)
    assert seen == [(True, True, spark.sparkContext.defaultParallelism, 4000)] * 2
    lazily = ML.VectorAssembler(inputCols=["a", "b"], outputCol="features", handleInvalid="keep").transform(rows)
    for d, s in zip(draws, found, strict=True):
        want = scores(lazily, lambda n, d=d: ML.logistic(n, d["C"], d["penalty"]), "fold", ML.fitting_rows(rows, "fold"), "churn", 1)
        assert abs(sum(want) / 3 - s) < 1e-6
