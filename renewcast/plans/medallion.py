"""The whole feature and label flow as one Spark application writing its layers.

Mirrors the reference's bronze -> silver -> gold storage, but every layer is one
partitioned table (``snapshot_month`` column) written by one action, and each
step reads the layer the previous step wrote: the lineage is cut at every
layer, so a lost executor re-reads files instead of recomputing upstream work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from renewcast.operators.filters import valid_range
from renewcast.operators.joins import feature_join, member_join
from renewcast.functions.scalar import account_age
from renewcast.plans.assembly import assemble_model_set, write_model_set
from renewcast.plans.features import silver_members, usage_features
from renewcast.plans.labels import renewal_labels, silver_transactions
from renewcast.sources.io import write_layer

MONTH = "snapshot_month"


def run_layers(spark: SparkSession, tx: DataFrame, logs: DataFrame, members: DataFrame, root: str,
               window: tuple[str, str] = ("2015-01-01", "2017-03-31"), burst_n: int = 2,
               secs_bounds: tuple[float, float] = (-0.75e16, 0.75e16), lookback_months: int | None = 1,
               tail_end: str = "2017-03-31", tail_days: int = 5, grace: int = 5,
               split_bounds: tuple[str, str, str] = ("2016-11-01", "2016-11-30", "2016-12-01")) -> dict[str, str]:
    """Write silver members / transactions / userlog, gold features and labels, and the
    model set (train, oot, inference by day) under ``root``; returns the layer paths."""
    root = root.rstrip("/")
    paths = {name: f"{root}/{name}" for name in
             ("silver_members", "silver_transactions", "silver_userlog", "gold_features", "gold_labels",
              "model_set")}

    write_layer(silver_members(members), paths["silver_members"])
    t = tx.withColumn(MONTH, F.trunc("membership_expire_date", "MM"))
    write_layer(silver_transactions(t, window, burst_n, scope_cols=(MONTH,)), paths["silver_transactions"], [MONTH])
    st = spark.read.parquet(paths["silver_transactions"])

    usage = usage_features(valid_range(logs, "total_secs", *secs_bounds), st, lookback_months)
    write_layer(usage.withColumn(MONTH, F.trunc("membership_expire_date", "MM")), paths["silver_userlog"], [MONTH])
    ul = spark.read.parquet(paths["silver_userlog"]).drop(MONTH)

    gold = member_join(feature_join(st, ul), spark.read.parquet(paths["silver_members"]))
    gold = gold.withColumn("account_age", account_age("membership_start_date", "registration_init_time")) \
        .drop("plan_list_price", "actual_amount_paid", "payment_plan_days", "registration_init_time")
    write_layer(gold, paths["gold_features"], [MONTH])

    labels = renewal_labels(tx, window, burst_n, tail_end, tail_days, grace, keep=("tx_id",))
    write_layer(labels, paths["gold_labels"])

    ms = assemble_model_set(spark.read.parquet(paths["gold_labels"]), spark.read.parquet(paths["gold_features"]),
                            train_before=split_bounds[0], oot_end=split_bounds[1],
                            inference_after=split_bounds[2])
    write_model_set(ms, paths["model_set"])
    return paths
