"""Source / sink queries: CSV scans, layer writes and partition-pruned reads."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from renewcast import oracle as O
from renewcast.catalog.features import GOLD_DOUBLES, _GOLD_SQL, gold
from renewcast.catalog.prep import _MS, model_set
from renewcast.registry import query
from renewcast.session import scratch_path
from renewcast.sources import fixtures as fx
from renewcast.sources import io

TX_COLS = ["msno", "tx_id", "payment_method_id", "payment_plan_days", "plan_list_price", "actual_amount_paid",
           "is_auto_renew", "is_cancel", "transaction_date", "membership_expire_date"]


@query("read_raw_csv", O.with_base(f"SELECT {', '.join(TX_COLS)} FROM transactions",
                                   doubles=["plan_list_price", "actual_amount_paid"]))
def read_raw_csv(spark, sf):
    """Raw transactions written as headed CSV (yyyyMMdd text dates, index column, another column order), scanned
    back with the declared columns bound by name; the fixture's tie-break is declared besides."""
    path = _as_csv(spark, fx.raw_transactions(spark, sf), "raw_transactions_csv")
    schema = T.StructType([*io.RAW_TRANSACTIONS.fields, T.StructField("tx_id", T.LongType())])
    df = io.read_raw_csv(spark, path, schema, date_cols=("transaction_date", "membership_expire_date"))
    return df.select(*TX_COLS)


def _as_csv(spark, df, name):
    path = scratch_path(spark, name)
    df.write.option("header", True).csv(path)
    return path


LOG_COLS = ["msno", "date", "num_25", "num_50", "num_75", "num_985", "num_100", "num_unq", "total_secs"]


@query("read_raw_csv__logs", O.with_base(f"SELECT {', '.join(c if c in ('msno', 'date', 'total_secs') else f'CAST({c} AS INTEGER) AS {c}' for c in LOG_COLS)} FROM user_logs",
                                         doubles=["total_secs"]))
def read_raw_csv_logs(spark, sf):
    """Raw daily logs with an index column and reversed columns, bound by name."""
    path = _as_csv(spark, fx.raw_user_logs(spark, sf), "raw_user_logs_csv")
    return io.read_raw_csv(spark, path, io.RAW_USER_LOGS, date_cols=("date",)).select(*LOG_COLS)


@query("read_raw_csv__members", O.with_base("SELECT msno, city, 30 AS bd, gender, registered_via, registration_init_time FROM members"))
def read_raw_csv_members(spark, sf):
    """Raw members with an index column in the middle, bound by name."""
    path = _as_csv(spark, fx.raw_members(spark, sf), "raw_members_csv")
    return io.read_raw_csv(spark, path, io.RAW_MEMBERS, date_cols=("registration_init_time",))


def _gold_layer(spark, sf):
    path = scratch_path(spark, "gold_feature_store")
    io.write_layer(gold(spark, sf), path, ["snapshot_month"])
    return path


_GOLD_CTE = "gold AS (" + _GOLD_SQL + ")"


@query("write_layer", O.with_base("SELECT * FROM gold", O.usage_block(1, False) + "," + _GOLD_CTE, GOLD_DOUBLES))
def write_layer(spark, sf):
    """Feature store written partitioned by month (dynamic overwrite) and read back whole."""
    return spark.read.parquet(_gold_layer(spark, sf))


@query("concat_months", O.with_base("SELECT * FROM gold", O.usage_block(1, False) + "," + _GOLD_CTE, GOLD_DOUBLES))
def concat_months(spark, sf):
    """All monthly partitions as one table: a single partitioned scan, no per-month union."""
    path = _gold_layer(spark, sf)
    return io.read_layer(spark, path)


@query("read_layer", O.with_base("""
SELECT * FROM gold WHERE snapshot_month IN (DATE '1998-01-01', DATE '1998-02-01')""",
                                 O.usage_block(1, False) + "," + _GOLD_CTE, GOLD_DOUBLES))
def read_layer(spark, sf):
    """Two months of the feature-store layer; the month filter prunes partitions at planning."""
    path = _gold_layer(spark, sf)
    return io.read_layer(spark, path, "snapshot_month", ["1998-01-01", "1998-02-01"])


@query("write_by_day", O.with_base("""
SELECT membership_expire_date, count(*) AS row_count FROM ms WHERE split = 'inference'
GROUP BY membership_expire_date""", O.usage_block(1, False) + "," + _MS))
def write_by_day(spark, sf):
    """Inference set fanned out to one partition per expiry day; rows per partition read back."""
    path = scratch_path(spark, "inference_by_day")
    io.write_by_day(model_set(spark, sf).where(F.col("split") == "inference"), path, "membership_expire_date")
    back = spark.read.parquet(path)
    return back.groupBy("membership_expire_date").agg(F.count(F.lit(1)).alias("row_count"))


@query("run_layers", O.with_base("""
SELECT split, CAST(count(*) AS BIGINT) AS row_count, CAST(sum(churn) AS BIGINT) AS churned FROM ms WHERE split IS NOT NULL GROUP BY 1""",
                                 O.usage_block(1, False) + "," + _MS))
def run_layers(spark, sf):
    """The layered run end to end; rows and churners of the three written model sets."""
    from renewcast.plans.medallion import run_layers as layers
    paths = layers(spark, fx.transactions(spark, sf), fx.user_logs(spark, sf), fx.members(spark, sf), scratch_path(spark, "layers"),
                   window=(fx.WINDOW_LO, fx.WINDOW_HI), burst_n=fx.BURST_THRESHOLD_ORDERS, secs_bounds=(fx.SECS_LO, fx.SECS_HI),
                   tail_end=fx.TAIL_END, tail_days=fx.TAIL_DAYS,
                   split_bounds=(fx.SPLIT_TRAIN_BEFORE, fx.SPLIT_OOT_END, fx.SPLIT_INFERENCE_AFTER))
    sets = [spark.read.parquet(f"{paths['model_set']}/{name}").select(F.lit(name).alias("split"), F.col("churn").cast("long").alias("churn"))
            for name in ("train", "oot", "inference")]
    return sets[0].unionByName(sets[1]).unionByName(sets[2]).groupBy("split").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("churn").alias("churned"))


@query("path_readiness", O.with_base("""
SELECT 'transactions' AS source, count(*) AS row_count, true AS "exists" FROM transactions UNION ALL SELECT 'user_logs', NULL, false"""))
def path_readiness(spark, sf):
    """A written layer and one that is not there: existence and row count from the paths."""
    path = scratch_path(spark, "ready")
    fx.transactions(spark, sf).write.parquet(path)
    return io.path_readiness(spark, {"transactions": path, "user_logs": path + "-missing"}, required=("transactions",))


@query("source_readiness", O.with_base("""
SELECT 'transactions' AS source, count(*) AS row_count FROM transactions UNION ALL
SELECT 'user_logs', count(*) FROM user_logs UNION ALL
SELECT 'members', count(*) FROM members"""))
def source_readiness(spark, sf):
    """Row count per required source in one job; a missing required source raises."""
    return io.source_readiness({"transactions": fx.transactions(spark, sf), "user_logs": fx.user_logs(spark, sf),
                                "members": fx.members(spark, sf)},
                               required=("transactions", "user_logs", "members"))


@query("month_readiness", O.with_base("""
SELECT CAST(s.m AS DATE) AS snapshot_month, coalesce(c.n, 0) AS row_count
FROM (SELECT unnest(generate_series(DATE '1995-01-01', DATE '2001-12-01', INTERVAL 1 MONTH)) AS m) s
LEFT JOIN (SELECT CAST(date_trunc('month', date) AS DATE) AS m, count(*) AS n FROM user_logs GROUP BY 1) c
  ON c.m = CAST(s.m AS DATE)"""))
def month_readiness(spark, sf):
    """Log rows per month on the 1995-01..2001-12 month spine; empty months show 0."""
    spine = io.month_spine(spark, "1995-01-01", "2001-12-01")
    return io.month_readiness(fx.user_logs(spark, sf), "date", spine)
