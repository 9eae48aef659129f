"""Adapters that present the driver's test tables as the churn data model.

The same definitions exist as SQL CTEs in ``renewcast.oracle`` so that every
operator can be checked against DuckDB on identical inputs.

transactions <- orders left join per-order line-item totals
user_logs    <- lineitem join orders
members      <- customer
predictions  <- labels (hard 0/1) and lineitem (scored)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the fixture mapping (must equal the SQL CTEs).
PLAN_DAYS_BY_PRIORITY = {"1-URGENT": 7, "3-MEDIUM": 31, "5-LOW": 90}
DEFAULT_PLAN_DAYS = 30
PAYMENT_METHOD_BASE = 36
PAYMENT_METHOD_COUNT = 6
REGISTERED_VIA_COUNT = 12
REGISTRATION_ANCHOR = "1994-12-31"
REGISTRATION_SPREAD_DAYS = 365

# Constants of the fixture date range (the reference's defaults are in the
# operator signatures; these move them onto the 1995-2001 test data).
WINDOW_LO = "1995-01-01"
WINDOW_HI = "2001-06-30"
TAIL_END = "2001-06-30"
TAIL_DAYS = 30
SPLIT_TRAIN_BEFORE = "2000-11-01"
SPLIT_OOT_END = "2000-11-30"
SPLIT_INFERENCE_AFTER = "2000-12-01"
BURST_THRESHOLD_ORDERS = 1
BURST_THRESHOLD_EVENTS = 3
SECS_LO = 1000.0
SECS_HI = 90000.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan of one test table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transaction per order; ``tx_id`` (= o_orderkey) is the tie-break.

    The totals have one row per order, so they are what a task hashes to meet its orders; neither side is sorted."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    totals = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.sum("l_extendedprice").alias("lp"),
             F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("paid"))
    )
    plan = F.when(F.col("o_orderpriority") == "1-URGENT", 7) \
        .when(F.col("o_orderpriority") == "3-MEDIUM", 31) \
        .when(F.col("o_orderpriority") == "5-LOW", 90) \
        .otherwise(DEFAULT_PLAN_DAYS).cast("int")
    tdate = F.to_date("o_orderdate")
    return (
        o.join(totals.hint("shuffle_hash"), o.o_orderkey == totals.l_orderkey, "left")
        .select(
            F.col("o_custkey").cast("string").alias("msno"),
            F.col("o_orderkey").alias("tx_id"),
            (F.lit(PAYMENT_METHOD_BASE) + F.col("o_orderkey") % PAYMENT_METHOD_COUNT)
            .cast("string").alias("payment_method_id"),
            plan.alias("payment_plan_days"),
            F.round(F.coalesce(F.col("lp"), F.lit(0.0)), 2).alias("plan_list_price"),
            F.round(F.coalesce(F.col("paid"), F.lit(0.0)), 4).alias("actual_amount_paid"),
            (F.col("o_orderstatus") == "O").cast("int").alias("is_auto_renew"),
            tdate.alias("transaction_date"),
            F.date_add(tdate, plan).alias("membership_expire_date"),
            (F.col("o_orderstatus") == "F").cast("int").alias("is_cancel"),
        )
    )


def raw_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text variant: a stray pandas index column, dates as yyyyMMdd strings, columns in an order of their own."""
    t = transactions(spark, sf_dir)
    return t.select(
        F.col("tx_id").alias("Unnamed: 0"),
        F.date_format("membership_expire_date", "yyyyMMdd").alias("membership_expire_date"),
        *sorted(c for c in t.columns if c not in ("transaction_date", "membership_expire_date")),
        F.date_format("transaction_date", "yyyyMMdd").alias("transaction_date"),
    )


def raw_user_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text variant of the logs: index column first, columns reversed, yyyyMMdd dates."""
    u = user_logs(spark, sf_dir).withColumn("date", F.date_format("date", "yyyyMMdd"))
    return u.select(F.lit(0).alias("_c0"), *reversed(u.columns))


def raw_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text variant of the members, with the age column the layers drop."""
    m = members(spark, sf_dir).withColumn("registration_init_time", F.date_format("registration_init_time", "yyyyMMdd"))
    return m.select("registered_via", F.lit(30).alias("bd"), F.lit("7").alias("Unnamed: 0"), "gender", "registration_init_time", "msno", "city")


def user_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    # what the flags and the time are read for goes into the join, not their text
    kind = F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 2) \
        .when((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "F"), 3).otherwise(0)
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", kind.alias("kind"), F.to_date("l_shipdate").alias("date"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    r, a, nf = (F.col("kind") == k for k in (1, 2, 3))
    q = F.col("l_quantity").cast("int")
    ln = F.col("l_linenumber").cast("int")
    zero = F.lit(0)
    # the orders of a task are hashed: sorting the line items, the largest table, only to look up their user took longer than the join
    return li.join(o.hint("shuffle_hash"), li.l_orderkey == o.o_orderkey, "inner").select(
        F.col("o_custkey").cast("string").alias("msno"),
        "date",
        F.when(r, q).otherwise(zero).alias("num_25"),
        F.when(a, ln).otherwise(zero).alias("num_50"),
        F.when(nf, ln).otherwise(zero).alias("num_75"),
        F.when(r, ln).otherwise(zero).alias("num_985"),
        F.when(a, q).otherwise(zero).alias("num_100"),
        ln.alias("num_unq"),
        F.col("l_extendedprice").alias("total_secs"),
    )


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").cast("string").alias("msno"),
        F.col("c_nationkey").cast("string").alias("city"),
        F.when(F.col("c_mktsegment") != "HOUSEHOLD", F.col("c_mktsegment")).alias("gender"),
        (F.col("c_custkey") % REGISTERED_VIA_COUNT).cast("string").alias("registered_via"),
        F.date_sub(F.lit(REGISTRATION_ANCHOR).cast("date"),
                   (F.col("c_custkey") % REGISTRATION_SPREAD_DAYS).cast("int"))
        .alias("registration_init_time"),
    )


def hard_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(
        "doc_id", F.col("quality").cast("int").alias("y_true"),
        F.col("toxic").cast("int").alias("y_pred"))


def scored_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heavily tied scores: 11 distinct values."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        (F.col("l_returnflag") == "R").cast("int").alias("y_true"),
        F.round(F.col("l_discount") * 10, 2).alias("score"),
        F.to_date("l_shipdate").alias("day"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("user_id"),
        F.to_date("ts").alias("day"),
        "event_type")
