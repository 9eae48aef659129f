"""Joins.

No explicit ``broadcast()`` of a data-sized side here.  AQE measures the
build side at run time and switches to a broadcast hash join only below
``spark.sql.adaptive.autoBroadcastJoinThreshold``; otherwise it stays a
sort-merge join, and skewed partitions are split by the AQE skew-join rule.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from renewcast.operators.sketches import bit_filter, filter_bits, may_contain
from renewcast.session import written, written_buckets

PERIOD_KEY = ["msno", "membership_start_date", "membership_expire_date"]


def interval_join(logs: DataFrame, periods: DataFrame, user: str = "msno", date: str = "date",
                  start: str = "membership_start_date", expire: str = "membership_expire_date",
                  lookback_months: int | None = None, prefilter: bool = False) -> DataFrame:
    """Inner join of every log row to every period of its user with start <= date <= expire.

    The equi key is (user, quarter): each period is exploded into the calendar
    quarters it touches (a plan of up to 90 days gives 1-2 rows), the log row carries its
    own quarter, and the exact range is the residual predicate.  Compared with
    an equi join on the user alone, a heavy user is split into one join key
    per quarter and the residual only sees periods overlapping that quarter.
    Each task hashes its periods (few rows a user and quarter) and passes its logs by them, so the logs are not sorted; AQE
    splits the logs of a skewed partition as in a sort-merge join.

    ``lookback_months=k`` reproduces the monthly partitioning of the
    reference (Q11): a period expiring in month M only sees logs from months
    M-k .. M, i.e. the lower bound becomes max(start, first of month M-k).

    ``prefilter=True`` builds a bit filter of the users that have periods (one aggregate, at most 8 MB) and tests the logs
    against it in their scan, so that logs of other users are not shuffled; the result is the same.
    """
    if prefilter:
        users = periods.select(user)
        bits = filter_bits(users, user)
        logs = logs.where(may_contain(user, written(bit_filter(users, user, bits), "user_bits"), bits))
    lo = F.col(start)
    if lookback_months is not None:
        lo = F.greatest(lo, F.add_months(F.trunc(F.col(expire), "MM"), -int(lookback_months)))
    p = (periods.where(lo <= F.col(expire))
         .withColumn("_q", F.explode(F.sequence(F.trunc(lo, "QUARTER"), F.trunc(F.col(expire), "QUARTER"),
                                                F.expr("INTERVAL 3 MONTHS")))))
    lg = logs.withColumn("_q", F.trunc(F.col(date), "QUARTER"))
    # the lower bound is computed again from the period: no column of its own is dealt out
    return lg.join(p.hint("shuffle_hash"), on=[user, "_q"], how="inner").where((F.col(date) >= lo) & (F.col(date) <= F.col(expire))).drop("_q")


def feature_join(tx: DataFrame, features: DataFrame, keys: Sequence[str] = PERIOD_KEY) -> DataFrame:
    """Transactions x period features on the period key; duplicate keys fan out (Q3)."""
    return tx.join(features, on=list(keys), how="inner")


def member_join(df: DataFrame, members: DataFrame, user: str = "msno") -> DataFrame:
    return df.join(members, on=user, how="inner")


@contextmanager
def co_partitioned(spark: SparkSession) -> Iterator[None]:
    """While plans are made and run inside, tables bucketed by one of several join keys count as dealt out for all of them."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name, "true")
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def join_buckets(tx: DataFrame, features: DataFrame, members: DataFrame, user: str = "msno", keys: Sequence[str] = PERIOD_KEY) -> DataFrame:
    """Both gold joins over layers bucketed by user alike: no exchange (inside ``co_partitioned``)."""
    return member_join(feature_join(tx, features, keys), members, user)


def bucketed_feature_store(tx: DataFrame, features: DataFrame, members: DataFrame, user: str = "msno", keys: Sequence[str] = PERIOD_KEY,
                           buckets: int | None = None) -> DataFrame:
    """``feature_join`` and ``member_join`` over layers written bucketed and sorted by user: each layer is dealt out once, when it
    is written, and every later join of it reads its buckets in place.

    A bucket cannot be split, so users with more than a bucket's even share of the transactions (fewer users than buckets, a broadcast list)
    go through the ordinary joins, which AQE splits; rows without a user join nothing.  The result is written."""
    spark = tx.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tx = written(tx.where(F.col(user).isNotNull()), "store_transactions")
    counts = tx.groupBy(user).agg(F.count(F.lit(1)).alias("_n"))
    share = F.lit(max(1, tx.count() // buckets))
    hot = written(counts.where(F.col("_n") > share).select(user), "hot_users")
    some = not hot.isEmpty()
    few = F.broadcast(hot)
    layers = [written_buckets(x.join(few, user, "left_anti") if some else x, f"by_user_{name}", user, buckets)
              for name, x in (("transactions", tx), ("features", features), ("members", members))]
    with co_partitioned(spark):
        out = written(join_buckets(*layers, user, keys), "feature_store")
    if some:
        parts = [x.join(few, user, "left_semi") for x in (tx, features, members)]
        out = out.unionByName(written(join_buckets(*parts, user, keys), "feature_store_hot"))
    return out


def label_feature_join(labels: DataFrame, features: DataFrame,
                       keys: Sequence[str] = PERIOD_KEY) -> DataFrame:
    """labels LEFT JOIN features, then drop rows with any null (= inner join + null drop)."""
    return labels.join(features, on=list(keys), how="left").dropna("any")


def semi_filter(df: DataFrame, keys: DataFrame, on: str | Sequence[str] = "msno") -> DataFrame:
    return df.join(keys, on=on, how="left_semi")


def overlay_update(base: DataFrame, patch: DataFrame, key: str | Sequence[str], col: str) -> DataFrame:
    """Replace ``base[col]`` where ``patch`` has the key and a non-null value.

    Keys only in ``patch`` are ignored (pandas ``DataFrame.update``).  ``patch``
    must be unique on the key.
    """
    keys = [key] if isinstance(key, str) else list(key)
    p = patch.select(*keys, F.col(col).alias("_patch"))
    out = base.join(p, on=keys, how="left")
    return out.withColumn(col, F.coalesce(F.col("_patch"), F.col(col))).drop("_patch")
