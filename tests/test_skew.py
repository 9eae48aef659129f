"""A key holding a third of the rows: results equal the naive formulations."""

import datetime as dt
from collections import Counter

from pyspark.sql import Window
from pyspark.sql import functions as F

from renewcast.functions.scalar import membership_start
from renewcast.operators import profiles as P
from renewcast.operators import windows as W
from renewcast.plans import features as FP

D0 = dt.date(2016, 1, 1)


def _tx(spark):
    rows = []
    for i in range(300):   # the hot user: a third of the transactions, 60 exact copies of one period
        d = D0 + dt.timedelta(days=(i % 240))
        if i < 60:
            d = D0
        rows.append(("hot", i, "41", 30, 100.0, 90.0, 1, d, d + dt.timedelta(days=30), 0))
    for i in range(600):
        d = D0 + dt.timedelta(days=(i * 7) % 300)
        rows.append((f"u{i % 50}", 1000 + i, "36", 31, 50.0, 50.0, 0, d, d + dt.timedelta(days=31), 0))
    df = spark.createDataFrame(rows, "msno string, tx_id long, payment_method_id string, payment_plan_days int, "
                                     "plan_list_price double, actual_amount_paid double, is_auto_renew int, "
                                     "transaction_date date, membership_expire_date date, is_cancel int")
    return df.withColumn("membership_start_date", membership_start("membership_expire_date", "payment_plan_days"))


def _logs(spark):
    rows = []
    for i in range(3000):
        u = "hot" if i % 3 == 0 else f"u{i % 50}"
        rows.append((u, D0 + dt.timedelta(days=i % 330), i % 4, i % 3, 0, 1, i % 5, 1 + i % 7, float(100 + i % 900)))
    return spark.createDataFrame(rows, "msno string, date date, num_25 int, num_50 int, num_75 int, num_985 int, "
                                       "num_100 int, num_unq int, total_secs double")


def _rows(df, cols):
    return Counter(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect())


def test_usage_with_hot_user_and_copies_equals_naive(spark):
    t, lg = _tx(spark), _logs(spark)
    ours = FP.usage_features(lg, t, lookback_months=None)
    # naive: every log row x every transaction row, grouped by the 10 columns (the reference's form)
    j = lg.join(t, (lg.msno == t.msno) & (lg.date >= t.membership_start_date) &
                (lg.date <= t.membership_expire_date)).drop(t.msno)
    songs = F.col("num_25") + F.col("num_50") + F.col("num_75") + F.col("num_985") + F.col("num_100")
    naive = j.groupBy("msno", "membership_start_date", "membership_expire_date", *FP.PERIOD_ATTRS).agg(
        F.sum(songs).alias("sum_songs"), F.round(F.sum("total_secs"), 6).alias("sum_total_secs"),
        F.round(F.coalesce(F.sum(F.when(F.datediff("date", "membership_start_date") < 7, F.col("total_secs"))),
                           F.lit(0.0)), 6).alias("total_secs_first_7_days"))
    cols = ["msno", "membership_start_date", "membership_expire_date", "sum_songs", "sum_total_secs",
            "total_secs_first_7_days"]
    assert _rows(ours, cols) == _rows(naive, cols)


def test_dedupe_first_on_hot_key_equals_row_number(spark):
    t = _tx(spark)
    key = ["msno", "membership_start_date", "membership_expire_date"]
    ours = W.dedupe_first(t, key, ["tx_id"])
    w = Window.partitionBy(*key).orderBy("tx_id")
    naive = t.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    assert _rows(ours, t.columns) == _rows(naive, t.columns)


def test_rank_and_sample_on_hot_class_equal_row_number(spark):
    df = spark.range(0, 9000).select(F.col("id").cast("string").alias("k"),
                                     F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.lit(0)).alias("y"))
    r = P.rank_in_class(df, "y", ["k"], 7)
    w = Window.partitionBy("y").orderBy("_h")
    naive = P.with_hash_key(df, ["k"], 7).withColumn("_rank", F.row_number().over(w))
    assert _rows(r, ["k", "y", "_rank"]) == _rows(naive, ["k", "y", "_rank"])
    s = P.sample_per_class(df, "y", ["k"], n=7, seed=7)
    assert _rows(s, ["k", "y"]) == _rows(naive.where("_rank <= 7"), ["k", "y"])


def test_next_active_day_blocks_equals_lead(spark):
    from sf_paths import SF_MID
    from renewcast.sources import fixtures as fx
    from renewcast.functions.scalar import membership_start
    t = fx.transactions(spark, SF_MID)
    t = t.withColumn("membership_start_date", membership_start("membership_expire_date", "payment_plan_days"))
    cols = ["tx_id", "next_transaction_date", "days_diff"]
    a = W.next_active_transaction(t)
    b = W.next_active_transaction(t, method="day_blocks")
    assert _rows(a, cols) == _rows(b, cols)
    # a hot user with many rows per day, ties on date and expiry, null expiries
    rows = []
    for i in range(400):
        d = D0 + dt.timedelta(days=i % 9)
        e = None if i % 37 == 0 else d + dt.timedelta(days=30 + i % 2)
        rows.append(("hot", i, "41", 30 + i % 2, 1.0, 1.0, 1, d, e, 1 if i % 5 == 0 else 0))
    h = spark.createDataFrame(rows, "msno string, tx_id long, payment_method_id string, payment_plan_days int, "
                                    "plan_list_price double, actual_amount_paid double, is_auto_renew int, "
                                    "transaction_date date, membership_expire_date date, is_cancel int")
    assert _rows(W.next_active_transaction(h), cols) == _rows(W.next_active_transaction(h, method="day_blocks"), cols)
