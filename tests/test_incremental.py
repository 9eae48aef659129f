"""Labels kept up by batches of days against the batch form."""
import random

from pyspark.sql import functions as F

from renewcast.plans import incremental as I
from renewcast.plans import labels as L
from renewcast.session import scratch_path

WINDOW = ("2020-01-01", "2021-12-31")
COLS = ["msno", "membership_start_date", "membership_expire_date", "next_transaction_date", "days_diff", "churn"]


def transactions(spark, seed, users=25, n=320):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        user = None if rng.random() < 0.04 else f"u{rng.randrange(users)}"
        rows.append((user, f"2020-0{rng.randrange(1, 7)}-{rng.randrange(1, 25):02d}", rng.choice([30, 30, 31, 7, 90]), int(rng.random() < 0.15), i))
    rows += [("hot", "2020-03-03", 30, 0, 1000 + k) for k in range(4)] + [("hot", "2020-01-05", 30, 0, 2000)]      # a burst user found late
    rows += [("nodate", None, 30, 0, 3000)]
    df = spark.createDataFrame(rows, "msno string, transaction_date string, payment_plan_days int, is_cancel int, tx_id long")
    d = F.col("transaction_date").cast("date")
    return df.withColumn("transaction_date", d).withColumn("membership_expire_date", F.date_add(d, F.col("payment_plan_days")))


def by_batches(spark, tx, months, again=()):
    root, before = scratch_path(spark, "test_labels"), None
    for m in months:
        rows = tx.where(F.date_format("transaction_date", "yyyy-MM") == m)
        for _ in range(2 if m in again else 1):
            I.advance_labels(spark, root, m, rows, before, WINDOW, 2)
        before = m
    return I.labels_as_of(spark, root, months, "2020-07-20", 5, 5, 1)


def as_rows(df):
    return sorted((tuple(str(r[c]) for c in COLS) for r in df.collect()))


def test_batches_give_the_labels_of_the_whole(spark):
    tx = transactions(spark, 3).repartition(3).cache()
    want = as_rows(L.renewal_labels(tx.where("transaction_date IS NOT NULL"), WINDOW, 2, "2020-07-20", 5, 5, 1))
    months = [f"2020-0{m}" for m in range(1, 7)]
    got = by_batches(spark, tx, months, again=("2020-02", "2020-06"))
    assert as_rows(got) == want and len(want) > 100
    assert not [r for r in want if r[0] in ("hot", "nodate", "None")]


def test_an_empty_day_changes_nothing(spark):
    tx = transactions(spark, 4).where("transaction_date < '2020-03-01'")
    a = by_batches(spark, tx, ["2020-01", "2020-02"])
    b = by_batches(spark, tx, ["2020-01", "2020-02", "2020-03"])
    assert as_rows(a) == as_rows(b)
