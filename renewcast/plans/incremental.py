"""Renewal labels kept up to date by batches of new days, without a window over all history.

A label needs one thing of the future: the user's next active transaction.  So the state holds one row per user, the last
active row if its period is eligible and still open, and the users known to be burst users.  A batch of whole days resolves the open rows
of the users it touches and leaves new ones.  The rows written per batch:

    labels/batch=<name>    rows resolved by this batch
    pending/batch=<name>   open rows after it, one per user at most
    burst/batch=<name>     burst users known after it

Each batch overwrites its own partitions and reads those of the batch before, so a repeated batch changes nothing, and a failed one
is run again.  Batches must follow each other in time; after a correction all later ones are run again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from renewcast.functions.scalar import churn_flag, clamp_non_negative, membership_start
from renewcast.operators.filters import burst_users, drop_unresolved_tail, membership_window
from renewcast.plans.labels import PERIOD_KEY

_OPEN = ("msno", "transaction_date", "membership_start_date", "membership_expire_date", "payment_plan_days")


def _part(root: str, table: str, batch: str) -> str:
    return f"{root.rstrip('/')}/{table}/batch={batch}"


def advance_labels(spark: SparkSession, root: str, batch: str, rows: DataFrame, before: str | None,
                   window: tuple[str, str] = ("2015-01-01", "2017-03-31"), burst_n: int = 2, plan_lo: int = 30, plan_hi: int = 31,
                   tie_break: Sequence[str] = ("tx_id",)) -> None:
    """Takes in one batch of transactions (whole days, all later than those of the batch ``before``).  Rows without a user or a
    date get no label, as in the batch form."""
    t = rows.withColumn("membership_start_date", membership_start("membership_expire_date", "payment_plan_days"))
    kinds = {f.name: f.dataType.simpleString() for f in t.schema}
    columns = [*_OPEN, *tie_break]
    known = burst_users(t, burst_n)
    if before is not None:
        known = known.unionByName(spark.read.parquet(_part(root, "burst", before))).distinct()
    known.write.mode("overwrite").parquet(_part(root, "burst", batch))

    active = membership_window(t, *window).where("msno IS NOT NULL AND transaction_date IS NOT NULL AND is_cancel = 0").select(*columns)
    if before is not None:
        old = spark.read.schema(", ".join(f"{c} {kinds[c]}" for c in columns)).parquet(_part(root, "pending", before))
        touched = old.join(active.select("msno").distinct(), "msno", "left_semi")
        kept = old.join(active.select("msno").distinct(), "msno", "left_anti")
        active = active.unionByName(touched)
    order = Window.partitionBy("msno").orderBy("transaction_date", F.col("membership_expire_date").asc_nulls_last(),
                                               *[F.col(c).asc_nulls_last() for c in tie_break])
    # a user's rows of this batch and one open row: bounded by the days of a batch
    seen = active.withColumn("next_transaction_date", F.lead("transaction_date").over(order)) \
        .where(F.col("payment_plan_days").between(plan_lo, plan_hi))
    done = seen.where("next_transaction_date IS NOT NULL").select(
        *PERIOD_KEY, *tie_break, "next_transaction_date", clamp_non_negative(F.datediff("next_transaction_date", "membership_expire_date")).alias("days_diff"))
    done.write.mode("overwrite").parquet(_part(root, "labels", batch))
    left = seen.where("next_transaction_date IS NULL").select(*columns)
    if before is not None:
        left = left.unionByName(kept)
    left.write.mode("overwrite").parquet(_part(root, "pending", batch))


def labels_as_of(spark: SparkSession, root: str, batches: Sequence[str], tail_end: str = "2017-03-31", tail_days: int = 5, grace: int = 5,
                 never_returned: int = 0, tie_break: Sequence[str] = ("tx_id",)) -> DataFrame:
    """The labels after the last of ``batches`` (in order): resolved rows and open ones, without burst users; as ``renewal_labels`` gives them."""
    done = spark.read.parquet(*[_part(root, "labels", b) for b in batches])
    left = spark.read.parquet(_part(root, "pending", batches[-1])).select(
        *PERIOD_KEY, *tie_break, F.lit(None).cast("date").alias("next_transaction_date"), F.lit(None).cast("int").alias("days_diff"))
    every = done.select(*left.columns).unionByName(left).join(spark.read.parquet(_part(root, "burst", batches[-1])), "msno", "left_anti")
    out = drop_unresolved_tail(every.select(*left.columns), end=tail_end, days=tail_days)
    return out.withColumn("churn", churn_flag("days_diff", grace, never_returned))
