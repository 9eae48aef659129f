"""Label path: silver transactions -> renewal labels; member-level cancel/resume label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from renewcast.functions.scalar import (bin_by_edges, churn_flag, clamp_non_negative,
                                        discount_ratio, membership_start)
from renewcast.operators.filters import (drop_burst_users, drop_unresolved_tail,
                                         expire_on_or_after, membership_window)
from renewcast.operators.joins import overlay_update
from renewcast.operators.windows import first_cancel_and_resume, next_active_transaction

PERIOD_KEY = ("msno", "membership_start_date", "membership_expire_date")


def silver_transactions(tx: DataFrame, window: tuple[str, str] = ("2015-01-01", "2017-03-31"),
                        burst_n: int = 2, scope_cols: Sequence[str] = (),
                        with_discount: bool = True) -> DataFrame:
    """start date, burst-user filter (before the window, Q2), membership window, discount ratio."""
    t = tx.withColumn("membership_start_date",
                      membership_start("membership_expire_date", "payment_plan_days"))
    t = drop_burst_users(t, n=burst_n, user="msno", keys=("transaction_date", "is_cancel"),
                         scope_cols=scope_cols)
    t = membership_window(t, *window)
    if with_discount:
        t = t.withColumn("discount_ratio", discount_ratio("plan_list_price", "actual_amount_paid"))
    return t


def renewal_labels(tx: DataFrame, window: tuple[str, str] = ("2015-01-01", "2017-03-31"),
                   burst_n: int = 2, tail_end: str = "2017-03-31", tail_days: int = 5,
                   grace: int = 5, never_returned: int = 0,
                   tie_break: Sequence[str] = ("tx_id",), keep: Sequence[str] = (),
                   method: str = "lead") -> DataFrame:
    """Silver + gold label in one plan.

    For each non-cancelled 30/31-day period: the next non-cancelled transaction,
    ``days_diff`` clamped at 0, unresolved tail dropped, ``churn`` = gap > grace.
    ``never_returned=0`` reproduces the reference (Q1); 1 is the intended label.
    ``keep`` carries extra transaction columns (e.g. the tie-break) to the output.
    ``method="day_blocks"`` finds the next transaction without a window over a
    user's rows (see ``next_active_transaction``); the default ``lead`` window
    is bounded here because the burst filter caps a user's rows per day.
    Shuffles: one for the burst count, one by user for the window.
    """
    t = silver_transactions(tx, window, burst_n, scope_cols=(), with_discount=False)
    nxt = next_active_transaction(t, user="msno", tie_break=tie_break, method=method)
    out = nxt.select(*PERIOD_KEY, *keep, "next_transaction_date",
                     clamp_non_negative("days_diff").alias("days_diff"))
    out = drop_unresolved_tail(out, end=tail_end, days=tail_days)
    return out.withColumn("churn", churn_flag("days_diff", grace, never_returned))


def cancel_behaviour(tx: DataFrame, user: str = "msno", cancel_col: str = "is_cancel") -> DataFrame:
    """Users whose set of cancel values is exactly {0, 1} (null values and rows without a user are ignored)."""
    return (tx.where(F.col(cancel_col).isNotNull() & F.col(user).isNotNull()).groupBy(user)
            .agg(F.min(cancel_col).alias("_lo"), F.max(cancel_col).alias("_hi"))
            .where((F.col("_lo") == 0) & (F.col("_hi") == 1))
            .select(user))


def cancel_resume_gap(tx: DataFrame, user: str = "msno",
                      tie_break: Sequence[str] = ("tx_id",)) -> DataFrame:
    """Per cancel-and-resume user: cancelled expiry, resume date and the gap (clamped at 0).

    Kept only when the resumed period expires on or after the cancelled one.
    """
    users = cancel_behaviour(tx, user)
    t = tx.join(users, on=user, how="left_semi")
    r = first_cancel_and_resume(t, user=user, tie_break=tie_break)
    return (r.where(F.col("resume_expire") >= F.col("expire_date"))
            .select(user, "expire_date", "resume_date",
                    clamp_non_negative(F.datediff("resume_date", "expire_date")).alias("days_diff")))


def user_churn_label(tx: DataFrame, members: DataFrame, burst_n: int = 2,
                     expire_from: str = "2015-01-01", edges=(-1, 5, float("inf")),
                     labels=(0, 1), tie_break: Sequence[str] = ("tx_id",)) -> DataFrame:
    """Member-level label (notebook form): every member 0, cancel-and-resume users 1,
    then overwritten by the binned resume gap."""
    t = drop_burst_users(tx, n=burst_n)
    t = expire_on_or_after(t, expire_from)
    flagged = cancel_behaviour(t).withColumn("label", F.lit(1))
    gaps = cancel_resume_gap(t, tie_break=tie_break).select(
        "msno", bin_by_edges("days_diff", list(edges), list(labels)).alias("label"))
    flagged = overlay_update(flagged, gaps, key="msno", col="label")
    base = members.select("msno").withColumn("label", F.lit(0))
    return overlay_update(base, flagged, key="msno", col="label") \
        .withColumn("label", F.col("label").cast("int"))
