"""Row filters.

Every filter is a plain ``where`` so Catalyst can push it into the parquet
scan; the burst filter is an aggregate plus an anti join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from renewcast.functions.scalar import plan_days as _plan_days


def membership_window(df: DataFrame, lo: str = "2015-01-01", hi: str = "2017-03-31",
                      start: str = "membership_start_date",
                      expire: str = "membership_expire_date") -> DataFrame:
    """start >= lo and expire <= hi (rows with a null bound are dropped)."""
    return df.where((F.col(start) >= F.lit(lo).cast("date")) & (F.col(expire) <= F.lit(hi).cast("date")))


def expire_on_or_after(df: DataFrame, lo: str = "2015-01-01",
                       expire: str = "membership_expire_date") -> DataFrame:
    """Notebook variant of the window: expiry >= lo only."""
    return df.where(F.col(expire) >= F.lit(lo).cast("date"))


def valid_range(df: DataFrame, col: str = "total_secs", lo: float = -0.75e16,
                hi: float = 0.75e16) -> DataFrame:
    """lo <= col <= hi; nulls dropped."""
    return df.where((F.col(col) >= F.lit(lo)) & (F.col(col) <= F.lit(hi)))


def burst_users(df: DataFrame, n: int = 2, user: str = "msno",
                keys: Sequence[str] = ("transaction_date", "is_cancel"),
                scope_cols: Sequence[str] = ()) -> DataFrame:
    """Users (per scope) having more than ``n`` rows on any (keys) group.

    Null keys never form a group (the reference counted with pandas, which
    skips null group keys).  Partial aggregation before the shuffle keeps a
    hot user cheap: the exchange carries one row per (user, keys) per task.
    """
    group = [user, *scope_cols, *keys]
    notnull = None
    for k in group:
        cond = F.col(k).isNotNull()
        notnull = cond if notnull is None else notnull & cond
    return (
        df.where(notnull)
        .groupBy(*group).count()
        .where(F.col("count") > n)
        .select(user, *scope_cols).distinct()
    )


def drop_burst_users(df: DataFrame, n: int = 2, user: str = "msno",
                     keys: Sequence[str] = ("transaction_date", "is_cancel"),
                     scope_cols: Sequence[str] = ()) -> DataFrame:
    """Drop every row of a user who has more than ``n`` rows on one (keys) group.

    ``scope_cols=()`` applies it over the whole table (label path);
    ``("snapshot_month",)`` applies it per expiry month (feature path, Q2).
    The user set is joined back with a left anti join; AQE broadcasts it only
    after measuring it, otherwise it stays a sort-merge anti join.
    """
    bad = burst_users(df, n, user, keys, scope_cols)
    on = [user, *scope_cols]
    # null scope values never match an outlier group: keep those rows
    return df.join(bad, on=on, how="left_anti")


def plan_days_in(df: DataFrame, days: Sequence[int] = (30, 31),
                 start: str = "membership_start_date",
                 expire: str = "membership_expire_date") -> DataFrame:
    return df.where(_plan_days(start, expire).isin(list(days)))


def eligible_memberships(df: DataFrame, plan_col: str = "payment_plan_days",
                         cancel_col: str = "is_cancel", lo: int = 30, hi: int = 31) -> DataFrame:
    return df.where((F.col(plan_col) >= lo) & (F.col(plan_col) <= hi) & (F.col(cancel_col) == 0))


def drop_unresolved_tail(df: DataFrame, end: str = "2017-03-31", days: int = 5,
                         next_col: str = "next_transaction_date",
                         expire: str = "membership_expire_date") -> DataFrame:
    """Drop rows with no next transaction whose expiry is 0..days before ``end``."""
    gap = F.datediff(F.lit(end).cast("date"), F.col(expire))
    unresolved = F.col(next_col).isNull() & F.coalesce(gap.between(0, days), F.lit(False))
    return df.where(~unresolved)


def drop_null_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.dropna("any", subset=list(subset) if subset else None)


def split_column(start_col: str = "membership_start_date", train_before: str = "2016-11-01",
                 oot_end: str = "2016-11-30", inference_after: str = "2016-12-01"):
    """train: start < a; oot: a <= start <= b; inference: start > c; else null (Q5)."""
    s = F.col(start_col)
    a, b, c = (F.lit(x).cast("date") for x in (train_before, oot_end, inference_after))
    return (F.when(s < a, F.lit("train"))
            .when((s >= a) & (s <= b), F.lit("oot"))
            .when(s > c, F.lit("inference")))


def split_by_time(df: DataFrame, start_col: str = "membership_start_date",
                  train_before: str = "2016-11-01", oot_end: str = "2016-11-30",
                  inference_after: str = "2016-12-01", name: str = "split") -> DataFrame:
    """One pass: add the ``split`` column (null = in no set, counted, not dropped)."""
    return df.withColumn(name, split_column(start_col, train_before, oot_end, inference_after))


def snapshot_slice(df: DataFrame, date_col: str, month: str) -> DataFrame:
    """Rows whose date lies in ``month`` (first to last day, inclusive)."""
    m = F.lit(month).cast("date")
    return df.where((F.col(date_col) >= m) & (F.col(date_col) <= F.last_day(m)))
