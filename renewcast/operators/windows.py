"""Window-style operators and the distributed running sum.

Scale rules followed here:

* a "first row per key" is an aggregate (``min_by`` over a struct), not a
  ``row_number`` window, so partial aggregation keeps a group of a billion
  copies down to one candidate per task before the shuffle;
* a running sum over a whole column (ROC, Pareto, ranks, exact quantiles) is
  never a window without ``partitionBy``: rows are dealt into even blocks by range
  of the whole sort key, each block is summed on its own, and the
  per-block offsets are joined back;
* ``lead`` over a user is used only where the partition size is bounded by the
  preceding filters (see ``next_active_transaction``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from renewcast.session import written

HASH_DIGITS = 4      # 16^4 = 65,536 hash blocks


def _sort_col(c: str | Column, descending: bool = False) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    return x.desc_nulls_last() if descending else x.asc_nulls_first()


def hash_blocks(hex_col: str | Column, digits: int = HASH_DIGITS) -> Column:
    """Block id from the leading hex digits of an md5 string (uniform, monotone)."""
    x = F.col(hex_col) if isinstance(hex_col, str) else hex_col
    return F.conv(F.substring(x, 1, digits), 16, 10).cast("int")


def order_blocks(df: DataFrame, order: Sequence[Column], group: Sequence[str] = (), blocks: int | None = None) -> DataFrame:
    """Rows with ``_blk``, an id that rises with (group, order): the rows are dealt out by range over
    the whole sort key and written, and the block is the range.

    Ranges come from a sample of the rows themselves, so blocks are even however the values are spread, and ties of the
    first order key are split by the next one.  ``blocks`` defaults to the session's shuffle
    partitions, so it follows the size the job was set up for.
    """
    n = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*[F.col(g).asc_nulls_first() for g in group], *order]
    return written(df.repartitionByRange(n, *keys).withColumn("_blk", F.spark_partition_id()), "order_blocks")


def running_sum(df: DataFrame, order: Sequence[str | Column], values: Sequence[str],
                group: Sequence[str] = (), descending: bool = False,
                block: Column | None = None, suffix: str = "_cum",
                with_total: bool = False, blocks: int | None = None) -> DataFrame:
    """Inclusive running sums of ``values`` within ``group`` in ``order``.

    ``order`` holds column names (sorted ascending, or descending when
    ``descending``) or ready sort expressions.  It must be a total order within
    the group (callers aggregate to one row per distinct order value first).
    Blocks come from ``order_blocks``, which runs the plan of ``df`` and writes its rows;
    a caller may pass its own ``block`` instead, which must be monotone in the order.
    Every window is partitioned by (group, block), so no task holds more than one block of one
    group; the offsets table has one row per (group, block).
    ``with_total`` adds ``<value>_total``, the group total, without a cross join.
    """
    order, group = list(order), list(group)
    sort = [(_sort_col(c, descending) if isinstance(c, str) else c) for c in order]
    d = order_blocks(df, sort, group, blocks) if block is None else df.withColumn("_blk", block)
    totals = d.groupBy(*group, "_blk").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    before = (Window.partitionBy(*group).orderBy("_blk")
              .rowsBetween(Window.unboundedPreceding, -1))
    whole = Window.partitionBy(*group)
    extra = [F.sum(f"_t_{v}").over(whole).alias(f"{v}_total") for v in values] if with_total else []
    offsets = totals.select(
        *group, "_blk",
        *[F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_o_{v}") for v in values],
        *extra)
    if not group and block is None:
        # one row per block, and there are as many blocks as range partitions
        offsets = F.broadcast(offsets)
    w = (Window.partitionBy(*group, "_blk").orderBy(*sort)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    if group:
        # null-safe on the group columns: a null group is a group of its own
        offsets = offsets.select(*[F.col(g).alias(f"_g_{g}") for g in group],
                                 *[c for c in offsets.columns if c not in group])
        cond = d["_blk"] == offsets["_blk"]
        for g in group:
            cond = cond & d[g].eqNullSafe(offsets[f"_g_{g}"])
        out = d.join(offsets, cond, "inner").drop(offsets["_blk"]).drop(*[f"_g_{g}" for g in group])
    else:
        out = d.join(offsets, on="_blk", how="inner")
    for v in values:
        out = out.withColumn(f"{v}{suffix}", F.sum(v).over(w) + F.col(f"_o_{v}"))
    return out.drop("_blk", *[f"_o_{v}" for v in values])


def next_active_transaction(tx: DataFrame, user: str = "msno",
                            order: Sequence[str] = ("transaction_date", "membership_expire_date"),
                            tie_break: Sequence[str] = ("tx_id",), cancel_col: str = "is_cancel",
                            date_col: str = "transaction_date", plan_col: str = "payment_plan_days",
                            plan_lo: int = 30, plan_hi: int = 31,
                            expire: str = "membership_expire_date", method: str = "lead") -> DataFrame:
    """For each non-cancelled ``plan_lo..plan_hi``-day row: the user's next non-cancelled
    transaction date in (order, tie_break) order and ``days_diff = next - expire``.

    ``lead`` over the non-cancelled rows gives the first later non-cancelled
    row in one pass (the reference's per-row forward scan is quadratic).  The
    per-user window is bounded: after ``drop_burst_users`` a user has at most
    2 * n rows per day, and the membership window bounds the days.  Rows without a user are dropped.
    """
    if not tie_break:
        raise ValueError("a tie_break column is required for a repeatable order")
    tx = tx.where(F.col(user).isNotNull())
    if method == "day_blocks":
        return _next_active_by_days(tx, user, order, tie_break, cancel_col, date_col, plan_col,
                                    plan_lo, plan_hi, expire)
    w = Window.partitionBy(user).orderBy(
        *[F.col(c).asc_nulls_last() for c in order], *[F.col(c).asc_nulls_last() for c in tie_break])
    nc = tx.where(F.col(cancel_col) == 0)
    nxt = nc.withColumn("next_transaction_date", F.lead(date_col).over(w))
    elig = nxt.where((F.col(plan_col) >= plan_lo) & (F.col(plan_col) <= plan_hi))
    return elig.withColumn("days_diff", F.datediff("next_transaction_date", expire))


def _next_active_by_days(tx, user, order, tie_break, cancel_col, date_col, plan_col, plan_lo, plan_hi, expire):
    """Same result as the ``lead`` form without a window over a user's rows.

    The order is (date, rest..., tie).  A row that is not the last of its
    (user, date) group is followed by a row of the same date; the last row of a
    group is followed by the first row of the user's next date that has rows.
    So: one partial aggregate gives each (user, date) group its last row, and
    ``lead`` runs over the distinct (user, date) pairs only -- at most one row
    per calendar day per user, however many transactions a user has.
    """
    rest = [c for c in order if c != date_col]
    # in-day order key with nulls last, as in the row order of the lead form
    key = F.struct(*[x for c in (*rest, *tie_break) for x in (F.col(c).isNull(), F.col(c))])
    nc = tx.where(F.col(cancel_col) == 0).withColumn("_k", key)
    days = nc.where(F.col(date_col).isNotNull()).groupBy(user, date_col).agg(F.max("_k").alias("_last"))
    w = Window.partitionBy(user).orderBy(F.col(date_col).asc())
    days = days.withColumn("_next_day", F.lead(date_col).over(w))
    elig = nc.where((F.col(plan_col) >= plan_lo) & (F.col(plan_col) <= plan_hi))
    j = elig.join(days, on=[user, date_col], how="left")
    nxt = F.when(F.col(date_col).isNull(), F.lit(None).cast("date")) \
        .when(F.col("_k") < F.col("_last"), F.col(date_col)) \
        .otherwise(F.col("_next_day"))
    return j.withColumn("next_transaction_date", nxt) \
        .withColumn("days_diff", F.datediff("next_transaction_date", expire)) \
        .drop("_k", "_last", "_next_day")


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the first row per ``keys`` in ``order`` (which must make rows unique).

    ``min_by`` over a struct is a partial aggregate: a key with a billion
    copies is reduced inside every map task, never gathered into one window.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.select(*keys).distinct()
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*[F.col(c) for c in rest]), F.struct(*[F.col(c) for c in order])).alias("_r"))
    return picked.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def pareto(counts: DataFrame, key: str = "transaction_count", count_col: str = "counts") -> DataFrame:
    """Running sum and running share over count-of-counts ordered by ``key``."""
    rs = running_sum(counts, [key], [count_col], with_total=True)
    return rs.select(key, count_col, F.col(f"{count_col}_cum").alias("cumsum"),
                     (F.col(f"{count_col}_cum") / F.col(f"{count_col}_total")).alias("proportion"))


def category_coverage(df: DataFrame, col: str) -> DataFrame:
    """Categories by descending count (ties by value) with share and cumulative percent.

    Nulls are excluded, as pandas ``value_counts`` does.
    """
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    rs = running_sum(counts, [F.col("n").desc(), F.col(col).asc()], ["n"],
                     with_total=True)
    return rs.select(col, F.col("n").alias("count"), (F.col("n") / F.col("n_total")).alias("share"),
                     (F.col("n_cum") * 100.0 / F.col("n_total")).alias("cum_pct"))


def first_argmax(df: DataFrame, metric: str, order: Sequence[str]) -> DataFrame:
    """First row in ``order`` having the largest ``metric`` (top-1: TakeOrdered, no global sort)."""
    return df.orderBy(F.col(metric).desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in order]).limit(1)


def first_cancel_and_resume(tx: DataFrame, user: str = "msno", date_col: str = "transaction_date",
                            expire: str = "membership_expire_date", cancel_col: str = "is_cancel",
                            tie_break: Sequence[str] = ("tx_id",)) -> DataFrame:
    """Per user: first cancel row, then first non-cancel row dated on/after it.

    Two partial aggregates (``min_by``) and one equi join on the user whose
    right side has one row per user, so no pairs are emitted.
    """
    ordk = F.struct(F.col(date_col), *[F.col(c) for c in tie_break])
    cancels = (tx.where(F.col(cancel_col) == 1)
               .groupBy(user)
               .agg(F.min_by(F.struct(F.col(date_col).alias("cancel_date"),
                                      F.col(expire).alias("expire_date")), ordk).alias("_c"))
               .select(user, "_c.cancel_date", "_c.expire_date"))
    later = (tx.where(F.col(cancel_col) == 0).join(cancels, on=user, how="inner")
             .where(F.col(date_col) >= F.col("cancel_date")))
    resumes = (later.groupBy(user, "cancel_date", "expire_date")
               .agg(F.min_by(F.struct(F.col(date_col).alias("resume_date"),
                                      F.col(expire).alias("resume_expire")), ordk).alias("_r"))
               .select(user, "cancel_date", "expire_date", "_r.resume_date", "_r.resume_expire"))
    return resumes
