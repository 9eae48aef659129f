"""Label-path queries: renewal labels, next transaction, cancel/resume, member label."""

from __future__ import annotations

from pyspark.sql import functions as F

from renewcast import oracle as O
from renewcast.plans import labels as L
from renewcast.registry import query
from renewcast.sources import fixtures as fx

W = (fx.WINDOW_LO, fx.WINDOW_HI)


def _labels(spark, sf, never, method="lead"):
    tx = fx.transactions(spark, sf)
    return L.renewal_labels(tx, window=W, burst_n=fx.BURST_THRESHOLD_ORDERS, tail_end=fx.TAIL_END,
                            tail_days=fx.TAIL_DAYS, grace=5, never_returned=never, method=method)


_LABEL_SQL = """
SELECT msno, membership_start_date, membership_expire_date, next_transaction_date, days_diff,
       CASE WHEN days_diff IS NULL THEN {never} WHEN days_diff > 5 THEN 1 ELSE 0 END AS churn
FROM label_silver"""


@query("renewal_labels", O.with_base(_LABEL_SQL.format(never=0)), headline=True)
def renewal_labels(spark, sf):
    """Silver + gold renewal label, reference parity (never returned -> 0, Q1)."""
    return _labels(spark, sf, 0)


@query("renewal_labels__never0", O.with_base(_LABEL_SQL.format(never=0)))
def renewal_labels_never0(spark, sf):
    return _labels(spark, sf, 0)


@query("renewal_labels__never1", O.with_base(_LABEL_SQL.format(never=1)))
def renewal_labels_never1(spark, sf):
    """Intended label: a member who never returns has churned."""
    return _labels(spark, sf, 1)


@query("renewal_labels__day_blocks", O.with_base(_LABEL_SQL.format(never=0)))
def renewal_labels_day_blocks(spark, sf):
    """Same labels; the next transaction found without a per-user window (hot-user safe)."""
    return _labels(spark, sf, 0, method="day_blocks")


def _without_some_users(spark, sf):
    """Transactions in which every seventh user's id is missing."""
    return fx.transactions(spark, sf).withColumn("msno", F.when(F.col("msno").cast("long") % 7 != 0, F.col("msno")))


@query("renewal_labels__null_users", O.with_base(_LABEL_SQL.format(never=0) + " WHERE CAST(msno AS BIGINT) % 7 <> 0"))
def renewal_labels_null_users(spark, sf):
    """Rows without a user get no label and change nobody else's."""
    return L.renewal_labels(_without_some_users(spark, sf), window=W, burst_n=fx.BURST_THRESHOLD_ORDERS, tail_end=fx.TAIL_END,
                            tail_days=fx.TAIL_DAYS, grace=5)


@query("renewal_labels__by_batches", O.with_base(_LABEL_SQL.format(never=0)))
def renewal_labels_by_batches(spark, sf):
    """The same labels, kept up to date year by year from one open row per user; one year is taken in twice."""
    from renewcast.plans import incremental as I
    from renewcast.session import scratch_path, written
    tx = written(fx.transactions(spark, sf), "dated_transactions")
    years = [str(r[0]) for r in tx.select(F.year("transaction_date")).where("transaction_date IS NOT NULL").distinct().orderBy(F.year("transaction_date")).collect()]
    root, before = scratch_path(spark, "label_state"), None
    for y in years:
        rows = tx.where(F.year("transaction_date") == int(y))
        for _ in range(2 if y == years[len(years) // 2] else 1):
            I.advance_labels(spark, root, y, rows, before, W, fx.BURST_THRESHOLD_ORDERS)
        before = y
    return I.labels_as_of(spark, root, years, fx.TAIL_END, fx.TAIL_DAYS, 5, 0).drop("tx_id")


@query("churn_by_month", O.with_base("""
SELECT CAST(date_trunc('month', membership_expire_date) AS DATE) AS snapshot_month,
       count(*) AS n_periods, CAST(sum(churn) AS BIGINT) AS n_churn
FROM (SELECT *, CASE WHEN days_diff IS NULL THEN 0 WHEN days_diff > 5 THEN 1 ELSE 0 END AS churn
      FROM label_silver) x
GROUP BY 1"""))
def churn_by_month(spark, sf):
    """Flagship: churn counts per expiry month on top of the renewal labels."""
    lab = _labels(spark, sf, 0)
    return (lab.groupBy(F.trunc("membership_expire_date", "MM").alias("snapshot_month"))
            .agg(F.count(F.lit(1)).alias("n_periods"), F.sum("churn").cast("bigint").alias("n_churn")))


@query("next_active_transaction", O.with_base("""
SELECT msno, membership_start_date, membership_expire_date, next_transaction_date,
       CAST(datediff('day', membership_expire_date, next_transaction_date) AS INTEGER) AS days_diff
FROM next_tx WHERE payment_plan_days BETWEEN 30 AND 31"""))
def next_active_transaction(spark, sf):
    t = L.silver_transactions(fx.transactions(spark, sf), W, fx.BURST_THRESHOLD_ORDERS,
                              with_discount=False)
    from renewcast.operators.windows import next_active_transaction as nat
    return nat(t).select("msno", "membership_start_date", "membership_expire_date",
                         "next_transaction_date", "days_diff")


_NB_TX = f"""
nb_tx AS (
  SELECT * FROM transactions t
  WHERE NOT EXISTS (SELECT 1 FROM burst_all b WHERE b.msno = t.msno)
    AND membership_expire_date >= DATE '{fx.WINDOW_LO}'),
nb_users AS (
  SELECT msno FROM nb_tx WHERE is_cancel IS NOT NULL GROUP BY msno
  HAVING min(is_cancel) = 0 AND max(is_cancel) = 1),
nb_first_cancel AS (
  SELECT msno, arg_min(transaction_date, (transaction_date, tx_id)) AS cancel_date,
         arg_min(membership_expire_date, (transaction_date, tx_id)) AS expire_date
  FROM nb_tx WHERE is_cancel = 1 AND msno IN (SELECT msno FROM nb_users) GROUP BY msno),
nb_resume AS (
  SELECT c.msno, c.expire_date,
         arg_min(t.transaction_date, (t.transaction_date, t.tx_id)) AS resume_date,
         arg_min(t.membership_expire_date, (t.transaction_date, t.tx_id)) AS resume_expire
  FROM nb_first_cancel c JOIN nb_tx t
    ON t.msno = c.msno AND t.is_cancel = 0 AND t.transaction_date >= c.cancel_date
  GROUP BY c.msno, c.expire_date),
nb_gap AS (
  SELECT msno, expire_date, resume_date,
         CASE WHEN d < 0 THEN 0 ELSE d END AS days_diff
  FROM (SELECT *, CAST(datediff('day', expire_date, resume_date) AS INTEGER) AS d FROM nb_resume
        WHERE resume_expire >= expire_date) x)"""


def _nb_tx(spark, sf):
    from renewcast.operators.filters import drop_burst_users, expire_on_or_after
    tx = fx.transactions(spark, sf)
    return expire_on_or_after(drop_burst_users(tx, n=fx.BURST_THRESHOLD_ORDERS), fx.WINDOW_LO)


@query("cancel_behaviour", O.with_base("SELECT msno FROM nb_users", _NB_TX))
def cancel_behaviour(spark, sf):
    """Users whose cancel values are exactly {0, 1}."""
    return L.cancel_behaviour(_nb_tx(spark, sf))


@query("cancel_resume_gap", O.with_base("SELECT * FROM nb_gap", _NB_TX))
def cancel_resume_gap(spark, sf):
    return L.cancel_resume_gap(_nb_tx(spark, sf))


@query("user_churn_label", O.with_base("""
SELECT m.msno,
       CAST(CASE WHEN u.msno IS NULL THEN 0
                 WHEN g.msno IS NOT NULL AND g.days_diff > 5 THEN 1
                 WHEN g.msno IS NOT NULL AND g.days_diff > -1 THEN 0
                 ELSE 1 END AS INTEGER) AS label
FROM members m
LEFT JOIN nb_users u ON u.msno = m.msno
LEFT JOIN nb_gap g ON g.msno = m.msno""", _NB_TX))
def user_churn_label(spark, sf):
    """Member-level label: 0 for all, 1 for cancel-and-resume users, overwritten by the binned gap."""
    return L.user_churn_label(fx.transactions(spark, sf), fx.members(spark, sf),
                              burst_n=fx.BURST_THRESHOLD_ORDERS, expire_from=fx.WINDOW_LO)


@query("overlay_update", O.with_base("""
SELECT m.msno, CAST(coalesce(u.label, 0) AS INTEGER) AS label
FROM members m LEFT JOIN (SELECT msno, 1 AS label FROM nb_users) u ON u.msno = m.msno""", _NB_TX))
def overlay_update(spark, sf):
    """Members' label 0 overwritten where the patch (cancel-and-resume users, 1) has the key."""
    from renewcast.operators.joins import overlay_update as ou
    base = fx.members(spark, sf).select("msno").withColumn("label", F.lit(0))
    patch = L.cancel_behaviour(_nb_tx(spark, sf)).withColumn("label", F.lit(1))
    return ou(base, patch, "msno", "label").withColumn("label", F.col("label").cast("int"))
