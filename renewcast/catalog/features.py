"""Feature-path queries: silver layers, interval join, usage features, feature store."""

from __future__ import annotations

from pyspark.sql import functions as F

from renewcast import oracle as O
from renewcast.operators import filters as flt
from renewcast.operators import joins as J
from renewcast.plans import features as FP
from renewcast.plans import labels as L
from renewcast.registry import query
from renewcast.sources import fixtures as fx
from renewcast.sources import io

W = (fx.WINDOW_LO, fx.WINDOW_HI)
SECS = (fx.SECS_LO, fx.SECS_HI)
KEY = ["msno", "membership_start_date", "membership_expire_date"]
USAGE_COLS = ", ".join(FP.USAGE_FEATURES)
USAGE_DOUBLES = [c for c in FP.USAGE_FEATURES if not c.startswith("sum_completion") and c != "sum_songs"]


def silver_tx_feat(spark, sf):
    t = fx.transactions(spark, sf).withColumn("snapshot_month", F.trunc("membership_expire_date", "MM"))
    return L.silver_transactions(t, W, fx.BURST_THRESHOLD_ORDERS, scope_cols=("snapshot_month",))


def logs_valid(spark, sf):
    return flt.valid_range(fx.user_logs(spark, sf), "total_secs", *SECS)


@query("silver_transactions", O.with_base("""
SELECT msno, tx_id, payment_method_id, payment_plan_days, plan_list_price, actual_amount_paid,
       is_auto_renew, transaction_date, membership_expire_date, is_cancel, snapshot_month,
       membership_start_date, discount_ratio
FROM silver_tx_feat""", doubles=["plan_list_price", "actual_amount_paid", "discount_ratio"]))
def silver_transactions(spark, sf):
    """Feature-path silver transactions: month-scoped burst filter, window, discount ratio."""
    return silver_tx_feat(spark, sf)


@query("silver_members", O.with_base("SELECT * FROM silver_members"))
def silver_members(spark, sf):
    return FP.silver_members(fx.members(spark, sf))


@query("interval_join", O.with_base("""
SELECT l.msno, l.date, l.num_unq, l.total_secs, p.tx_id, p.membership_start_date, p.membership_expire_date
FROM logs_valid l JOIN silver_tx_feat p
  ON l.msno = p.msno AND l.date >= p.membership_start_date AND l.date <= p.membership_expire_date""",
                                    doubles=["total_secs"]))
def interval_join(spark, sf):
    """Every log row x every period of its user that covers the log date."""
    p = silver_tx_feat(spark, sf).select("msno", "tx_id", "membership_start_date", "membership_expire_date")
    lg = logs_valid(spark, sf).select("msno", "date", "num_unq", "total_secs")
    return J.interval_join(lg, p).select("msno", "date", "num_unq", "total_secs", "tx_id",
                                         "membership_start_date", "membership_expire_date")


@query("interval_join__prefiltered", O.with_base("""
SELECT l.msno, l.date, l.total_secs, p.tx_id, p.membership_start_date, p.membership_expire_date
FROM logs_valid l JOIN silver_tx_feat p
  ON l.msno = p.msno AND l.date >= p.membership_start_date AND l.date <= p.membership_expire_date
WHERE p.snapshot_month = DATE '2000-06-01'""", doubles=["total_secs"]))
def interval_join_prefiltered(spark, sf):
    """The periods of one month: logs of users without one are dropped in their scan, before the shuffle."""
    p = silver_tx_feat(spark, sf).where(F.col("snapshot_month") == F.lit("2000-06-01").cast("date")).select(
        "msno", "tx_id", "membership_start_date", "membership_expire_date")
    lg = logs_valid(spark, sf).select("msno", "date", "total_secs")
    return J.interval_join(lg, p, prefilter=True).select("msno", "date", "total_secs", "tx_id", "membership_start_date", "membership_expire_date")


@query("interval_join__prior_month", O.with_base("""
SELECT l.msno, l.date, l.total_secs, p.tx_id, p.membership_start_date, p.membership_expire_date
FROM logs_valid l JOIN silver_tx_feat p
  ON l.msno = p.msno AND l.date <= p.membership_expire_date
 AND l.date >= greatest(p.membership_start_date,
                        CAST(date_trunc('month', p.membership_expire_date) - INTERVAL 1 MONTH AS DATE))""",
                                    doubles=["total_secs"]))
def interval_join_prior_month(spark, sf):
    """Parity form: only logs of the expiry month and the month before (Q11)."""
    p = silver_tx_feat(spark, sf).select("msno", "tx_id", "membership_start_date", "membership_expire_date")
    lg = logs_valid(spark, sf).select("msno", "date", "total_secs")
    return J.interval_join(lg, p, lookback_months=1).select(
        "msno", "date", "total_secs", "tx_id", "membership_start_date", "membership_expire_date")


def _usage_sql(lookback=1, dedupe=False):
    return O.with_base(f"SELECT msno, membership_start_date, membership_expire_date, {USAGE_COLS} FROM usage",
                       O.usage_block(lookback, dedupe), doubles=USAGE_DOUBLES)


@query("usage_features", _usage_sql(1, False), headline=True)
def usage_features(spark, sf):
    """18 usage features per period, reference parity (attribute grouping Q3, prior month Q11)."""
    return FP.usage_features(logs_valid(spark, sf), silver_tx_feat(spark, sf), lookback_months=1)


@query("usage_features__all_logs", _usage_sql(None, False))
def usage_features_all_logs(spark, sf):
    return FP.usage_features(logs_valid(spark, sf), silver_tx_feat(spark, sf), lookback_months=None)


@query("usage_features__daily", _usage_sql(1, False))
def usage_features_daily(spark, sf):
    """Logs pre-aggregated to one row per user and day before the join (for finer-grained logs)."""
    return FP.usage_features(logs_valid(spark, sf), silver_tx_feat(spark, sf), lookback_months=1, pre_aggregate_days=True)


@query("usage_features__dedupe_periods", _usage_sql(1, True))
def usage_features_dedupe(spark, sf):
    return FP.usage_features(logs_valid(spark, sf), silver_tx_feat(spark, sf), lookback_months=1,
                             dedupe_periods=True)


@query("period_usage", O.with_base("""
SELECT msno, membership_start_date, membership_expire_date, sum_completion_25, sum_completion_50,
       sum_completion_75, sum_completion_985, sum_completion_100, sum_songs, sum_total_secs
FROM usage_agg""", O.usage_block(None, True), doubles=["sum_total_secs"]))
def period_usage(spark, sf):
    """Per-period sums of the play counts, songs and seconds."""
    u = FP.usage_features(logs_valid(spark, sf), silver_tx_feat(spark, sf), lookback_months=None,
                          dedupe_periods=True)
    return u.select(*KEY, *FP.USAGE_SUMS)


@query("avg_row_ratio", O.with_base("""
SELECT msno, membership_start_date, membership_expire_date, avg_unique_song_played_ratio FROM usage_agg""",
                                    O.usage_block(None, True), doubles=["avg_unique_song_played_ratio"]))
def avg_row_ratio(spark, sf):
    """Mean of the per-log unique-song ratio per period."""
    u = FP.usage_features(logs_valid(spark, sf), silver_tx_feat(spark, sf), lookback_months=None,
                          dedupe_periods=True)
    return u.select(*KEY, "avg_unique_song_played_ratio")


@query("edge_window_sums", O.with_base("""
SELECT msno, membership_start_date, membership_expire_date, total_secs_first_7_days, total_secs_last_7_days
FROM usage_agg""", O.usage_block(None, True),
                                       doubles=["total_secs_first_7_days", "total_secs_last_7_days"]))
def edge_window_sums(spark, sf):
    """Seconds in the first and last 7 days of each period (strict <, no rows -> 0)."""
    u = FP.usage_features(logs_valid(spark, sf), silver_tx_feat(spark, sf), lookback_months=None,
                          dedupe_periods=True)
    return u.select(*KEY, "total_secs_first_7_days", "total_secs_last_7_days")


_GOLD = """
SELECT t.msno, t.membership_start_date, t.membership_expire_date, t.tx_id, t.payment_method_id,
       t.is_auto_renew, t.transaction_date, t.is_cancel, t.snapshot_month, t.discount_ratio,
       {usage}, m.city, m.gender, m.registered_via,
       CAST(datediff('day', m.registration_init_time, t.membership_start_date) AS INTEGER) AS account_age
FROM silver_tx_feat t
JOIN usage u ON u.msno = t.msno AND u.membership_start_date = t.membership_start_date
            AND u.membership_expire_date = t.membership_expire_date
JOIN silver_members m ON m.msno = t.msno"""

_GOLD_SQL = _GOLD.format(usage=", ".join(f"u.{c}" for c in FP.USAGE_FEATURES))


def gold(spark, sf, dedupe=False, tx=None, plan_days=None, periods=None):
    return FP.feature_store(fx.transactions(spark, sf) if tx is None else tx, fx.user_logs(spark, sf), fx.members(spark, sf),
                            window=W, burst_n=fx.BURST_THRESHOLD_ORDERS, secs_bounds=SECS,
                            lookback_months=1, dedupe_periods=dedupe, plan_days=plan_days, periods=periods)


GOLD_DOUBLES = ["discount_ratio", *USAGE_DOUBLES]


@query("feature_store", O.with_base(_GOLD_SQL, O.usage_block(1, False), GOLD_DOUBLES), headline=True)
def feature_store(spark, sf):
    """Gold feature store: 30 columns (+ tie-break, month); duplicate period keys fan out (Q3)."""
    return gold(spark, sf)


@query("feature_store__dedupe_periods", O.with_base(_GOLD_SQL, O.usage_block(1, True), GOLD_DOUBLES))
def feature_store_dedupe(spark, sf):
    return gold(spark, sf, dedupe=True)


@query("feature_join", O.with_base("""
SELECT t.msno, t.membership_start_date, t.membership_expire_date, t.tx_id, u.sum_songs, u.skip_ratio
FROM silver_tx_feat t JOIN usage u ON u.msno = t.msno AND u.membership_start_date = t.membership_start_date
 AND u.membership_expire_date = t.membership_expire_date""", O.usage_block(1, False), ["skip_ratio"]))
def feature_join(spark, sf):
    """Transactions x usage features on the 3-column period key (inner, fan-out kept)."""
    st = silver_tx_feat(spark, sf)
    u = FP.usage_features(logs_valid(spark, sf), st, lookback_months=1)
    return J.feature_join(st, u).select(*KEY, "tx_id", "sum_songs", "skip_ratio")


@query("feature_store__bucketed", O.with_base("""
SELECT t.msno, t.membership_start_date, t.membership_expire_date, t.tx_id, u.sum_songs, u.skip_ratio, m.city, m.gender, m.registered_via
FROM silver_tx_feat t JOIN usage u ON u.msno = t.msno AND u.membership_start_date = t.membership_start_date
 AND u.membership_expire_date = t.membership_expire_date JOIN silver_members m ON m.msno = t.msno""", O.usage_block(1, False), ["skip_ratio"]))
def feature_store_bucketed(spark, sf):
    """Transactions x usage features x members, joined from layers bucketed by user."""
    st = silver_tx_feat(spark, sf)
    u = FP.usage_features(logs_valid(spark, sf), st, lookback_months=1).select(*KEY, "sum_songs", "skip_ratio")
    m = FP.silver_members(fx.members(spark, sf)).select("msno", "city", "gender", "registered_via")
    return J.bucketed_feature_store(st.select(*KEY, "tx_id"), u, m)


@query("member_join", O.with_base("""
SELECT t.msno, t.tx_id, m.city, m.gender, m.registered_via,
       CAST(datediff('day', m.registration_init_time, t.membership_start_date) AS INTEGER) AS account_age
FROM silver_tx_feat t JOIN silver_members m ON m.msno = t.msno"""))
def member_join(spark, sf):
    from renewcast.functions.scalar import account_age
    j = J.member_join(silver_tx_feat(spark, sf), FP.silver_members(fx.members(spark, sf)))
    return j.select("msno", "tx_id", "city", "gender", "registered_via",
                    account_age("membership_start_date", "registration_init_time").alias("account_age"))


@query("drop_burst_users", O.with_base("""
SELECT msno, tx_id FROM transactions t WHERE NOT EXISTS (SELECT 1 FROM burst_all b WHERE b.msno = t.msno)"""))
def drop_burst_users(spark, sf):
    """Whole-table scope (label path)."""
    return flt.drop_burst_users(fx.transactions(spark, sf), n=fx.BURST_THRESHOLD_ORDERS).select("msno", "tx_id")


@query("drop_burst_users__month_scope", O.with_base("""
SELECT msno, tx_id, snapshot_month FROM tx_month t
WHERE NOT EXISTS (SELECT 1 FROM burst_month b WHERE b.msno = t.msno AND b.snapshot_month = t.snapshot_month)"""))
def drop_burst_users_month(spark, sf):
    """Scoped to the expiry month (feature path, Q2)."""
    t = fx.transactions(spark, sf).withColumn("snapshot_month", F.trunc("membership_expire_date", "MM"))
    return flt.drop_burst_users(t, n=fx.BURST_THRESHOLD_ORDERS, scope_cols=("snapshot_month",)) \
        .select("msno", "tx_id", "snapshot_month")


@query("drop_burst_users__events", """
SELECT user_id, day, event_type FROM (
  SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(ts AS DATE) AS day, event_type FROM events) e
WHERE NOT EXISTS (
  SELECT 1 FROM (SELECT CAST(user_id AS VARCHAR) AS u FROM events
                 WHERE user_id IS NOT NULL AND ts IS NOT NULL AND event_type IS NOT NULL
                 GROUP BY user_id, CAST(ts AS DATE), event_type HAVING count(*) > 3) b
  WHERE b.u = e.user_id)""")
def drop_burst_users_events(spark, sf):
    """The burst filter on the event stream: > 3 events of one type on one day."""
    ev = fx.events(spark, sf)
    return flt.drop_burst_users(ev, n=fx.BURST_THRESHOLD_EVENTS, user="user_id", keys=("day", "event_type"))


@query("with_prior_month", O.with_base("""
SELECT l.msno, l.date, l.total_secs, m.snapshot_month
FROM logs_valid l
JOIN (SELECT DISTINCT CAST(date_trunc('month', date) AS DATE) AS snapshot_month FROM logs_valid) m
  ON m.snapshot_month = CAST(date_trunc('month', l.date) AS DATE)
  OR m.snapshot_month = CAST(date_trunc('month', l.date) + INTERVAL 1 MONTH AS DATE)""", doubles=["total_secs"]))
def with_prior_month(spark, sf):
    """Each month's logs plus the prior month's, for every month that has logs."""
    return io.with_prior_month(logs_valid(spark, sf).select("msno", "date", "total_secs"), "date")
