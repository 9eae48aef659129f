"""Scalar-function and filter queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from renewcast import oracle as O
from renewcast.catalog.labels import _NB_TX
from renewcast.functions import scalar as S
from renewcast.operators import filters as flt
from renewcast.registry import query
from renewcast.sources import fixtures as fx
from renewcast.sources import io

W = (fx.WINDOW_LO, fx.WINDOW_HI)

# Raw text dates: yyyyMMdd for settled orders, ISO text for pending ones
# ('P'), which the yyyyMMdd parser must turn into null.
_RAW_DATES = """
raw_dates AS (
  SELECT tx_id, transaction_date AS d,
         CASE WHEN o.o_orderstatus = 'P' THEN strftime(transaction_date, '%Y-%m-%d')
              ELSE strftime(transaction_date, '%Y%m%d') END AS txt
  FROM transactions t JOIN orders o ON o.o_orderkey = t.tx_id)"""


def _raw_dates(spark, sf):
    t = fx.transactions(spark, sf).select("tx_id", "transaction_date")
    o = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("tx_id"), "o_orderstatus")
    txt = F.when(F.col("o_orderstatus") == "P", F.date_format("transaction_date", "yyyy-MM-dd")) \
        .otherwise(F.date_format("transaction_date", "yyyyMMdd"))
    return t.join(o, "tx_id").select("tx_id", F.col("transaction_date").alias("d"), txt.alias("txt"))


@query("parse_yyyymmdd", O.with_base(
    "SELECT tx_id, txt, CAST(try_strptime(txt, '%Y%m%d') AS DATE) AS parsed FROM raw_dates", _RAW_DATES))
def parse_yyyymmdd(spark, sf):
    """yyyyMMdd text -> DATE; ISO-formatted text is malformed here and gives null."""
    return _raw_dates(spark, sf).select("tx_id", "txt", S.parse_yyyymmdd("txt").alias("parsed"))


@query("parse_iso_date", O.with_base(
    "SELECT tx_id, txt, CAST(try_strptime(txt, '%Y-%m-%d') AS DATE) AS parsed FROM raw_dates", _RAW_DATES))
def parse_iso_date(spark, sf):
    return _raw_dates(spark, sf).select("tx_id", "txt", S.parse_iso_date("txt").alias("parsed"))


@query("cast_schema", O.with_base("""
SELECT tx_id, CAST(payment_method_id AS INTEGER) AS payment_method_id,
       CAST(payment_plan_days AS BIGINT) AS payment_plan_days,
       TRY_CAST(txt AS INTEGER) AS txt
FROM transactions JOIN raw_dates USING (tx_id)""", _RAW_DATES))
def cast_schema(spark, sf):
    """Cast a dict of columns in one projection; malformed values -> null (try_cast)."""
    t = fx.transactions(spark, sf).select("tx_id", "payment_method_id", "payment_plan_days")
    df = t.join(_raw_dates(spark, sf).select("tx_id", "txt"), "tx_id")
    return io.cast_schema(df, {"payment_method_id": "int", "payment_plan_days": "bigint", "txt": "int"})


@query("drop_columns", O.with_base("SELECT msno, city, registered_via FROM members"))
def drop_columns(spark, sf):
    """Drop by name; absent names ('bd', '_c0') are ignored."""
    return io.drop_columns(fx.members(spark, sf), ["gender", "registration_init_time", "bd", "_c0"])


@query("fill_missing", O.with_base("SELECT msno, coalesce(gender, 'na') AS gender FROM members"))
def fill_missing(spark, sf):
    return S.fill_missing(fx.members(spark, sf).select("msno", "gender"), {"gender": "na"})


@query("membership_start", O.with_base("""
SELECT tx_id, CAST(membership_expire_date - payment_plan_days AS DATE) AS membership_start_date
FROM transactions"""))
def membership_start(spark, sf):
    t = fx.transactions(spark, sf)
    return t.select("tx_id", S.membership_start("membership_expire_date", "payment_plan_days")
                    .alias("membership_start_date"))


@query("discount_ratio", O.with_base("""
SELECT tx_id, CASE WHEN plan_list_price <> 0 THEN (plan_list_price - actual_amount_paid) / plan_list_price
                   ELSE 0.0 END AS discount_ratio
FROM transactions""", doubles=["discount_ratio"]))
def discount_ratio(spark, sf):
    """(list - paid) / list, 0 for a zero list price (orders without line items)."""
    t = fx.transactions(spark, sf)
    return t.select("tx_id", S.discount_ratio("plan_list_price", "actual_amount_paid").alias("discount_ratio"))


@query("sum_songs", O.with_base("""
SELECT msno, date, num_25 + num_50 + num_75 + num_985 + num_100 AS sum_songs FROM user_logs"""))
def sum_songs(spark, sf):
    lg = fx.user_logs(spark, sf)
    return lg.select("msno", "date", S.sum_songs(*("num_25", "num_50", "num_75", "num_985", "num_100"))
                     .alias("sum_songs"))


@query("guarded_ratio", O.with_base("""
SELECT msno, date,
       CASE WHEN num_25 + num_50 + num_75 + num_985 + num_100 = 0 THEN 0.0
            ELSE num_unq / (num_25 + num_50 + num_75 + num_985 + num_100) END AS unique_song_played_ratio,
       CASE WHEN num_unq = 0 THEN 0.0 ELSE num_25 / num_unq END AS songs_played_25_ratio
FROM user_logs""", doubles=["unique_song_played_ratio", "songs_played_25_ratio"]))
def guarded_ratio(spark, sf):
    """num/den with den = 0 -> 0 (10,002 zero-song rows at sf0.01)."""
    lg = fx.user_logs(spark, sf)
    songs = S.sum_songs("num_25", "num_50", "num_75", "num_985", "num_100")
    return lg.select("msno", "date", S.guarded_ratio("num_unq", songs).alias("unique_song_played_ratio"),
                     S.guarded_ratio("num_25", "num_unq").alias("songs_played_25_ratio"))


@query("smoothed_ratio", O.with_base("""
SELECT msno, date, CASE WHEN num_25 = 0 THEN 0.0 ELSE (num_25 + 0.01) / nullif(num_985 + 0.01, 0) END AS ratio
FROM user_logs""", doubles=["ratio"]))
def smoothed_ratio(spark, sf):
    lg = fx.user_logs(spark, sf)
    return lg.select("msno", "date", S.smoothed_ratio("num_25", "num_985", 0.01).alias("ratio"))


@query("period_offsets", O.with_base("""
SELECT l.msno, l.date, p.tx_id,
       CAST(datediff('day', p.membership_start_date, l.date) AS INTEGER) AS days_from_start,
       CAST(datediff('day', l.date, p.membership_expire_date) AS INTEGER) AS days_to_end
FROM logs_valid l JOIN silver_tx_feat p
  ON l.msno = p.msno AND l.date >= p.membership_start_date AND l.date <= p.membership_expire_date"""))
def period_offsets(spark, sf):
    """Days from period start and to period end of every joined log row."""
    from renewcast.catalog.features import logs_valid, silver_tx_feat
    from renewcast.operators.joins import interval_join
    p = silver_tx_feat(spark, sf).select("msno", "tx_id", "membership_start_date", "membership_expire_date")
    j = interval_join(logs_valid(spark, sf).select("msno", "date"), p)
    return j.select("msno", "date", "tx_id",
                    S.days_between("date", "membership_start_date").alias("days_from_start"),
                    S.days_between("membership_expire_date", "date").alias("days_to_end"))


@query("account_age", O.with_base("""
SELECT t.tx_id, CAST(datediff('day', m.registration_init_time, t.membership_start_date) AS INTEGER) AS account_age
FROM tx_start t JOIN members m ON m.msno = t.msno"""))
def account_age(spark, sf):
    t = fx.transactions(spark, sf).withColumn(
        "membership_start_date", S.membership_start("membership_expire_date", "payment_plan_days"))
    j = t.join(fx.members(spark, sf), "msno")
    return j.select("tx_id", S.account_age("membership_start_date", "registration_init_time").alias("account_age"))


@query("plan_days", O.with_base("""
SELECT tx_id, CAST(datediff('day', membership_start_date, membership_expire_date) AS INTEGER) AS plan_days
FROM tx_start"""))
def plan_days(spark, sf):
    t = fx.transactions(spark, sf).withColumn(
        "membership_start_date", S.membership_start("membership_expire_date", "payment_plan_days"))
    return t.select("tx_id", S.plan_days("membership_start_date", "membership_expire_date").alias("plan_days"))


@query("clamp_non_negative", O.with_base("""
SELECT msno, membership_expire_date,
       CASE WHEN d < 0 THEN 0 ELSE d END AS days_diff
FROM (SELECT msno, membership_expire_date,
             CAST(datediff('day', membership_expire_date, next_transaction_date) AS INTEGER) AS d
      FROM next_tx WHERE payment_plan_days BETWEEN 30 AND 31) x"""))
def clamp_non_negative(spark, sf):
    """Negative gaps (474 early renewals at sf0.01) -> 0; never-returned stays null."""
    from renewcast.catalog.labels import next_active_transaction
    n = next_active_transaction(spark, sf)
    return n.select("msno", "membership_expire_date", S.clamp_non_negative("days_diff").alias("days_diff"))


@query("churn_flag", O.with_base("""
SELECT msno, membership_expire_date, days_diff,
       CASE WHEN days_diff IS NULL THEN 0 WHEN days_diff > 5 THEN 1 ELSE 0 END AS churn,
       CASE WHEN days_diff IS NULL THEN 1 WHEN days_diff > 5 THEN 1 ELSE 0 END AS churn_intended
FROM label_silver"""))
def churn_flag(spark, sf):
    from renewcast.catalog.labels import _labels
    lab = _labels(spark, sf, 0)
    return lab.select("msno", "membership_expire_date", "days_diff",
                      S.churn_flag("days_diff", 5, 0).alias("churn"),
                      S.churn_flag("days_diff", 5, 1).alias("churn_intended"))


@query("bin_by_edges", O.with_base("""
SELECT msno, days_diff,
       CASE WHEN days_diff > -1 AND days_diff <= 5 THEN 0 WHEN days_diff > 5 THEN 1 END AS label
FROM label_silver"""))
def bin_by_edges(spark, sf):
    """Right-closed bins (-1, 5] -> 0, (5, inf) -> 1; null stays null."""
    from renewcast.catalog.labels import _labels
    lab = _labels(spark, sf, 0)
    return lab.select("msno", "days_diff",
                      S.bin_by_edges("days_diff", [-1, 5, float("inf")], [0, 1]).alias("label"))


# Rare-category lists of the reference (fixed values).
PAYMENT_KEEP = ["41", "40", "36", "39", "37"]
CITY_KEEP = ["1", "13", "5", "4", "15", "22"]
VIA_KEEP = ["7", "9", "3"]


def _in(vals):
    return "(" + ", ".join(f"'{v}'" for v in vals) + ")"


@query("map_rare", O.with_base(f"""
SELECT t.tx_id,
       CASE WHEN t.payment_method_id IN {_in(PAYMENT_KEEP)} THEN t.payment_method_id ELSE '99' END AS payment_method_id,
       CASE WHEN m.city IN {_in(CITY_KEEP)} THEN m.city ELSE '99' END AS city,
       CASE WHEN m.registered_via IN {_in(VIA_KEEP)} THEN m.registered_via ELSE '99' END AS registered_via
FROM transactions t JOIN members m ON m.msno = t.msno"""))
def map_rare(spark, sf):
    t = fx.transactions(spark, sf).join(fx.members(spark, sf), "msno")
    return t.select("tx_id", S.map_rare("payment_method_id", PAYMENT_KEEP).alias("payment_method_id"),
                    S.map_rare("city", CITY_KEEP).alias("city"),
                    S.map_rare("registered_via", VIA_KEEP).alias("registered_via"))


@query("binarize", O.with_base("""
SELECT l_orderkey, l_linenumber, score, CAST(score >= 0.5 AS INTEGER) AS y_pred FROM scored_preds""",
                               doubles=["score"]))
def binarize(spark, sf):
    s = fx.scored_predictions(spark, sf)
    return s.select("l_orderkey", "l_linenumber", "score", S.binarize("score", 0.5).alias("y_pred"))


# ---- filters ---------------------------------------------------------------

@query("membership_window", O.with_base(f"""
SELECT tx_id FROM tx_start
WHERE membership_start_date >= DATE '{fx.WINDOW_LO}' AND membership_expire_date <= DATE '{fx.WINDOW_HI}'"""))
def membership_window(spark, sf):
    t = fx.transactions(spark, sf).withColumn(
        "membership_start_date", S.membership_start("membership_expire_date", "payment_plan_days"))
    return flt.membership_window(t, *W).select("tx_id")


@query("valid_range", O.with_base(f"""
SELECT msno, date, total_secs FROM user_logs WHERE total_secs >= {fx.SECS_LO} AND total_secs <= {fx.SECS_HI}""",
                                  doubles=["total_secs"]))
def valid_range(spark, sf):
    return flt.valid_range(fx.user_logs(spark, sf), "total_secs", fx.SECS_LO, fx.SECS_HI) \
        .select("msno", "date", "total_secs")


@query("plan_days_in", O.with_base("""
SELECT tx_id FROM tx_start
WHERE datediff('day', membership_start_date, membership_expire_date) IN (30, 31)"""))
def plan_days_in(spark, sf):
    t = fx.transactions(spark, sf).withColumn(
        "membership_start_date", S.membership_start("membership_expire_date", "payment_plan_days"))
    return flt.plan_days_in(t, (30, 31)).select("tx_id")


@query("eligible_memberships", O.with_base("""
SELECT tx_id FROM transactions WHERE payment_plan_days BETWEEN 30 AND 31 AND is_cancel = 0"""))
def eligible_memberships(spark, sf):
    return flt.eligible_memberships(fx.transactions(spark, sf)).select("tx_id")


@query("drop_unresolved_tail", O.with_base(f"""
SELECT msno, membership_start_date, membership_expire_date FROM (
  SELECT * FROM next_tx WHERE payment_plan_days BETWEEN 30 AND 31) x
WHERE NOT (next_transaction_date IS NULL AND
           coalesce(datediff('day', membership_expire_date, DATE '{fx.TAIL_END}') BETWEEN 0 AND {fx.TAIL_DAYS}, false))"""))
def drop_unresolved_tail(spark, sf):
    from renewcast.catalog.labels import next_active_transaction
    n = next_active_transaction(spark, sf)
    return flt.drop_unresolved_tail(n, fx.TAIL_END, fx.TAIL_DAYS).select(
        "msno", "membership_start_date", "membership_expire_date")


@query("drop_null_rows", O.with_base("""
SELECT * FROM members WHERE msno IS NOT NULL AND city IS NOT NULL AND gender IS NOT NULL
  AND registered_via IS NOT NULL AND registration_init_time IS NOT NULL"""))
def drop_null_rows(spark, sf):
    """Rows with any null dropped (289 null genders at sf0.01)."""
    return flt.drop_null_rows(fx.members(spark, sf))


@query("split_by_time", O.with_base(f"""
SELECT tx_id, CASE WHEN membership_start_date < DATE '{fx.SPLIT_TRAIN_BEFORE}' THEN 'train'
                   WHEN membership_start_date <= DATE '{fx.SPLIT_OOT_END}' THEN 'oot'
                   WHEN membership_start_date > DATE '{fx.SPLIT_INFERENCE_AFTER}' THEN 'inference' END AS split
FROM tx_start"""))
def split_by_time(spark, sf):
    """One pass; the gap day 2000-12-01 is in no set (null), Q5."""
    t = fx.transactions(spark, sf).withColumn(
        "membership_start_date", S.membership_start("membership_expire_date", "payment_plan_days"))
    return flt.split_by_time(t, "membership_start_date", fx.SPLIT_TRAIN_BEFORE, fx.SPLIT_OOT_END,
                             fx.SPLIT_INFERENCE_AFTER).select("tx_id", "split")


@query("snapshot_slice", O.with_base("""
SELECT tx_id, membership_expire_date FROM transactions
WHERE membership_expire_date >= DATE '1998-02-01' AND membership_expire_date <= DATE '1998-02-28'"""))
def snapshot_slice(spark, sf):
    """Rows whose expiry falls in February 1998 (first to last day)."""
    return flt.snapshot_slice(fx.transactions(spark, sf), "membership_expire_date", "1998-02-01") \
        .select("tx_id", "membership_expire_date")


@query("assign_snapshot_month", O.with_base("""
SELECT tx_id, CAST(date_trunc('month', membership_expire_date) AS DATE) AS snapshot_month FROM transactions"""))
def assign_snapshot_month(spark, sf):
    return io.assign_snapshot_month(fx.transactions(spark, sf), "membership_expire_date").select(
        "tx_id", "snapshot_month")


@query("month_spine", O.with_base(f"""
SELECT CAST(m AS DATE) AS snapshot_month FROM (
  SELECT unnest(generate_series(date_trunc('month', min(transaction_date)), max(membership_expire_date),
                                INTERVAL 1 MONTH)) AS m
  FROM transactions) x"""))
def month_spine(spark, sf):
    """First-of-month dates spanning the transaction table (bounds read from the data)."""
    b = fx.transactions(spark, sf).agg(F.min("transaction_date"), F.max("membership_expire_date")).first()
    return io.month_spine(spark, str(b[0]), str(b[1]))


@query("semi_filter", O.with_base("""
SELECT t.msno, t.tx_id FROM nb_tx t WHERE t.msno IN (SELECT msno FROM nb_users)""", _NB_TX))
def semi_filter(spark, sf):
    """Transactions of the cancel-and-resume users (left semi join)."""
    from renewcast.catalog.labels import _nb_tx
    from renewcast.plans.labels import cancel_behaviour
    t = _nb_tx(spark, sf)
    from renewcast.operators.joins import semi_filter as keep
    return keep(t, cancel_behaviour(t)).select("msno", "tx_id")
