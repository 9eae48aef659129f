"""DuckDB SQL for every registered query (the correctness gate).

``BASE`` holds the fixture adapters as CTEs -- the same definitions as
``renewcast.sources.fixtures`` -- plus the shared silver steps.  Every oracle
is ``WITH <BASE>, <own CTEs> SELECT ...``; DuckDB inlines unused CTEs.
Doubles are rounded to 6 decimals on both sides of the comparison.
"""

from __future__ import annotations

# Fixture constants (same values as renewcast.sources.fixtures).
W_LO, W_HI = "1995-01-01", "2001-06-30"
TAIL_END, TAIL_DAYS = "2001-06-30", 30
SPLIT_A, SPLIT_B, SPLIT_C = "2000-11-01", "2000-11-30", "2000-12-01"
BURST_N = 1
SECS_LO, SECS_HI = 1000.0, 90000.0

_PLAN = ("CAST(CASE o.o_orderpriority WHEN '1-URGENT' THEN 7 WHEN '3-MEDIUM' THEN 31 "
         "WHEN '5-LOW' THEN 90 ELSE 30 END AS INTEGER)")

BASE = f"""
li_tot AS (
  SELECT l_orderkey, sum(l_extendedprice) AS lp, sum(l_extendedprice * (1 - l_discount)) AS paid
  FROM lineitem GROUP BY l_orderkey),
transactions AS (
  SELECT CAST(o.o_custkey AS VARCHAR) AS msno,
         o.o_orderkey AS tx_id,
         CAST(36 + o.o_orderkey % 6 AS VARCHAR) AS payment_method_id,
         {_PLAN} AS payment_plan_days,
         round(coalesce(t.lp, 0.0), 2) AS plan_list_price,
         round(coalesce(t.paid, 0.0), 4) AS actual_amount_paid,
         CAST(o.o_orderstatus = 'O' AS INTEGER) AS is_auto_renew,
         CAST(o.o_orderdate AS DATE) AS transaction_date,
         CAST(o.o_orderdate AS DATE) + {_PLAN} AS membership_expire_date,
         CAST(o.o_orderstatus = 'F' AS INTEGER) AS is_cancel
  FROM orders o LEFT JOIN li_tot t ON o.o_orderkey = t.l_orderkey),
user_logs AS (
  SELECT CAST(o.o_custkey AS VARCHAR) AS msno,
         CAST(l.l_shipdate AS DATE) AS date,
         CASE WHEN l.l_returnflag = 'R' THEN CAST(trunc(l.l_quantity) AS INTEGER) ELSE 0 END AS num_25,
         CASE WHEN l.l_returnflag = 'A' THEN l.l_linenumber ELSE 0 END AS num_50,
         CASE WHEN l.l_returnflag = 'N' AND l.l_linestatus = 'F' THEN l.l_linenumber ELSE 0 END AS num_75,
         CASE WHEN l.l_returnflag = 'R' THEN l.l_linenumber ELSE 0 END AS num_985,
         CASE WHEN l.l_returnflag = 'A' THEN CAST(trunc(l.l_quantity) AS INTEGER) ELSE 0 END AS num_100,
         l.l_linenumber AS num_unq,
         l.l_extendedprice AS total_secs
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
members AS (
  SELECT CAST(c_custkey AS VARCHAR) AS msno,
         CAST(c_nationkey AS VARCHAR) AS city,
         nullif(c_mktsegment, 'HOUSEHOLD') AS gender,
         CAST(c_custkey % 12 AS VARCHAR) AS registered_via,
         CAST(DATE '1994-12-31' - CAST(c_custkey % 365 AS INTEGER) AS DATE) AS registration_init_time
  FROM customer),
hard_preds AS (
  SELECT doc_id, CAST(quality AS INTEGER) AS y_true, CAST(toxic AS INTEGER) AS y_pred FROM labels),
scored_preds AS (
  SELECT l_orderkey, l_linenumber, CAST(l_returnflag = 'R' AS INTEGER) AS y_true,
         round(l_discount * 10, 2) AS score, CAST(l_shipdate AS DATE) AS day
  FROM lineitem),
tx_start AS (
  SELECT *, CAST(membership_expire_date - payment_plan_days AS DATE) AS membership_start_date
  FROM transactions),
burst_all AS (
  SELECT DISTINCT msno FROM (
    SELECT msno FROM tx_start
    WHERE msno IS NOT NULL AND transaction_date IS NOT NULL AND is_cancel IS NOT NULL
    GROUP BY msno, transaction_date, is_cancel HAVING count(*) > {BURST_N})),
silver_tx_label AS (
  SELECT * FROM tx_start t
  WHERE NOT EXISTS (SELECT 1 FROM burst_all b WHERE b.msno = t.msno)
    AND membership_start_date >= DATE '{W_LO}' AND membership_expire_date <= DATE '{W_HI}'),
next_tx AS (
  SELECT *, lead(transaction_date) OVER (
      PARTITION BY msno ORDER BY transaction_date NULLS LAST, membership_expire_date NULLS LAST,
      tx_id NULLS LAST) AS next_transaction_date
  FROM silver_tx_label WHERE is_cancel = 0),
label_silver AS (
  SELECT msno, membership_start_date, membership_expire_date, tx_id, next_transaction_date,
         CASE WHEN d < 0 THEN 0 ELSE d END AS days_diff
  FROM (SELECT *, CAST(datediff('day', membership_expire_date, next_transaction_date) AS INTEGER) AS d
        FROM next_tx WHERE payment_plan_days BETWEEN 30 AND 31) x
  WHERE NOT (next_transaction_date IS NULL AND
             coalesce(datediff('day', membership_expire_date, DATE '{TAIL_END}') BETWEEN 0 AND {TAIL_DAYS}, false))),
tx_month AS (
  SELECT *, CAST(date_trunc('month', membership_expire_date) AS DATE) AS snapshot_month FROM tx_start),
burst_month AS (
  SELECT DISTINCT msno, snapshot_month FROM (
    SELECT msno, snapshot_month FROM tx_month
    WHERE msno IS NOT NULL AND snapshot_month IS NOT NULL AND transaction_date IS NOT NULL
      AND is_cancel IS NOT NULL
    GROUP BY msno, snapshot_month, transaction_date, is_cancel HAVING count(*) > {BURST_N})),
silver_tx_feat AS (
  SELECT t.*, CASE WHEN plan_list_price <> 0 THEN (plan_list_price - actual_amount_paid) / plan_list_price
                   ELSE 0.0 END AS discount_ratio
  FROM tx_month t
  WHERE NOT EXISTS (SELECT 1 FROM burst_month b WHERE b.msno = t.msno AND b.snapshot_month = t.snapshot_month)
    AND membership_start_date >= DATE '{W_LO}' AND membership_expire_date <= DATE '{W_HI}'),
logs_valid AS (
  SELECT * FROM user_logs WHERE total_secs >= {SECS_LO} AND total_secs <= {SECS_HI}),
silver_members AS (
  SELECT msno, city, coalesce(gender, 'na') AS gender, registered_via, registration_init_time FROM members)
"""


def with_base(body: str, extra_ctes: str = "", doubles=()) -> str:
    """Wrap a final SELECT with the shared CTEs (and optional extra CTEs).

    ``doubles`` names the DOUBLE output columns; they are rounded to 6
    decimals, as the Spark side does for every double column.
    """
    ctes = BASE.strip()
    if extra_ctes.strip():
        ctes = ctes + ",\n" + extra_ctes.strip()
    sql = f"WITH {ctes}\n{body.strip()}"
    return rounded(sql, doubles)


def rounded(sql: str, doubles=()) -> str:
    if not doubles:
        return sql
    rep = ", ".join(f"round({c}, 6) AS {c}" for c in doubles)
    return f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n) _q"


def usage_block(lookback: int | None = 1, dedupe: bool = False, edge: int = 7) -> str:
    """Usage features written the reference's way: every log row x every matching
    transaction row, grouped by the period key (+ the 7 attributes)."""
    lo = "p.membership_start_date"
    if lookback is not None:
        lo = (f"greatest(p.membership_start_date, "
              f"CAST(date_trunc('month', p.membership_expire_date) - INTERVAL {int(lookback)} MONTH AS DATE))")
    attrs = ("p.payment_method_id, p.payment_plan_days, p.plan_list_price, p.actual_amount_paid, "
             "p.is_auto_renew, p.transaction_date, p.is_cancel")
    periods = ("(SELECT DISTINCT msno, membership_start_date, membership_expire_date FROM silver_tx_feat)"
               if dedupe else "silver_tx_feat")
    group = "p.msno, p.membership_start_date, p.membership_expire_date" + ("" if dedupe else ", " + attrs)
    return f"""
usage_joined AS (
  SELECT p.msno, p.membership_start_date, p.membership_expire_date,
         {'' if dedupe else attrs + ','}
         l.num_25, l.num_50, l.num_75, l.num_985, l.num_100, l.total_secs,
         l.num_25 + l.num_50 + l.num_75 + l.num_985 + l.num_100 AS sum_songs,
         CASE WHEN l.num_25 + l.num_50 + l.num_75 + l.num_985 + l.num_100 = 0 THEN 0.0
              ELSE l.num_unq / (l.num_25 + l.num_50 + l.num_75 + l.num_985 + l.num_100) END AS usr,
         datediff('day', p.membership_start_date, l.date) AS days_from_start,
         datediff('day', l.date, p.membership_expire_date) AS days_to_end
  FROM logs_valid l JOIN {periods} p
    ON l.msno = p.msno AND l.date >= {lo} AND l.date <= p.membership_expire_date),
usage_agg AS (
  SELECT p.msno, p.membership_start_date, p.membership_expire_date,
         CAST(sum(num_25) AS BIGINT) AS sum_completion_25,
         CAST(sum(num_50) AS BIGINT) AS sum_completion_50,
         CAST(sum(num_75) AS BIGINT) AS sum_completion_75,
         CAST(sum(num_985) AS BIGINT) AS sum_completion_985,
         CAST(sum(num_100) AS BIGINT) AS sum_completion_100,
         CAST(sum(sum_songs) AS BIGINT) AS sum_songs,
         round(sum(total_secs), 6) AS sum_total_secs,
         avg(usr) AS avg_unique_song_played_ratio,
         round(coalesce(sum(CASE WHEN days_from_start < {edge} THEN total_secs END), 0.0), 6)
           AS total_secs_first_7_days,
         round(coalesce(sum(CASE WHEN days_to_end < {edge} THEN total_secs END), 0.0), 6)
           AS total_secs_last_7_days
  FROM usage_joined p
  GROUP BY {group}),
usage AS (
  SELECT *,
    CASE WHEN sum_songs = 0 THEN 0.0 ELSE sum_total_secs / sum_songs END AS avg_seconds_per_songs,
    CASE WHEN sum_songs = 0 THEN 0.0 ELSE (sum_completion_25 + sum_completion_50) / sum_songs END AS skip_ratio,
    CASE WHEN sum_songs = 0 THEN 0.0 ELSE sum_completion_25 / sum_songs END AS songs_played_25_ratio,
    CASE WHEN sum_songs = 0 THEN 0.0 ELSE sum_completion_50 / sum_songs END AS songs_played_50_ratio,
    CASE WHEN sum_songs = 0 THEN 0.0 ELSE sum_completion_75 / sum_songs END AS songs_played_75_ratio,
    CASE WHEN sum_songs = 0 THEN 0.0 ELSE sum_completion_985 / sum_songs END AS songs_played_985_ratio,
    CASE WHEN sum_songs = 0 THEN 0.0 ELSE sum_completion_100 / sum_songs END AS songs_completion_ratio,
    CASE WHEN total_secs_last_7_days = 0 THEN 0.0
         ELSE (total_secs_last_7_days + 0.01) / nullif(total_secs_first_7_days + 0.01, 0) END
      AS last_first_7_days_total_secs_ratio
  FROM usage_agg)"""
