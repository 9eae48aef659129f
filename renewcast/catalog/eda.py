"""EDA and profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from renewcast import oracle as O
from renewcast.catalog.labels import _NB_TX, _labels, _nb_tx
from renewcast.operators import filters as flt
from renewcast.operators import profiles as P
from renewcast.operators import windows as Wn
from renewcast.plans import labels as L
from renewcast.registry import query
from renewcast.sources import fixtures as fx

W = (fx.WINDOW_LO, fx.WINDOW_HI)
GOLD_LABEL = """
gold_label AS (
  SELECT msno, membership_start_date, membership_expire_date, next_transaction_date, days_diff,
         CASE WHEN days_diff IS NULL THEN 0 WHEN days_diff > 5 THEN 1 ELSE 0 END AS churn
  FROM label_silver)"""
DAILY = """
daily AS (
  SELECT msno, transaction_date, is_cancel, count(*) AS transaction_count FROM transactions
  WHERE msno IS NOT NULL AND transaction_date IS NOT NULL AND is_cancel IS NOT NULL
  GROUP BY msno, transaction_date, is_cancel),
coc AS (SELECT transaction_count, count(*) AS counts FROM daily GROUP BY transaction_count)"""


def _daily(spark, sf):
    return P.daily_transaction_counts(fx.transactions(spark, sf))


@query("value_counts", O.with_base("SELECT gender, count(*) AS count FROM members GROUP BY gender"))
def value_counts(spark, sf):
    """Count per gender, null as its own group (Spark semantics)."""
    return P.value_counts(fx.members(spark, sf), "gender")


@query("value_shares", O.with_base("""
SELECT gender, count(*) AS count, count(*) / sum(count(*)) OVER () AS share
FROM members WHERE gender IS NOT NULL GROUP BY gender""", doubles=["share"]))
def value_shares(spark, sf):
    return P.value_shares(fx.members(spark, sf), "gender")


@query("daily_transaction_counts", O.with_base("SELECT * FROM daily", DAILY))
def daily_transaction_counts(spark, sf):
    return _daily(spark, sf)


@query("count_of_counts", O.with_base("SELECT * FROM coc", DAILY))
def count_of_counts(spark, sf):
    return P.count_of_counts(_daily(spark, sf))


@query("pareto", O.with_base("""
SELECT transaction_count, counts,
       CAST(sum(counts) OVER (ORDER BY transaction_count ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumsum,
       sum(counts) OVER (ORDER BY transaction_count ROWS UNBOUNDED PRECEDING) / sum(counts) OVER () AS proportion
FROM coc""", DAILY, doubles=["proportion"]))
def pareto(spark, sf):
    """Running count and share over the count-of-counts table."""
    return Wn.pareto(P.count_of_counts(_daily(spark, sf)))


@query("category_coverage", O.with_base("""
SELECT payment_method_id, n AS count, n / sum(n) OVER () AS share,
       sum(n) OVER (ORDER BY n DESC, payment_method_id ROWS UNBOUNDED PRECEDING) * 100.0 / sum(n) OVER () AS cum_pct
FROM (SELECT payment_method_id, count(*) AS n FROM silver_tx_feat
      WHERE payment_method_id IS NOT NULL GROUP BY payment_method_id) x""", doubles=["share", "cum_pct"]))
def category_coverage(spark, sf):
    """Payment methods by descending share with cumulative percent (basis of the rare lists)."""
    from renewcast.catalog.features import silver_tx_feat
    return Wn.category_coverage(silver_tx_feat(spark, sf), "payment_method_id")


@query("null_profile", O.with_base("""
SELECT 'msno' AS "column", CAST(count_if(msno IS NULL) AS BIGINT) AS null_count FROM members UNION ALL
SELECT 'city', CAST(count_if(city IS NULL) AS BIGINT) FROM members UNION ALL
SELECT 'gender', CAST(count_if(gender IS NULL) AS BIGINT) FROM members UNION ALL
SELECT 'registered_via', CAST(count_if(registered_via IS NULL) AS BIGINT) FROM members UNION ALL
SELECT 'registration_init_time', CAST(count_if(registration_init_time IS NULL) AS BIGINT) FROM members"""))
def null_profile(spark, sf):
    return P.null_profile(fx.members(spark, sf))


@query("schema_profile", O.with_base("""
SELECT c AS "column", CAST(pos AS INTEGER) AS position, dtype, non_null, n_rows FROM (
  SELECT 'msno' AS c, 0 AS pos, 'string' AS dtype, count(msno) AS non_null, count(*) AS n_rows FROM members UNION ALL
  SELECT 'city', 1, 'string', count(city), count(*) FROM members UNION ALL
  SELECT 'gender', 2, 'string', count(gender), count(*) FROM members UNION ALL
  SELECT 'registered_via', 3, 'string', count(registered_via), count(*) FROM members UNION ALL
  SELECT 'registration_init_time', 4, 'date', count(registration_init_time), count(*) FROM members) x"""))
def schema_profile(spark, sf):
    return P.schema_profile(fx.members(spark, sf))


_DESC_COLS = ["payment_plan_days", "plan_list_price", "actual_amount_paid", "is_auto_renew", "is_cancel"]


def _describe_sql():
    parts = []
    for c in _DESC_COLS:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(f"""SELECT '{c}' AS "column", count({x}) AS count, avg({x}) AS mean, stddev_samp({x}) AS std,
       min({x}) AS min, quantile_cont({x}, 0.25) AS p25, quantile_cont({x}, 0.5) AS p50,
       quantile_cont({x}, 0.75) AS p75, max({x}) AS max FROM transactions""")
    return O.with_base(" UNION ALL\n".join(parts), doubles=["mean", "std", "min", "p25", "p50", "p75", "max"])


@query("describe_profile", _describe_sql())
def describe_profile(spark, sf):
    """count/mean/std/min/quartiles/max; exact quartiles by distributed selection."""
    return P.describe_profile(fx.transactions(spark, sf), _DESC_COLS)


@query("describe_profile__approx")
def describe_profile_approx(spark, sf):
    """Same profile with ``percentile_approx`` quartiles (bounded memory, rows-only check)."""
    return P.describe_profile(fx.transactions(spark, sf), _DESC_COLS, approx=True)


_RANGE = ("1997-03-01", "1999-02-28")


@query("describe_profile__day_range", O.with_base(" UNION ALL ".join(f"""
SELECT '{c}' AS "column", count(CAST({c} AS DOUBLE)) AS count, avg(CAST({c} AS DOUBLE)) AS mean, stddev_samp(CAST({c} AS DOUBLE)) AS std,
       min(CAST({c} AS DOUBLE)) AS min, max(CAST({c} AS DOUBLE)) AS max, true AS ranks_hold
FROM transactions WHERE transaction_date BETWEEN DATE '{_RANGE[0]}' AND DATE '{_RANGE[1]}'""" for c in _DESC_COLS), doubles=["mean", "std", "min", "max"]))
def describe_profile_day_range(spark, sf):
    """A range of days described from one written sketch per day and column; the quartiles' ranks are held against the rows."""
    from renewcast.operators import sketches as S
    from renewcast.session import written
    tx = fx.transactions(spark, sf)
    layer = written(S.day_sketches(tx, "transaction_date", _DESC_COLS), "day_sketches")
    found = written(S.describe_days(layer, *_RANGE), "described_days")
    values = tx.where(F.col("transaction_date").between(*[F.lit(d).cast("date") for d in _RANGE]))
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in _DESC_COLS)
    long = values.select(F.expr(f"stack({len(_DESC_COLS)}, {pairs}) AS (column, value)"))
    near = [((F.avg((F.col("value") < F.col(p)).cast("double")) <= q + S.RANK_ERROR)
             & (F.avg((F.col("value") <= F.col(p)).cast("double")) >= q - S.RANK_ERROR)) for q, p in ((.25, "p25"), (.5, "p50"), (.75, "p75"))]
    ranks = long.join(found, "column").groupBy("column").agg((near[0] & near[1] & near[2]).alias("ranks_hold"))
    return found.join(ranks, "column").select("column", "count", "mean", "std", "min", "max", "ranks_hold")


@query("top_counts__values", O.with_base("""
SELECT *, true AS proved FROM (
  SELECT msno AS value, count(*) AS count FROM user_logs GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)"""))
def top_counts_values(spark, sf):
    """The ten users with most log rows, by counters and an exact count of the candidates, with the proof that none is missing."""
    from renewcast.operators import sketches as S
    return S.top_values(fx.user_logs(spark, sf).select("msno"), "msno", 10)


@query("distinct_values", O.with_base("""
SELECT DISTINCT CAST(datediff('day', membership_start_date, membership_expire_date) AS INTEGER) AS plan_days
FROM tx_start"""))
def distinct_values(spark, sf):
    from renewcast.functions.scalar import membership_start, plan_days
    t = fx.transactions(spark, sf).withColumn(
        "membership_start_date", membership_start("membership_expire_date", "payment_plan_days"))
    return P.distinct_values(t.select(plan_days("membership_start_date", "membership_expire_date")
                                      .alias("plan_days")), "plan_days")


@query("burst_share", O.with_base("""
SELECT count(*) AS total_rows, count(b.msno) AS burst_rows,
       avg(CASE WHEN b.msno IS NULL THEN 0 ELSE 1 END) AS burst_share
FROM transactions t LEFT JOIN burst_all b ON b.msno = t.msno""", doubles=["burst_share"]))
def burst_share(spark, sf):
    tx = fx.transactions(spark, sf)
    return P.burst_share(tx, flt.burst_users(tx, n=fx.BURST_THRESHOLD_ORDERS))


@query("gap_histogram", O.with_base("""
SELECT CAST(b.bin AS INTEGER) AS bin, coalesce(c.n, 0) AS count
FROM range(49) b(bin)
LEFT JOIN (SELECT CAST(CASE WHEN days_diff = 49 THEN 48 ELSE floor(days_diff) END AS INTEGER) AS bin, count(*) AS n
           FROM nb_gap WHERE days_diff >= 0 AND days_diff <= 49 GROUP BY 1) c ON c.bin = b.bin""", _NB_TX))
def gap_histogram(spark, sf):
    """Days between cancellation and resubscription, 49 unit bins, last one closed."""
    return P.gap_histogram(spark, L.cancel_resume_gap(_nb_tx(spark, sf)), "days_diff", 49)


@query("share_within", O.with_base("""
SELECT CAST(x.d AS INTEGER) AS days, CAST(count_if(g.days_diff <= x.d) AS BIGINT) AS n_within,
       count_if(g.days_diff <= x.d) / count(*) AS share
FROM nb_gap g CROSS JOIN (SELECT unnest([5, 10, 15, 20, 25, 30, 35, 40, 45]) AS d) x
GROUP BY x.d""", _NB_TX, doubles=["share"]))
def share_within(spark, sf):
    return P.share_within(L.cancel_resume_gap(_nb_tx(spark, sf)), "days_diff")


@query("top_counts", O.with_base("""
SELECT * FROM daily ORDER BY transaction_count DESC, msno, transaction_date, is_cancel LIMIT 10""", DAILY))
def top_counts(spark, sf):
    """Top 10 user-days by transaction count (the limit is the feature)."""
    return P.top_counts(_daily(spark, sf), "transaction_count", ["msno", "transaction_date", "is_cancel"], 10)


@query("head", O.with_base("SELECT * FROM silver_members ORDER BY msno LIMIT 5"))
def head(spark, sf):
    """Five preview rows in key order."""
    from renewcast.plans.features import silver_members
    return P.head(silver_members(fx.members(spark, sf)), ["msno"], 5)


_SAMPLE = """
ranked AS (
  SELECT *, row_number() OVER (
      PARTITION BY churn
      ORDER BY md5(concat_ws('|', coalesce(CAST(msno AS VARCHAR), ''),
                             coalesce(CAST(membership_start_date AS VARCHAR), ''),
                             coalesce(CAST(membership_expire_date AS VARCHAR), ''), '42')),
               next_transaction_date NULLS FIRST, days_diff NULLS FIRST) AS rn
  FROM gold_label)"""
_KEY = ["msno", "membership_start_date", "membership_expire_date"]
_TIE = ["next_transaction_date", "days_diff"]


@query("sample_per_class", O.with_base("""
SELECT msno, membership_start_date, membership_expire_date, next_transaction_date, days_diff, churn
FROM ranked WHERE rn <= 5""", GOLD_LABEL + "," + _SAMPLE))
def sample_per_class(spark, sf):
    """5 label rows per class, first in md5(key, seed) order (repeatable)."""
    return P.sample_per_class(_labels(spark, sf, 0), "churn", _KEY, n=5, seed=42, tie=_TIE)


@query("concat_samples", O.with_base("""
SELECT msno, membership_start_date, membership_expire_date, next_transaction_date, days_diff, churn
FROM ranked WHERE rn <= 5""", GOLD_LABEL + "," + _SAMPLE))
def concat_samples(spark, sf):
    """UNION ALL of the per-class samples (churned, then retained)."""
    lab = _labels(spark, sf, 0)
    parts = [P.sample_per_class(lab.where(F.col("churn") == v), "churn", _KEY, 5, 42, _TIE) for v in (1, 0)]
    return parts[0].unionByName(parts[1])


@query("dedupe_first", O.with_base("""
SELECT msno, membership_start_date, membership_expire_date, tx_id, payment_method_id FROM (
  SELECT *, row_number() OVER (PARTITION BY msno, membership_start_date, membership_expire_date
                               ORDER BY tx_id) AS rn FROM silver_tx_feat) x WHERE rn = 1"""))
def dedupe_first(spark, sf):
    """First transaction per period key by tie-break (13 repeated keys at sf0.01)."""
    from renewcast.catalog.features import silver_tx_feat
    t = silver_tx_feat(spark, sf).select(*_KEY, "tx_id", "payment_method_id")
    return Wn.dedupe_first(t, _KEY, ["tx_id"])


@query("canonical_order", O.with_base("""
SELECT msno, tx_id, CAST(row_number() OVER (PARTITION BY msno ORDER BY transaction_date NULLS LAST,
                                       membership_expire_date NULLS LAST, tx_id NULLS LAST) AS INTEGER) AS seq
FROM silver_tx_label"""))
def canonical_order(spark, sf):
    """Per-user position in (transaction date, expiry, tie-break) order, after the burst filter."""
    t = L.silver_transactions(fx.transactions(spark, sf), W, fx.BURST_THRESHOLD_ORDERS, with_discount=False)
    return P.canonical_order(t).select("msno", "tx_id", "seq")


@query("union_by_name", O.with_base("""
SELECT tx_id, msno, transaction_date AS day FROM transactions UNION ALL
SELECT NULL AS tx_id, msno, date AS day FROM user_logs"""))
def union_by_name(spark, sf):
    """UNION ALL by column name of two inputs with different columns in different orders: transactions and logs."""
    a = fx.transactions(spark, sf).select("tx_id", "msno", F.col("transaction_date").alias("day"))
    b = fx.user_logs(spark, sf).select(F.col("date").alias("day"), "msno")
    return a.unionByName(b, allowMissingColumns=True)
