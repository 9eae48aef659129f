"""Hand-made edge cases (nulls, zeros, ties, bounds, quirks Q1-Q8)."""

import datetime as dt

from pyspark.sql import functions as F

from renewcast.functions import scalar as S
from renewcast.operators import filters as flt
from renewcast.operators import metrics as M
from renewcast.operators import prep as PR
from renewcast.operators import windows as W
from renewcast.plans import features as FP
from renewcast.plans import labels as L

D = dt.date
TX_SCHEMA = ("msno string, tx_id long, payment_method_id string, payment_plan_days int, plan_list_price double, "
             "actual_amount_paid double, is_auto_renew int, transaction_date date, "
             "membership_expire_date date, is_cancel int")


def tx(spark, rows):
    return spark.createDataFrame(rows, TX_SCHEMA)


def row(msno, tid, tdate, days, cancel=0, lp=100.0, paid=90.0, pm="41"):
    return (msno, tid, pm, days, lp, paid, 1, tdate, tdate + dt.timedelta(days=days), cancel)


def test_churn_flag_and_clamp(spark):
    df = spark.createDataFrame([(None,), (-3,), (0,), (5,), (6,)], "d int")
    out = df.select("d", S.clamp_non_negative("d").alias("c"),
                    S.churn_flag(S.clamp_non_negative("d"), 5, 0).alias("ch0"),
                    S.churn_flag(S.clamp_non_negative("d"), 5, 1).alias("ch1")).collect()
    got = {r["d"]: (r["c"], r["ch0"], r["ch1"]) for r in out}
    assert got[None] == (None, 0, 1)        # never returned: 0 in parity (Q1), 1 intended
    assert got[-3] == (0, 0, 0)
    assert got[0] == (0, 0, 0)
    assert got[5] == (5, 0, 0)              # grace is inclusive
    assert got[6] == (6, 1, 1)


def test_discount_ratio_zero_and_null_list_price(spark):
    df = spark.createDataFrame([(0.0, 5.0), (None, 5.0), (100.0, 75.0)], "lp double, paid double")
    got = [r[0] for r in df.select(S.discount_ratio("lp", "paid")).collect()]
    assert got == [0.0, 0.0, 0.25]


def test_guarded_ratio_null_and_zero(spark):
    df = spark.createDataFrame([(3, 0), (3, None), (3, 4)], "n int, d int")
    got = [r[0] for r in df.select(S.guarded_ratio("n", "d")).collect()]
    assert got == [0.0, None, 0.75]


def test_parse_malformed_dates(spark):
    df = spark.createDataFrame([("20160131",), ("2016-01-31",), ("20161331",), (None,), ("abc",)], "s string")
    got = [r[0] for r in df.select(S.parse_yyyymmdd("s")).collect()]
    assert got == [D(2016, 1, 31), None, None, None, None]


def test_bin_by_edges_right_closed(spark):
    df = spark.createDataFrame([(-1,), (0,), (5,), (6,), (None,)], "d int")
    got = [r[0] for r in df.select(S.bin_by_edges("d", [-1, 5, float("inf")], [0, 1])).collect()]
    assert got == [None, 0, 0, 1, None]


def test_map_rare_null_category(spark):
    df = spark.createDataFrame([("41",), ("38",), (None,)], "p string")
    got = [r[0] for r in df.select(S.map_rare("p", ["41"])).collect()]
    assert got == ["41", "99", "99"]


def test_burst_filter_threshold_and_null_keys(spark):
    d0 = D(2016, 1, 1)
    rows = [row("a", 1, d0, 30), row("a", 2, d0, 30),                      # n = 2 rows: kept at n = 2
            row("b", 3, d0, 30), row("b", 4, d0, 30), row("b", 5, d0, 30),  # n + 1 rows: dropped
            ("c", 6, "41", 30, 1.0, 1.0, 1, None, None, 0), ("c", 7, "41", 30, 1.0, 1.0, 1, None, None, 0),
            ("c", 8, "41", 30, 1.0, 1.0, 1, None, None, 0)]                # null dates form no group
    out = flt.drop_burst_users(tx(spark, rows), n=2)
    assert sorted({r["msno"] for r in out.collect()}) == ["a", "c"]


def test_next_transaction_skips_cancels_and_uses_tie_break(spark):
    d0 = D(2016, 1, 1)
    rows = [row("u", 1, d0, 30), row("u", 2, d0 + dt.timedelta(days=31), 30, cancel=1),
            row("u", 3, d0 + dt.timedelta(days=40), 30), row("u", 4, d0 + dt.timedelta(days=40), 90)]
    n = W.next_active_transaction(tx(spark, rows)).orderBy("tx_id").collect()
    # row 1 -> next non-cancel is row 3 (the cancel at day 31 is skipped); row 3 -> row 4 (tie on date)
    assert [(r["tx_id"], r["next_transaction_date"], r["days_diff"]) for r in n] == [
        (1, D(2016, 2, 10), 10), (3, D(2016, 2, 10), -30)]


def test_cancel_and_resume_same_day_and_early_expiry(spark):
    d0 = D(2016, 3, 1)
    rows = [row("x", 1, d0, 30, cancel=1), row("x", 2, d0, 30),                  # resume same day
            row("y", 3, d0, 60, cancel=1), row("y", 4, d0 + dt.timedelta(days=1), 30)]  # resume expires earlier
    g = L.cancel_resume_gap(tx(spark, rows)).collect()
    assert [(r["msno"], r["days_diff"]) for r in g] == [("x", 0)]


def test_drop_unresolved_tail(spark):
    df = spark.createDataFrame([(None, D(2017, 3, 31)), (None, D(2017, 3, 26)), (None, D(2017, 3, 25)),
                                (D(2017, 4, 2), D(2017, 3, 30))], "next_transaction_date date, membership_expire_date date")
    out = flt.drop_unresolved_tail(df, "2017-03-31", 5).collect()
    assert [r["membership_expire_date"] for r in out] == [D(2017, 3, 25), D(2017, 3, 30)]


def test_split_bounds_and_gap(spark):
    df = spark.createDataFrame([(D(2016, 10, 31),), (D(2016, 11, 1),), (D(2016, 11, 30),), (D(2016, 12, 1),),
                                (D(2016, 12, 2),)], "membership_start_date date")
    got = [r["split"] for r in flt.split_by_time(df).collect()]
    assert got == ["train", "oot", "oot", None, "inference"]


def _logs(spark, rows):
    return spark.createDataFrame(rows, "msno string, date date, num_25 int, num_50 int, num_75 int, num_985 int, "
                                       "num_100 int, num_unq int, total_secs double")


def test_usage_duplicates_multiply_and_edges(spark):
    d0 = D(2016, 1, 1)
    t = tx(spark, [row("u", 1, d0, 30), row("u", 2, d0, 30)])  # exact duplicate transaction (Q3)
    t = t.withColumn("membership_start_date", S.membership_start("membership_expire_date", "payment_plan_days"))
    logs = _logs(spark, [("u", D(2016, 1, 1), 1, 0, 0, 0, 1, 2, 100.0),    # first day, offset 0
                         ("u", D(2016, 1, 7), 0, 0, 0, 0, 0, 0, 10.0),     # offset 6: in the first 7 days
                         ("u", D(2016, 1, 8), 0, 0, 0, 0, 0, 0, 1.0),      # offset 7: not
                         ("u", D(2016, 1, 31), 0, 1, 0, 0, 0, 1, 50.0)])   # last day
    u = FP.usage_features(logs, t, lookback_months=None).collect()
    assert len(u) == 1
    r = u[0]
    assert r["sum_total_secs"] == 2 * 161.0            # duplicates double the sums
    assert r["total_secs_first_7_days"] == 2 * 110.0
    assert r["total_secs_last_7_days"] == 2 * 50.0
    assert r["sum_songs"] == 2 * 3
    assert abs(r["avg_unique_song_played_ratio"] - (1.0 + 0 + 0 + 1.0) / 4) < 1e-12   # zero songs -> 0
    d = FP.usage_features(logs, t, lookback_months=None, dedupe_periods=True).collect()[0]
    assert d["sum_total_secs"] == 161.0


def test_usage_overlapping_periods_and_missing_prior_month(spark):
    t = tx(spark, [row("u", 1, D(2016, 1, 20), 30), row("u", 2, D(2016, 2, 5), 30)])
    t = t.withColumn("membership_start_date", S.membership_start("membership_expire_date", "payment_plan_days"))
    logs = _logs(spark, [("u", D(2016, 2, 10), 1, 0, 0, 0, 0, 1, 5.0)])
    u = FP.usage_features(logs, t, lookback_months=1).collect()
    assert len(u) == 2                                   # one log row joins both overlapping periods
    # a period whose prior month holds no logs still gets its current-month logs
    assert {r["sum_total_secs"] for r in u} == {5.0}


def test_scaler_constant_column_and_unseen_category(spark):
    fit = spark.createDataFrame([(1.0, "a"), (1.0, "b")], "x double, c string")
    params = PR.scaler_params(PR.fit_scaler(fit, ["x"]))
    assert params["x"] == (1.0, 0.0)
    new = spark.createDataFrame([(3.0, "z")], "x double, c string")
    assert PR.apply_scaler(new, params).first()["x"] == 2.0          # zero std divides by 1
    oh = PR.one_hot(new, {"c": ["a", "b"]}, all_levels=("c",), drop_first=()).first()
    assert (oh["c_a"], oh["c_b"]) == (0, 0)                           # unseen level -> all zeros


def test_metrics_single_class_and_all_equal_scores(spark):
    one = spark.createDataFrame([(1, 1), (1, 0)], "y_true int, y_pred int")
    r = M.with_rates(M.confusion_counts(one)).first()
    assert (r["tn"], r["fp"], r["fn"], r["tp"]) == (0, 0, 1, 1)
    assert r["hard_auc"] is None and r["fn_rate"] == 1.0
    eq = spark.createDataFrame([(1, 0.3), (0, 0.3), (0, 0.3)], "y_true int, score double")
    assert M.roc_auc(eq).first()["auc"] == 0.5
    empty = spark.createDataFrame([], "y_true int, score double")
    assert M.roc_auc(empty).count() == 1 and M.roc_auc(empty).first()["auc"] is None


def test_threshold_sweep_edges(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.49), (1, 0.1), (0, 0.95)], "y_true int, score double")
    sw = {round(r["threshold"], 2): r for r in M.threshold_sweep(spark, df).collect()}
    assert len(sw) == 80
    assert (sw[0.5]["tp"], sw[0.5]["fp"]) == (1, 1)     # score exactly on the cut-off counts as positive
    assert (sw[0.1]["tp"], sw[0.1]["fp"]) == (2, 2)
    best = M.best_threshold(M.threshold_sweep(spark, df), "recall").first()
    assert round(best["threshold"], 2) == 0.1          # first of the tied maxima


def test_hash_fraction_split_and_path_readiness(spark, tmp_path):
    from renewcast.sources import io
    df = spark.range(0, 20000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 2).alias("y"))
    s = PR.stratified_split(df, "y", ["k"], 0.2, 611, exact=False)
    share = s.agg(F.avg("is_test")).first()[0]
    assert 0.18 < share < 0.22
    p = str(tmp_path / "t")
    df.write.parquet(p)
    r = {x["source"]: (x["row_count"], x["exists"]) for x in
         io.path_readiness(spark, {"t": p, "gone": str(tmp_path / "nope")}).collect()}
    assert r == {"t": (20000, True), "gone": (None, False)}
    import pytest
    with pytest.raises(FileNotFoundError):
        io.path_readiness(spark, {"gone": str(tmp_path / "nope")}, required=["gone"])


def test_empty_partitions_and_blocks(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.1), (1, 0.4), (0, 0.4)], "y_true int, score double").repartition(50)
    assert M.roc_auc(df).first()["auc"] == (1 + 0.5 + 1 + 1) / 4
    rs = W.running_sum(df.groupBy("score").agg(F.count(F.lit(1)).alias("n")), ["score"], ["n"], with_total=True)
    got = sorted((r["score"], r["n_cum"], r["n_total"]) for r in rs.collect())
    assert got == [(0.1, 1, 4), (0.4, 3, 4), (0.9, 4, 4)]
