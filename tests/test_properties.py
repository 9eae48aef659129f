"""Properties: partitions of the data, running sums, metric identities, partitioning invariance."""

from collections import Counter

from pyspark.sql import Window
from pyspark.sql import functions as F

from sf_paths import SF_MID, SF_SMALL
from renewcast.catalog.prep import model_set
from renewcast.operators import metrics as M
from renewcast.operators import prep as PR
from renewcast.operators.windows import running_sum
from renewcast.plans import labels as L
from renewcast.sources import fixtures as fx

KEY = ["msno", "membership_start_date", "membership_expire_date"]


def _rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_running_sum_matches_plain_window_with_null_group(spark):
    df = spark.range(0, 5000).select(
        F.when(F.col("id") % 7 == 0, F.lit(None)).otherwise((F.col("id") % 3).cast("string")).alias("g"),
        F.col("id").alias("k"), (F.col("id") % 11).alias("v"))
    rs = running_sum(df, ["k"], ["v"], group=["g"], with_total=True)
    w = Window.partitionBy("g").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    ref = df.select("g", "k", "v", F.sum("v").over(w).alias("v_cum"),
                    F.sum("v").over(Window.partitionBy("g")).alias("v_total"))
    assert _rows(rs.select("g", "k", "v", "v_cum", "v_total")) == _rows(ref)


def test_split_and_folds_partition_the_rows(spark):
    ms = model_set(spark, SF_MID).cache()
    n = ms.count()
    assert ms.groupBy("split").count().agg(F.sum("count")).first()[0] == n
    tr = PR.stratified_split(ms.where(F.col("split") == "train"), "churn", KEY, 0.2, 611)
    per = {r["churn"]: (r["n"], r["t"]) for r in tr.groupBy("churn").agg(
        F.count(F.lit(1)).alias("n"), F.sum("is_test").alias("t")).collect()}
    for n_c, t_c in per.values():
        assert t_c == round(0.2 * n_c + 1e-9)
    folds = PR.stratified_folds(tr.where(F.col("is_test") == 0), "churn", KEY, 3, 42)
    sizes = folds.groupBy("churn", "fold").count().collect()
    by_class = {}
    for r in sizes:
        by_class.setdefault(r["churn"], []).append(r["count"])
    for counts in by_class.values():
        assert len(counts) == 3 and max(counts) - min(counts) <= 1
    assert folds.select(*KEY).distinct().count() == folds.count()
    ms.unpersist()


def test_confusion_sums_to_rows_and_auc_flips(spark):
    s = fx.scored_predictions(spark, SF_SMALL)
    c = M.confusion_counts(s.withColumn("y_pred", (F.col("score") >= 0.5).cast("int"))).first()
    assert c["tn"] + c["fp"] + c["fn"] + c["tp"] == s.count()
    a = M.roc_auc(s).first()["auc"]
    b = M.roc_auc(s.withColumn("score", 1 - F.col("score"))).first()["auc"]
    assert abs(a + b - 1) < 1e-12
    t = M.roc_area_trapezoid(M.roc_curve(s)).first()["auc"]
    assert abs(a - t) < 1e-12


def test_labels_unchanged_under_repartition(spark):
    t = fx.transactions(spark, SF_SMALL)
    a = L.renewal_labels(t, window=(fx.WINDOW_LO, fx.WINDOW_HI), burst_n=1, tail_end=fx.TAIL_END,
                         tail_days=fx.TAIL_DAYS)
    b = L.renewal_labels(t.repartition(13, "tx_id"), window=(fx.WINDOW_LO, fx.WINDOW_HI), burst_n=1,
                         tail_end=fx.TAIL_END, tail_days=fx.TAIL_DAYS)
    assert _rows(a) == _rows(b)


def _block_sizes(df, order, group=(), blocks=16):
    from renewcast.operators.windows import order_blocks
    d = order_blocks(df, order, group, blocks)
    return sorted(r["count"] for r in d.groupBy("_blk").count().collect())


def test_order_blocks_are_even_on_ties_and_on_concentrated_scores(spark):
    from pyspark.sql import functions as F
    # a near-unique category column: every count is 1, the value decides
    ties = spark.range(20_000).select(F.concat(F.lit("c"), F.col("id")).alias("v"), F.lit(1).alias("n"))
    # scores of a rare event: nearly all of them in a narrow range near 0
    low = spark.range(20_000).select((F.pow(F.col("id") / 20_000, 8) * 0.9).alias("score"))
    for sizes in (_block_sizes(ties, [F.col("n").desc(), F.col("v").asc()]), _block_sizes(low, [F.col("score").asc()])):
        assert sum(sizes) == 20_000 and len(sizes) >= 14 and sizes[-1] <= 3 * 20_000 / 16


def test_order_blocks_rise_with_the_order(spark):
    from pyspark.sql import functions as F
    from renewcast.operators.windows import order_blocks
    rows = [(g, v) for g in (None, "a", "b") for v in (None, -5.0, 0.0, 0.5, 1.0, 9.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = order_blocks(df, [F.col("v").desc_nulls_last()], ["g"], 5).collect()
    key = lambda r: (r["g"] is not None, r["g"] or "", r["v"] is None, -(r["v"] or 0.0))
    ids = [r["_blk"] for r in sorted(got, key=key)]
    assert len(got) == len(rows) and ids == sorted(ids)


def test_category_coverage_of_a_near_unique_column(spark):
    from renewcast.operators.windows import category_coverage
    df = spark.createDataFrame([(f"k{i:05d}",) for i in range(3000)] + [("k00007",)] * 2, "c string")
    rows = {r["c"]: r for r in category_coverage(df, "c").collect()}
    assert len(rows) == 3000 and rows["k00007"]["count"] == 3 and abs(rows["k02999"]["cum_pct"] - 100.0) < 1e-9
    assert abs(rows["k00000"]["cum_pct"] - 100.0 * 4 / 3002) < 1e-9


def test_tuning_auc_is_exact_on_many_scores(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.sql import functions as F
    df = spark.range(20_000).select((F.xxhash64("id") % 1000 < F.col("id") % 977).cast("double").alias("churn"),
                                    ((F.xxhash64(F.col("id") + 1) % 1_000_003) / 1e6 + F.col("id") % 7).alias("rawPrediction"))
    assert df.select("rawPrediction").distinct().count() > 19_000
    exact = M.roc_auc(df.select(F.col("churn").cast("int").alias("y_true"), F.col("rawPrediction").alias("score"))).first()["auc"]
    spark_auc = BinaryClassificationEvaluator(labelCol="churn", numBins=0).evaluate(df)
    assert abs(exact - spark_auc) < 1e-9


def _brute_auc(pairs):
    pos = [s for y, s in pairs if y == 1]
    neg = [s for y, s in pairs if y == 0]
    if not pos or not neg:
        return None
    wins = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return wins / (len(pos) * len(neg))


def test_roc_auc_equals_brute_force_on_random_data(spark):
    from hypothesis import given, settings, strategies as st

    @settings(max_examples=8, deadline=None)
    @given(st.lists(st.tuples(st.integers(0, 1), st.sampled_from([0.0, 0.1, 0.25, 0.5, 0.7, 0.9, 1.0])),
                    min_size=1, max_size=40))
    def check(pairs):
        df = spark.createDataFrame(pairs, "y_true int, score double")
        got = M.roc_auc(df).first()["auc"]
        want = _brute_auc(pairs)
        assert (got is None and want is None) or abs(got - want) < 1e-12

    check()


def test_threshold_sweep_equals_brute_force(spark):
    from hypothesis import given, settings, strategies as st

    cuts = M.default_cutoffs()

    @settings(max_examples=6, deadline=None)
    @given(st.lists(st.tuples(st.integers(0, 1), st.sampled_from([0.0, 0.1, 0.29, 0.3, 0.5, 0.505, 0.89, 0.9])),
                    min_size=1, max_size=30))
    def check(pairs):
        df = spark.createDataFrame(pairs, "y_true int, score double")
        got = {r["threshold"]: (r["tp"], r["fp"], r["fn"], r["tn"]) for r in M.threshold_sweep(spark, df).collect()}
        assert len(got) == len(cuts)
        for t in cuts:
            tp = sum(1 for y, s in pairs if y == 1 and s >= t)
            fp = sum(1 for y, s in pairs if y == 0 and s >= t)
            fn = sum(1 for y, s in pairs if y == 1 and s < t)
            tn = sum(1 for y, s in pairs if y == 0 and s < t)
            assert got[t] == (tp, fp, fn, tn)

    check()
