"""Mergeable summaries, the bit prefilter, the one-row sweep, blocked trapezoid, split by hash edge, order without a user."""
import random
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from renewcast.operators import joins as J
from renewcast.operators import metrics as M
from renewcast.operators import prep as PR
from renewcast.operators import profiles as P
from renewcast.operators import sketches as S
from renewcast.session import written


# ------------------------------------------------------------------ quantile sketches

@pytest.fixture(scope="module")
def days(spark):
    rng = random.Random(2)
    rows = [(f"2020-01-{1 + i % 9:02d}", rng.gauss(5e5, 3.0) if i % 9 else rng.random(), None if i % 11 == 0 else float(i % 4)) for i in range(9000)]
    df = spark.createDataFrame(rows, "d string, x double, y double").withColumn("d", F.col("d").cast("date"))
    return rows, written(S.day_sketches(df, "d", ["x", "y"]), "test_sketches")


def test_ranges_of_days_from_sketches_alone(days):
    rows, layer = days
    for lo, hi in (("2020-01-01", "2020-01-09"), ("2020-01-02", "2020-01-05"), ("2020-01-07", "2020-01-07")):
        got = {r["column"]: r for r in S.describe_days(layer, lo, hi).collect()}
        for k, c in ((1, "x"), (2, "y")):
            v = sorted(r[k] for r in rows if lo <= r[0] <= hi and r[k] is not None)
            r = got[c]
            assert r["count"] == len(v) and r["min"] == v[0] and r["max"] == v[-1]
            assert r["mean"] == pytest.approx(statistics.fmean(v), rel=1e-12) and r["std"] == pytest.approx(statistics.stdev(v), rel=1e-7)
            for q, p in ((.25, "p25"), (.5, "p50"), (.75, "p75")):
                below, upto = sum(x < r[p] for x in v) / len(v), sum(x <= r[p] for x in v) / len(v)
                assert below <= q + S.RANK_ERROR and upto >= q - S.RANK_ERROR


def test_merging_order_does_not_change_what_is_exact(days):
    _, layer = days
    a, b = (S.describe_days(x).drop("p25", "p50", "p75").orderBy("column").collect() for x in (layer.repartition(7), layer.coalesce(1)))
    for x, y in zip(a, b):
        assert x["column"] == y["column"] and list(x)[1:] == pytest.approx(list(y)[1:], rel=1e-12)


def test_no_days_and_single_rows(spark):
    df = spark.createDataFrame([("2020-01-01", 3.0, None)], "d string, x double, y double").withColumn("d", F.col("d").cast("date"))
    one = S.describe_days(S.day_sketches(df, "d", ["x", "y"])).collect()
    assert [(r["column"], r["count"], r["std"], r["p50"]) for r in one] == [("x", 1, None, 3.0)]
    assert S.describe_days(S.day_sketches(df, "d", ["x"]), "2021-01-01").collect() == []


# ------------------------------------------------------------------ heavy values

def test_top_values_equal_the_exact_ones_when_proved(spark):
    rng = random.Random(5)
    values = [f"u{rng.randrange(10 ** 9)}" for _ in range(8000)] + [f"h{k}" for k in range(30) for _ in range(40 - k)] + [None] * 500
    rng.shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "v string")
    exact = sorted(Counter(v for v in values if v is not None).items(), key=lambda x: (-x[1], x[0]))
    got = S.top_values(df, "v", 10, counters=4096, candidates=64).collect()
    assert [(r["value"], r["count"]) for r in got] == exact[:10] and all(r["proved"] for r in got)
    few = S.top_values(df, "v", 10, counters=16, candidates=3).collect()
    assert not any(r["proved"] for r in few)                     # and says so
    every = S.top_values(df, "v", 10, counters=16, candidates=16).collect()
    assert [(r["value"], r["count"], r["proved"]) for r in every] == [(*x, True) for x in exact[:10]]


def test_counters_of_days_add_up(spark):
    df = spark.createDataFrame([(d, f"v{(d * 7 + i) % 50}") for d in range(4) for i in range(90)], "d int, v string")
    summary = S.value_counters(df, "v", 1024, by=["d"])
    assert S.top_values(df, "v", 5, 1024, 100, summary).collect() == S.top_values(df, "v", 5, 1024, 100).collect()
    assert S.top_values(df.limit(0), "v", 5).collect() == []


# ------------------------------------------------------------------ bit filter

def test_bit_filter_passes_every_member_and_few_others(spark):
    keys = spark.range(0, 20_000, 10).select(F.concat(F.lit("u"), F.col("id")).alias("k")).unionByName(spark.createDataFrame([(None,)], "k string"))
    bits = S.filter_bits(keys, "k")
    filter_ = S.bit_filter(keys, "k", bits)
    assert filter_.select(F.octet_length("bits")).first()[0] == bits // 8
    every = spark.range(20_000).select(F.concat(F.lit("u"), F.col("id")).alias("k"), (F.col("id") % 10 == 0).alias("member"))
    passed = {r["member"]: r["count"] for r in every.where(S.may_contain("k", filter_, bits)).groupBy("member").count().collect()}
    assert passed[True] == 2000 and passed.get(False, 0) < 18_000 * 0.02
    none = S.bit_filter(keys.limit(0), "k", S.BITMAP)
    assert every.where(S.may_contain("k", none, S.BITMAP)).count() == 0


def test_prefiltered_interval_join(spark):
    logs = spark.range(30_000).select(F.concat(F.lit("u"), F.col("id") % 1000).alias("msno"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 90).cast("int")).alias("date"))
    periods = spark.range(100).select(F.concat(F.lit("u"), F.col("id") * 10).alias("msno"), F.lit("2020-01-15").cast("date").alias("membership_start_date"),
                                      F.lit("2020-02-14").cast("date").alias("membership_expire_date"))
    plain, fast = J.interval_join(logs, periods), J.interval_join(logs, periods, prefilter=True)
    assert sorted(map(tuple, fast.collect())) == sorted(map(tuple, plain.collect())) and plain.count() > 500
    users = periods.select("msno")
    bits = S.filter_bits(users, "msno")
    left = logs.where(S.may_contain("msno", S.bit_filter(users, "msno", bits), bits)).count()
    assert 3000 <= left <= 3000 * 1.15                            # a tenth of the users have periods
    conf = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "-1")
    try:
        plan = J.interval_join(logs, periods, prefilter=True)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(conf, before)
    assert plan.index("Exchange hashpartitioning(msno") < plan.index("getbit")      # the test stands below the exchange


# ------------------------------------------------------------------ metrics

def plain_sweep(rows, cuts):
    return [(c, sum(y for s, y in rows if s >= c), sum(1 - y for s, y in rows if s >= c), sum(y for s, y in rows if s < c), sum(1 - y for s, y in rows if s < c))
            for c in cuts]


@pytest.mark.parametrize("cuts", [None, [0.5], [0.3, 0.1, 0.2], [i / 7 for i in range(8)]])
def test_sweep_against_plain_counts(spark, cuts):
    rng = random.Random(1)
    rows = [(round(rng.random(), 2), rng.randrange(2)) for _ in range(500)]
    df = spark.createDataFrame(rows + [(None, 1), (0.5, None)], "score double, y_true int")
    got = M.threshold_sweep(spark, df, cutoffs=cuts).select("threshold", "tp", "fp", "fn", "tn").collect()
    assert sorted(map(tuple, got)) == plain_sweep(rows, sorted(cuts or M.default_cutoffs()))
    assert sorted(map(tuple, M.threshold_sweep(spark, df.limit(0), cutoffs=cuts).select("threshold", "tp", "fp", "fn", "tn").collect())) \
        == plain_sweep([], sorted(cuts or M.default_cutoffs()))


def test_sweep_has_one_aggregate_over_the_rows(spark):
    df = spark.range(1000).select((F.col("id") / 1000).alias("score"), (F.col("id") % 2).cast("int").alias("y_true"))
    plan = M.threshold_sweep(spark, df)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "UDF" not in plan and plan.count("Exchange") == 2


def test_trapezoid_in_blocks_equals_the_area(spark):
    rng = random.Random(3)
    rows = [(g, round(rng.random(), 2) if g else rng.random(), rng.randrange(2)) for g in (0, 1, None) for _ in range(700)]
    df = spark.createDataFrame(rows, "g int, score double, y_true int")
    area = {r["g"]: r["auc"] for r in M.roc_area_trapezoid(M.roc_curve(df, by=["g"]), ["g"]).collect()}
    want = {r["g"]: r["auc"] for r in M.roc_auc(df, by=["g"]).collect()}
    assert area == pytest.approx(want, abs=1e-12) and len(area) == 3
    one = M.roc_area_trapezoid(M.roc_curve(df)).first()["auc"]
    assert one == pytest.approx(M.roc_auc(df).first()["auc"], abs=1e-12)
    plan = M.roc_area_trapezoid(M.roc_curve(df))._jdf.queryExecution().executedPlan().toString()
    # the one window without a key runs over a row per block
    assert plan.count("Window") == 2


# ------------------------------------------------------------------ split and order

def plain_split(rows, fraction, seed):
    import hashlib
    out = {}
    for c in {r[1] for r in rows}:
        own = sorted((hashlib.md5(f"{k}|{seed}".encode()).hexdigest(), t, k) for k, y, t in rows if y == c)
        n = int(fraction * len(own) + 0.5)
        for i, (_, t, k) in enumerate(own):
            out[k, t] = int(i < n)
    return out


@pytest.mark.parametrize("copies", [1, 7])
def test_split_by_the_edge_hash(spark, copies):
    rows = [(f"k{i // copies}", i // copies % 3, i) for i in range(700)] + [("lone", 9, 0)]
    df = spark.createDataFrame(rows, "k string, y int, t int").repartition(5)
    got = PR.stratified_split(df, "y", ["k"], 0.2, 11, tie=["t"])
    assert got.columns == ["k", "y", "t", "is_test"]
    assert {(r["k"], r["t"]): r["is_test"] for r in got.collect()} == plain_split(rows, 0.2, 11)
    if copies == 1:
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "Window" not in plan
    assert PR.stratified_split(df.limit(0), "y", ["k"], 0.2, 11).collect() == []
    assert {r["is_test"] for r in PR.stratified_split(df, "y", ["k"], 0.0, 11).collect()} == {0}
    assert {r["is_test"] for r in PR.stratified_split(df, "y", ["k"], 1.0, 11).collect()} == {1}


def test_rows_without_a_user_have_no_position(spark):
    rows = [("a", "2020-01-02", 1), ("a", "2020-01-01", 2), (None, "2020-01-01", 3), (None, None, 4)]
    df = spark.createDataFrame(rows, "msno string, transaction_date string, tx_id int").withColumn("membership_expire_date", F.col("transaction_date"))
    assert {r["tx_id"]: r["seq"] for r in P.canonical_order(df).collect()} == {1: 2, 2: 1, 3: None, 4: None}
