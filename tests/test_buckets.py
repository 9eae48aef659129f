"""Bucketed layers: same rows, joined without an exchange, no catalogue entry left."""
from pyspark.sql import functions as F

from renewcast.operators import joins as J
from renewcast.session import written_buckets


def test_bucketed_tables_join_without_exchange(spark):
    a = spark.range(5000).select((F.col("id") * 7 % 5003).alias("k"), F.col("id").alias("v"))
    b = spark.range(0, 5000, 3).select(F.col("id").alias("k"))
    conf = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "-1")
    try:
        x, y = written_buckets(a, "left_rows", "k", 4), written_buckets(b, "right_rows", "k", 4)
        joined = x.join(y, "k", "left_anti")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert sorted(joined.collect()) == sorted(a.join(b, "k", "left_anti").collect())
    finally:
        spark.conf.set(conf, before)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(("left_rows", "right_rows"))]


def frames(spark, hot=0):
    tx = spark.range(3000).select(F.concat(F.lit("u"), F.when(F.col("id") < hot, 0).otherwise(F.col("id") % 400)).alias("msno"),
                                  F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 7).cast("int")).alias("membership_start_date"),
                                  F.col("id").alias("tx_id")).withColumn("membership_expire_date", F.date_add("membership_start_date", 30))
    tx = tx.unionByName(spark.createDataFrame([(None, 9999)], "msno string, tx_id long"), allowMissingColumns=True)
    keys = J.PERIOD_KEY
    features = tx.select(*keys).distinct().select(*keys, F.xxhash64(*keys).alias("f")).where("f % 5 <> 0")
    members = tx.select("msno").distinct().select("msno", F.length("msno").alias("city")).where("msno <> 'u3'")
    return tx, features, members


def test_bucketed_store_equals_the_joins(spark):
    for hot in (0, 1200):                                  # no hot user, and one with over a third of the rows
        tx, features, members = frames(spark, hot)
        want = J.member_join(J.feature_join(tx, features), members)
        got = J.bucketed_feature_store(tx, features, members, buckets=6)
        assert sorted(got.columns) == sorted(want.columns)
        assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect())) and want.count() > 1000


def test_bucketed_joins_have_no_exchange(spark):
    conf = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "-1")
    try:
        layers = [written_buckets(x, n, "msno", 4) for n, x in zip(("bt", "bf", "bm"), frames(spark))]
        with J.co_partitioned(spark):
            plan = J.join_buckets(*layers)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 2 and "Exchange" not in plan
    finally:
        spark.conf.set(conf, before)
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition", "true") == "true"
