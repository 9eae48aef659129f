"""The layered run writes the same feature store and model set as the lazy queries."""

from collections import Counter

from pyspark.sql import functions as F

from sf_paths import SF_SMALL
from renewcast.catalog.features import gold
from renewcast.catalog.prep import model_set
from renewcast.plans.medallion import run_layers
from renewcast.registry import round_doubles
from renewcast.sources import fixtures as fx


def _rows(df, cols):
    return Counter(tuple(r) for r in round_doubles(df.select(*cols)).collect())


def test_layers_match_queries(spark, tmp_path):
    paths = run_layers(spark, fx.transactions(spark, SF_SMALL), fx.user_logs(spark, SF_SMALL),
                       fx.members(spark, SF_SMALL), str(tmp_path / "layers"),
                       window=(fx.WINDOW_LO, fx.WINDOW_HI), burst_n=fx.BURST_THRESHOLD_ORDERS,
                       secs_bounds=(fx.SECS_LO, fx.SECS_HI), tail_end=fx.TAIL_END, tail_days=fx.TAIL_DAYS,
                       split_bounds=(fx.SPLIT_TRAIN_BEFORE, fx.SPLIT_OOT_END, fx.SPLIT_INFERENCE_AFTER))
    g = gold(spark, SF_SMALL)
    written = spark.read.parquet(paths["gold_features"])
    assert _rows(written, g.columns) == _rows(g, g.columns)
    ms = model_set(spark, SF_SMALL)
    train = spark.read.parquet(paths["model_set"] + "/train")
    oot = spark.read.parquet(paths["model_set"] + "/oot")
    inf = spark.read.parquet(paths["model_set"] + "/inference")
    cols = [c for c in ms.columns if c != "split"]
    assert _rows(train, cols) == _rows(ms.where(F.col("split") == "train"), cols)
    assert _rows(oot, cols) == _rows(ms.where(F.col("split") == "oot"), cols)
    assert _rows(inf, cols) == _rows(ms.where(F.col("split") == "inference"), cols)


def test_bundle_round_trip_keeps_info(spark, tmp_path):
    from renewcast.operators import models as ML
    from renewcast.plans import training as T
    p = T.prepare(spark, model_set(spark, SF_SMALL))
    b = T.fit_bundle(spark, p, "logistic", {"C": 1.0, "penalty": "l2"}, evaluate=True)
    ML.save_bundle(spark, b, str(tmp_path / "b"))
    back = ML.load_bundle(spark, str(tmp_path / "b"))
    assert back.threshold == b.threshold and back.vocabulary == b.vocabulary
    assert back.info["feature_count"] == len(back.info["feature_names"]) == len(p.names)
    assert {"test_auc", "test_f1_5", "test_fn_rate", "sample_size"} <= set(back.info)
    a = T.score_batch(b, p.test).orderBy("msno", "membership_start_date").collect()
    c = T.score_batch(back, p.test).orderBy("msno", "membership_start_date").collect()
    assert [r["probability"] for r in a] == [r["probability"] for r in c]
