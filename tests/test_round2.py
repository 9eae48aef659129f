"""CSV scans by header, rows without a user, the shared folder, one aggregate for the metrics."""
import os

import pytest
from pyspark.sql import functions as F

from renewcast import session
from renewcast.operators import metrics as M
from renewcast.operators import models as ML
from renewcast.operators import prep as PR
from renewcast.operators.windows import next_active_transaction
from renewcast.plans import labels as L
from renewcast.sources import io

TX = ["msno", "payment_method_id", "payment_plan_days", "plan_list_price", "actual_amount_paid", "is_auto_renew", "transaction_date",
      "membership_expire_date", "is_cancel"]


def _csv(tmp_path, name, lines):
    folder = tmp_path / name
    folder.mkdir()
    for k, text in enumerate(lines):
        (folder / f"part{k}.csv").write_text("\n".join(text) + "\n")
    return str(folder)


def test_raw_csv_binds_columns_by_name(spark, tmp_path):
    path = _csv(tmp_path, "tx", [[",".join(TX), "u1,41,30,149.0,149,1,20170101,20170131,0", "u2,40,x,1e400,,1,2017,20170201,1"]])
    rows = io.read_raw_csv(spark, path, io.RAW_TRANSACTIONS, ("transaction_date", "membership_expire_date")).collect()
    a, b = sorted(rows, key=lambda r: r["msno"])
    assert (a["msno"], a["payment_method_id"], a["plan_list_price"], str(a["transaction_date"])) == ("u1", "41", 149.0, "2017-01-01")
    assert b["payment_plan_days"] is None and b["actual_amount_paid"] is None and b["transaction_date"] is None


def test_raw_csv_drops_index_columns_and_names_what_is_missing(spark, tmp_path):
    logs = "num_25 num_50 num_75 num_985 num_100 num_unq total_secs".split()
    path = _csv(tmp_path, "logs", [[",msno,date," + ",".join(logs) + ",extra", "0,u1,20170301,1,2,3,4,5,6,7.5,z"]])
    row = io.read_raw_csv(spark, path, io.RAW_USER_LOGS, ("date",)).first()
    assert (row["msno"], str(row["date"]), row["num_25"], row["total_secs"]) == ("u1", "2017-03-01", 1, 7.5)
    with pytest.raises(ValueError, match="total_secs"):
        io.read_raw_csv(spark, _csv(tmp_path, "short", [["msno,date," + ",".join(logs[:-1]), "u,20170101,1,2,3,4,5,6"]]), io.RAW_USER_LOGS)


def test_raw_csv_files_of_another_layout_raise(spark, tmp_path):
    path = _csv(tmp_path, "mixed", [["msno,city,bd,gender,registered_via,registration_init_time", "u1,1,2,f,3,20170101"],
                                    ["city,msno,bd,gender,registered_via,registration_init_time", "1,u1,2,f,3,20170101"]])
    with pytest.raises(Exception, match="header|schema"):
        io.read_raw_csv(spark, path, io.RAW_MEMBERS).collect()


def _tx(spark, rows):
    return spark.createDataFrame(rows, "msno string, tx_id long, payment_plan_days int, transaction_date string, membership_expire_date string, is_cancel int") \
        .withColumns({c: F.col(c).cast("date") for c in ("transaction_date", "membership_expire_date")})


@pytest.mark.parametrize("method", ["lead", "day_blocks"])
def test_rows_without_a_user_get_no_label(spark, method):
    rows = [(u, k, 30, d, e, 0) for k, (u, d, e) in enumerate([(None, "2016-01-01", "2016-01-31"), (None, "2016-03-01", "2016-03-31"),
                                                               ("a", "2016-01-01", "2016-01-31"), ("a", "2016-02-01", "2016-03-02")])]
    out = next_active_transaction(_tx(spark, rows), method=method).collect()
    assert {r["msno"] for r in out} == {"a"} and len(out) == 2
    both = _tx(spark, [(None, 1, 30, "2016-01-01", "2016-01-31", 0), (None, 2, 30, "2016-01-02", "2016-01-31", 1)])
    assert L.cancel_behaviour(both).count() == 0


class _Conf:
    def __init__(self, **kw):
        self.kw = kw

    def get(self, key, default=None):
        return self.kw.get(key, default)


class _Session:
    """What ``shared_dir`` reads of a session, with a master that is not local."""
    def __init__(self, **kw):
        self.conf = _Conf(**kw)
        self.sparkContext = self

    def getCheckpointDir(self):
        return None


def test_shared_folder_is_required_off_local():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(_Session(**{"spark.master": "spark://host:7077"}))
    with pytest.raises(RuntimeError):
        session.shared_dir(_Session(**{"spark.master": "local-cluster[2,1,1024]"}))
    assert session.shared_dir(_Session(**{"spark.master": "yarn", "spark.checkpoint.dir": "hdfs:///x"})) == "hdfs:///x"


def test_scratch_layers_are_removed(spark):
    kept, session._SCRATCH[:] = list(session._SCRATCH), []
    df = session.written(spark.range(5), "gone")
    path = session._SCRATCH[0]
    assert df.count() == 5 and os.path.isdir(path.removeprefix("file://"))
    assert session.clear_scratch(spark) == 1 and not os.path.isdir(path.removeprefix("file://"))
    session._SCRATCH[:] = kept



def test_metrics_come_from_one_aggregate(spark, monkeypatch):
    made = []
    real = M._decided_counts
    monkeypatch.setattr(M, "_decided_counts", lambda *a, **k: made.append(1) or real(*a, **k))
    preds = spark.createDataFrame([("d1", 1, 1, 0.9), ("d1", 0, 1, 0.6), ("d2", 0, 0, 0.1), (None, 1, 1, 0.7), (None, 0, 0, 0.2), ("d2", None, 1, 0.5),
                                   ("d1", 1, 0, None)], "day string, y_true int, y_pred int, score double")
    got = {r["day"]: r for r in M.daily_monitor(preds, score="score").collect()}
    assert got[None]["score_auc"] == 1.0 and got["d1"]["score_auc"] == 1.0 and got["d2"]["score_auc"] is None
    assert (got["d1"]["tp"], got["d1"]["fn"], got["d1"]["fp"], got["d1"]["rows"], got["d2"]["rows"]) == (1, 1, 1, 3, 1)
    M.evaluate_split(preds, ["day"], 0.5).collect()
    assert len(made) == 2


def test_vocabulary_has_a_limit(spark):
    v = PR.fit_vocabulary(spark.range(30).select(F.col("id").cast("string").alias("gender")), ["gender"])
    assert len(PR.vocabulary(v, 30)["gender"]) == 30
    with pytest.raises(ValueError, match="29"):
        PR.vocabulary(v, 29)


def test_smallest_split_is_folded_into_the_leaves(spark):
    assert [ML.leaf_rows(*x) for x in ((1, 2), (1, 50), (10, 11), (3, 7))] == [1, 25, 10, 4]
    draws = ML.draw_forest_params(20, 1)
    assert all(10 <= d["min_split"] <= 50 for d in draws)
    assert ML.forest(min_leaf=2, min_split=40).getMinInstancesPerNode() == 20


def test_monitor_stream_prunes_months(spark, tmp_path):
    from renewcast.streaming import daily
    rows = [(f"2020-0{m}-0{d}", y, y, 0.2 + 0.5 * y) for m in (1, 2) for d in (1, 2) for y in (0, 1)]
    s = spark.createDataFrame(rows, "day string, y_true int, y_pred int, score double").withColumn("day", F.col("day").cast("date"))
    preds, out, state = (str(tmp_path / x) for x in ("preds", "out", "state"))
    daily.write_predictions(s.where("day < '2020-02-01'"), preds)
    daily.monitor_days(spark, preds, out, state)
    daily.write_predictions(s.where("day >= '2020-02-01'"), preds)
    seen = []
    real = daily.daily_monitor
    daily.daily_monitor = lambda full, *a, **k: seen.append(full._jdf.queryExecution().executedPlan().toString()) or real(full, *a, **k)
    try:
        daily.monitor_days(spark, preds, out, state)
    finally:
        daily.daily_monitor = real
    assert seen and all("PartitionFilters: [" in p and "month" in p.split("PartitionFilters: [")[1].split("]")[0] for p in seen)
    assert daily.read_monitor(spark, out).count() == 4


def test_shuffle_partitions_follow_the_size():
    assert session.partitions_for(0) == 200
    assert session.partitions_for(10 ** 13) == -(-10 ** 13 // session.PARTITION_BYTES)


@pytest.mark.parametrize("fraction", [0.0, 0.2, 0.5, 1.0])
def test_split_by_boundary_block_equals_full_ranking(spark, monkeypatch, fraction):
    from renewcast.operators.profiles import rank_in_class
    df = spark.range(3000).select("id", (F.col("id") % 7 == 0).cast("int").alias("y")).withColumn("y", F.when(F.col("id") % 11 != 0, F.col("y")))
    got = {r["id"]: r["is_test"] for r in PR.stratified_split(df, "y", ["id"], fraction, 611).collect()}
    ranked = rank_in_class(df, "y", ["id"], 611).select("id", (F.col("_rank") <= F.round(F.lit(fraction) * F.col("_class_n"))).cast("int").alias("t"))
    assert got == {r["id"]: r["t"] for r in ranked.collect()} and len(got) == 3000


def test_best_trials_are_counted():
    from renewcast.catalog.modelling import best_trials
    info, draws = {"cv_score": 0.7, "best_params": {"C": 1.0}}, [{"C": 0.1}, {"C": 1.0}, {"C": 10.0}]
    assert best_trials(info, draws, [0.6, 0.7, 0.7]) == 1
    assert best_trials(info, draws, [0.7, 0.6, 0.6]) == best_trials(info, draws, [0.6, 0.8, 0.6]) == 0
