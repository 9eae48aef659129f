"""The available-now monitor processes only new files and rewrites only the months they touch."""

import datetime as dt

from pyspark.sql import functions as F

from renewcast.operators.metrics import daily_monitor
from renewcast.streaming.daily import monitor_days, read_monitor, write_predictions


def _preds(spark, month, n=200):
    base = dt.date(2020, month, 1)
    rows = [(base + dt.timedelta(days=i % 20), i % 2, (i % 10) / 10.0) for i in range(n)]
    df = spark.createDataFrame(rows, "day date, y_true int, score double")
    return df.withColumn("y_pred", (F.col("score") >= 0.5).cast("int"))


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_incremental_months(spark, tmp_path):
    preds, out, ck = str(tmp_path / "p"), str(tmp_path / "m"), str(tmp_path / "ck")
    jan, feb = _preds(spark, 1), _preds(spark, 2, 300)
    write_predictions(jan, preds)
    monitor_days(spark, preds, out, ck)
    first = read_monitor(spark, out)
    assert first.count() == 20
    # new files for a new month arrive; the same checkpoint picks up only those
    write_predictions(feb, preds)
    monitor_days(spark, preds, out, ck)
    both = read_monitor(spark, out)
    assert both.count() == 40
    expected = daily_monitor(jan.unionByName(feb), "day", score="score")
    assert _rows(both.select(*expected.columns)) == _rows(expected)
