"""Daily scoring / monitoring as an incremental (available-now) stream.

The reference runs its monitor once per day from a scheduler, with catch-up
for missed days.  Here the predictions table is a file source: each trigger
picks up the files written since the last one, and the metrics of every day
touched by the new files are recomputed from the (partition-pruned)
predictions table and written with dynamic partition overwrite.  Re-running a
batch rewrites the same day partitions, so a retried or duplicated batch
leaves the same result; the checkpoint records which files were processed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from renewcast.operators.metrics import daily_monitor


def monitor_days(spark: SparkSession, predictions_path: str, out_path: str, checkpoint: str,
                 day: str = "day", score: str | None = "score", partition: str = "month") -> None:
    """Process every prediction file not yet seen, then stop (``availableNow``).

    Both tables are partitioned by ``partition`` (the month of the day): a
    batch recomputes the days of every month it touched and overwrites those
    month partitions only.
    """
    schema = spark.read.parquet(predictions_path).schema
    stream = spark.readStream.schema(schema).parquet(predictions_path)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        # the partition values a batch touched: a list of months, which prunes the scan
        months = [r[0] for r in batch.select(partition).distinct().collect()]
        known = F.col(partition).isin([m for m in months if m is not None])
        full = spark.read.parquet(predictions_path).where(known | F.col(partition).isNull() if None in months else known)
        metrics = daily_monitor(full, day, score=score).withColumn(partition, F.trunc(day, "MM"))
        (metrics.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(partition).parquet(out_path))

    q = (stream.writeStream.foreachBatch(per_batch)
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def write_predictions(preds: DataFrame, path: str, day: str = "day", partition: str = "month") -> None:
    """Append-style store of predictions, one partition per month of ``day``."""
    (preds.withColumn(partition, F.trunc(day, "MM")).hint("rebalance", partition)
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path))


def read_monitor(spark: SparkSession, out_path: str, day: str = "day", partition: str = "month") -> DataFrame:
    df = spark.read.parquet(out_path).drop(partition)
    return df.select(day, *[c for c in df.columns if c != day])
