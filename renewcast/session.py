"""Session construction and the shared working folder.

On a cluster the shared folder comes from ``spark.checkpoint.dir`` (set by
whoever launches the job, pointing at HDFS / object storage).  Only where it is
unset and the master is local -- tests, the bench -- do we create one of our own under /tmp;
with any other master a missing setting is an error.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"
_SCRATCH: list[str] = []


#: Bytes of one shuffle partition on a cluster.
PARTITION_BYTES = 256 << 20


def partitions_for(shuffle_bytes: int) -> int:
    """Initial shuffle partitions for a shuffle of that size: about PARTITION_BYTES each, 200 at least (AQE coalesces what turns out small)."""
    return max(200, -(-shuffle_bytes // PARTITION_BYTES))


# Settings for a large cluster: splits of skewed partitions, scan splits of 256 MB; the number of shuffle
# partitions follows the expected shuffle (``partitions_for``).  Applied by ``get_session(profile="cluster")``.
CLUSTER_CONF = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    "spark.shuffle.service.enabled": "true",
    "spark.decommission.enabled": "true",
    "spark.storage.decommission.shuffleBlocks.enabled": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "renewcast", profile: str = "local", shuffle_bytes: int = 10 ** 13) -> SparkSession:
    """Build (or reuse) a session with the settings every operator assumes.

    AQE is on: it coalesces small shuffle partitions, splits skewed join
    partitions and turns a sort-merge join into a broadcast join only after the
    build side has been measured at run time (the size check for every join we
    do not broadcast explicitly).  ``profile="cluster"`` applies ``CLUSTER_CONF``
    (the master then comes from spark-submit) with shuffle partitions for the largest
    shuffle expected, ``shuffle_bytes`` (of a 100 TB scan, by default a tenth).
    """
    if profile == "cluster":
        b = SparkSession.builder.appName(app_name)
        for k, v in CLUSTER_CONF.items():
            b = b.config(k, v)
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions or partitions_for(shuffle_bytes)))
        b = b.config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
        return b.getOrCreate()
    master = master or os.environ.get("SPARK_MASTER", "local[8]")
    b = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
    )
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder visible to every executor, for checkpoints and written layers.

    Reads ``spark.checkpoint.dir`` from the session; sets a fresh local one
    only where it is unset and the master is ``local`` or ``local[...]``.  Elsewhere each executor
    would write to a disk of its own, so a missing setting raises.
    """
    d = spark.conf.get(_CHECKPOINT_KEY, None)
    if not d:
        # a checkpoint directory set on the context (setCheckpointDir) counts as well
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors share (master {master})")
        d = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark.conf.set(_CHECKPOINT_KEY, d)
        spark.sparkContext.setCheckpointDir(os.path.join(d, "checkpoints"))
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-path of the shared folder for one written layer; ``clear_scratch`` removes it."""
    path = os.path.join(shared_dir(spark).rstrip("/"), "layers", f"{name}-{uuid.uuid4().hex[:8]}")
    _SCRATCH.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet to the shared folder and read back: the plan so far runs once, and a
    lost executor re-reads files instead of running it again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_buckets(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """The rows written as Parquet in ``buckets`` files by the hash of ``key`` and read back with that layout known to the planner:
    tables with as many buckets join, or are grouped, on the key without an exchange.  The catalogue entry that Spark's
    bucketed writer needs is dropped again; the files stay until ``clear_scratch``."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    entry = f"{name}_{uuid.uuid4().hex[:12]}"
    # at most ``buckets`` tasks write, whatever the session makes of the repartition: few files a bucket
    df.repartition(buckets, key).coalesce(buckets).write.bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").saveAsTable(entry)
    try:
        back = spark.table(entry)
        back.schema                     # resolved now, while the entry is there
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {entry}")
    return back


def clear_scratch(spark: SparkSession) -> int:
    """Removes the layers written through ``scratch_path`` so far (any file system Spark can write); returns
    how many.  Call it when no result that reads them is still wanted."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    while _SCRATCH:
        path = jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n
