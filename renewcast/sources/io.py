"""Sources and sinks.

One table per layer, partitioned by a date column (``snapshot_month`` for the
monthly layers, the expiry date for the daily inference fan-out), written as
parquet with dynamic partition overwrite.  Months and days are columns, so one
plan handles every month and a filter on the column prunes partitions.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from renewcast.functions.scalar import parse_yyyymmdd

STRAY_INDEX_COLUMNS = ("_c0", "Unnamed: 0")

# Columns of the three source files (dates arrive as yyyyMMdd text); files may hold index columns besides, in any order.
RAW_TRANSACTIONS = T.StructType([
    T.StructField("msno", T.StringType()),
    T.StructField("payment_method_id", T.StringType()),
    T.StructField("payment_plan_days", T.IntegerType()),
    T.StructField("plan_list_price", T.DoubleType()),
    T.StructField("actual_amount_paid", T.DoubleType()),
    T.StructField("is_auto_renew", T.IntegerType()),
    T.StructField("is_cancel", T.IntegerType()),
    T.StructField("transaction_date", T.StringType()),
    T.StructField("membership_expire_date", T.StringType()),
])
RAW_USER_LOGS = T.StructType([
    T.StructField("msno", T.StringType()),
    T.StructField("date", T.StringType()),
    *[T.StructField(c, T.IntegerType()) for c in ("num_25", "num_50", "num_75", "num_985", "num_100", "num_unq")],
    T.StructField("total_secs", T.DoubleType()),
])
RAW_MEMBERS = T.StructType([
    T.StructField("msno", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("bd", T.IntegerType()),
    T.StructField("gender", T.StringType()),
    T.StructField("registered_via", T.StringType()),
    T.StructField("registration_init_time", T.StringType()),
])


def read_raw_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
                 date_cols: Sequence[str] = ()) -> DataFrame:
    """Headed CSV scan with declared columns, bound by the header's names whatever their order.

    Every file's header must name the same columns in the order of the first one (``enforceSchema``
    is off, so Spark checks it and raises).  A declared column that the header lacks raises; pandas index columns are dropped by name;
    columns that are not declared are left out.  Values that do not fit the declared type, and bad dates, become null.
    """
    read = spark.read.option("header", True)
    header = read.option("inferSchema", False).csv(path).columns
    text = T.StructType([T.StructField(c, T.StringType()) for c in header])
    df = read.option("enforceSchema", False).schema(text).csv(path)
    df = df.drop(*[c for c in STRAY_INDEX_COLUMNS if c in df.columns])
    if schema is not None:
        missing = [f.name for f in schema.fields if f.name not in df.columns]
        if missing:
            raise ValueError(f"{path}: no column {', '.join(missing)}; the header has {', '.join(header)}")
        df = cast_schema(df.select(*schema.names), {f.name: f.dataType for f in schema.fields if f.dataType != T.StringType()})
    for c in date_cols:
        df = df.withColumn(c, parse_yyyymmdd(c))
    return df


def cast_schema(df: DataFrame, types: Mapping[str, str | T.DataType]) -> DataFrame:
    """Cast the listed columns in one projection; malformed values become null (``try_cast``)."""
    cols = []
    for c in df.columns:
        if c in types:
            t = types[c]
            t = t.simpleString() if isinstance(t, T.DataType) else t
            cols.append(F.col(c).try_cast(t).alias(c))
        else:
            cols.append(F.col(c))
    return df.select(*cols)


def drop_columns(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Drop by name; absent names are ignored."""
    return df.drop(*list(cols))


def write_layer(df: DataFrame, path: str, partition_cols: Sequence[str] = ()) -> None:
    """Overwrite one layer as parquet; with partition columns only the partitions
    present in ``df`` are replaced (dynamic partition overwrite)."""
    if partition_cols:
        # AQE rebalance: rows of one partition value go to few writers, and a hot
        # value is split over several tasks instead of one
        df = df.hint("rebalance", *partition_cols)
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    if partition_cols:
        w = w.partitionBy(*partition_cols)
    w.parquet(path)


def write_by_day(df: DataFrame, path: str, date_col: str = "membership_expire_date") -> None:
    """Fan-out of the inference set: one partition directory per expiry date.

    Rows are clustered by the day first (AQE rebalance: a hot day is split over
    several tasks, small days are packed together) so each task writes few files.
    """
    df.hint("rebalance", date_col).write.mode("overwrite") \
        .option("partitionOverwriteMode", "dynamic").partitionBy(date_col).parquet(path)


def read_layer(spark: SparkSession, path: str, partition_col: str | None = None,
               values: Sequence[str] | None = None) -> DataFrame:
    """Parquet scan of a layer, optionally limited to some partitions (pruned at planning)."""
    df = spark.read.parquet(path)
    if partition_col and values is not None:
        df = df.where(F.col(partition_col).isin([F.lit(v).cast("date") for v in values]))
    return df


def month_spine(spark: SparkSession, start: str, end: str, name: str = "snapshot_month") -> DataFrame:
    """First-of-month dates from start's month through end (27 rows for 2015-01..2017-03)."""
    return spark.range(1).select(
        F.explode(F.sequence(F.trunc(F.lit(start).cast("date"), "MM"), F.lit(end).cast("date"),
                             F.expr("INTERVAL 1 MONTH"))).alias(name))


def assign_snapshot_month(df: DataFrame, date_col: str, name: str = "snapshot_month") -> DataFrame:
    """All monthly slices in one pass: the month becomes a column."""
    return df.withColumn(name, F.trunc(F.col(date_col), "MM"))


def with_prior_month(logs: DataFrame, date_col: str = "date", name: str = "snapshot_month") -> DataFrame:
    """Each log row goes to its own month and to the next one (as that month's
    prior-month logs); only months that hold logs are kept (a missing prior
    month is simply absent).  The month list is tiny and AQE broadcasts it."""
    m = F.trunc(F.col(date_col), "MM")
    months = logs.select(m.alias(name)).distinct()
    spread = logs.withColumn(name, F.explode(F.array(m, F.add_months(m, 1))))
    return spread.join(months, on=name, how="left_semi")


def source_readiness(sources: Mapping[str, DataFrame], required: Iterable[str] = ()) -> DataFrame:
    """Per source: row count, one job for all of them (a union of global counts).

    Raises when a required source is missing from ``sources``.
    """
    missing = [s for s in required if s not in sources]
    if missing:
        raise FileNotFoundError(f"required sources missing: {missing}")
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("source"), "row_count")
             for name, df in sources.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def path_readiness(spark: SparkSession, paths: Mapping[str, str], required: Iterable[str] = (),
                   fmt: str = "parquet") -> DataFrame:
    """Per source path: whether it exists and its row count (one job for all that exist).

    Raises when a required path is missing -- the dependency check before a run.
    """
    exists = {name: path_exists(spark, p, fmt) for name, p in paths.items()}
    missing = [n for n in required if not exists.get(n, False)]
    if missing:
        raise FileNotFoundError(f"required sources missing: {missing}")
    present = {n: spark.read.format(fmt).load(p) for n, p in paths.items() if exists[n]}
    counts = source_readiness(present) if present else None
    absent = [(n, False) for n, ok in exists.items() if not ok]
    out = counts.withColumn("exists", F.lit(True)) if counts is not None else None
    if absent:
        miss = spark.createDataFrame(absent, "source string, exists boolean") \
            .withColumn("row_count", F.lit(None).cast("long")).select("source", "row_count", "exists")
        out = miss if out is None else out.unionByName(miss)
    return out


def month_readiness(df: DataFrame, date_col: str, spine: DataFrame,
                    name: str = "snapshot_month") -> DataFrame:
    """Rows per month on the month spine; months without rows show 0."""
    counts = df.groupBy(F.trunc(F.col(date_col), "MM").alias(name)).agg(F.count(F.lit(1)).alias("row_count"))
    return spine.join(counts, on=name, how="left").select(
        name, F.coalesce(F.col("row_count"), F.lit(0)).alias("row_count"))


def path_exists(spark: SparkSession, path: str, fmt: str = "parquet") -> bool:
    """Whether a layer can be read at ``path`` (any file system Spark can read); other errors are raised."""
    from pyspark.errors import AnalysisException
    try:
        spark.read.format(fmt).load(path).schema
        return True
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
