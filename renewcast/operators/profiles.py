"""Aggregations and EDA profiles.

All profiles are single aggregates with partial (map-side) aggregation; long
form comes from ``stack``.  Exact quantiles are computed without gathering a
column into one task: distinct values are counted, ranked by the blocked
running sum and the two order statistics around each quantile are picked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from renewcast.operators.windows import hash_blocks, running_sum


def _stack(pairs: Sequence[tuple[str, Column]], key: str, value: str) -> Column:
    args = ", ".join(f"'{k}', `{k}`" for k, _ in pairs)
    return F.expr(f"stack({len(pairs)}, {args}) AS (`{key}`, `{value}`)")


def value_counts(df: DataFrame, col: str, dropna: bool = False) -> DataFrame:
    """Count per value; null is its own group unless ``dropna`` (pandas drops it)."""
    d = df.where(F.col(col).isNotNull()) if dropna else df
    return d.groupBy(col).agg(F.count(F.lit(1)).alias("count"))


def value_shares(df: DataFrame, col: str) -> DataFrame:
    """Share of each non-null value among non-null rows (pandas ``value_counts(normalize=True)``)."""
    counts = value_counts(df, col, dropna=True)
    total = counts.agg(F.sum("count").alias("_total"))
    return attach_scalar(counts, total).select(col, "count", (F.col("count") / F.col("_total")).alias("share"))


def attach_scalar(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Append the columns of a one-row aggregate to every row.

    Each column becomes a scalar subquery (evaluated once, then a literal in the
    plan): no join and no cross product, whatever the size of ``df``.
    """
    return df.select("*", *[one_row.select(c).scalar().alias(c) for c in one_row.columns])


def daily_transaction_counts(tx: DataFrame, user: str = "msno",
                             keys: Sequence[str] = ("transaction_date", "is_cancel")) -> DataFrame:
    """Rows per (user, date, cancel flag); null keys do not form groups (pandas)."""
    cond = F.col(user).isNotNull()
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return tx.where(cond).groupBy(user, *keys).agg(F.count(F.lit(1)).alias("transaction_count"))


def count_of_counts(counts: DataFrame, col: str = "transaction_count") -> DataFrame:
    """How many groups have k rows."""
    return counts.groupBy(col).agg(F.count(F.lit(1)).alias("counts"))


def null_profile(df: DataFrame) -> DataFrame:
    """Null count per column, long form, one pass."""
    aggs = [F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    wide = df.agg(*aggs)
    return wide.select(_stack([(c, F.col(c)) for c in df.columns], "column", "null_count"))


def schema_profile(df: DataFrame) -> DataFrame:
    """Per column: position, type family, non-null count and table row count (one pass)."""
    fam = {}
    for name, t in df.dtypes:
        if t in ("int", "bigint", "smallint", "tinyint"):
            fam[name] = "integer"
        elif t in ("double", "float") or t.startswith("decimal"):
            fam[name] = "double"
        elif t == "string":
            fam[name] = "string"
        else:
            fam[name] = t
    wide = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count(F.col(c)).alias(c) for c in df.columns])
    long = wide.select("__rows", _stack([(c, F.col(c)) for c in df.columns], "column", "non_null"))
    meta = F.create_map(*[x for i, c in enumerate(df.columns)
                          for x in (F.lit(c), F.struct(F.lit(i).alias("pos"), F.lit(fam[c]).alias("dtype")))])
    return long.select("column", meta[F.col("column")]["pos"].alias("position"),
                       meta[F.col("column")]["dtype"].alias("dtype"), "non_null",
                       F.col("__rows").alias("n_rows"))


def exact_quantiles(df: DataFrame, col: str, qs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Linear-interpolation quantiles (pandas / ``quantile_cont``), exact and distributed.

    Returns one row: ``q<pct>`` columns.  Distinct values are counted (partial
    aggregation), ranked with the blocked running sum, and for every quantile
    the order statistics at floor/ceil of q*(n-1) are picked by a conditional
    max -- no task ever holds the whole column.
    """
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    rs = running_sum(counts, [col], ["_n"], with_total=True)
    first = F.col("_n_cum") - F.col("_n")          # rank of the first copy (0-based)
    last = F.col("_n_cum") - 1
    aggs = []
    for q in qs:
        pos = F.lit(float(q)) * (F.col("_n_total") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        tag = f"{int(round(q * 100))}"
        aggs += [F.max(F.when((first <= lo) & (lo <= last), F.col(col).cast("double"))).alias(f"_lo{tag}"),
                 F.max(F.when((first <= hi) & (hi <= last), F.col(col).cast("double"))).alias(f"_hi{tag}"),
                 F.max(pos - lo).alias(f"_f{tag}")]
    picked = rs.agg(*aggs)
    outs = []
    for q in qs:
        tag = f"{int(round(q * 100))}"
        lo_v, hi_v, fr = F.col(f"_lo{tag}"), F.col(f"_hi{tag}"), F.col(f"_f{tag}")
        outs.append((lo_v + fr * (hi_v - lo_v)).alias(f"q{tag}"))
    return picked.select(*outs)


def exact_quantiles_long(df: DataFrame, cols: Sequence[str], qs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Exact linear-interpolation quantiles of several columns in one pass.

    The columns are stacked to (column, value), distinct values counted per
    column, and one running sum grouped by column ranks them in blocks cut by range of (column, value).  One scan and one shuffle of
    distinct (column, value) pairs, whatever the number of columns.
    """
    cols = list(cols)
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in cols)
    long = df.select(F.expr(f"stack({len(cols)}, {pairs}) AS (column, value)")).where(F.col("value").isNotNull())
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("_n"))
    rs = running_sum(counts, ["value"], ["_n"], group=["column"], with_total=True)
    first = F.col("_n_cum") - F.col("_n")
    last = F.col("_n_cum") - 1
    aggs = []
    for q in qs:
        pos = F.lit(float(q)) * (F.col("_n_total") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        tag = f"{int(round(q * 100))}"
        aggs += [F.max(F.when((first <= lo) & (lo <= last), F.col("value"))).alias(f"_lo{tag}"),
                 F.max(F.when((first <= hi) & (hi <= last), F.col("value"))).alias(f"_hi{tag}"),
                 F.max(pos - lo).alias(f"_f{tag}")]
    picked = rs.groupBy("column").agg(*aggs)
    outs = []
    for q in qs:
        tag = f"{int(round(q * 100))}"
        lo_v, hi_v, fr = F.col(f"_lo{tag}"), F.col(f"_hi{tag}"), F.col(f"_f{tag}")
        outs.append((lo_v + fr * (hi_v - lo_v)).alias(f"q{tag}"))
    return picked.select("column", *outs)


def describe_profile(df: DataFrame, cols: Sequence[str], approx: bool = False,
                     accuracy: int = 10000) -> DataFrame:
    """count, mean, std (sample), min, 25/50/75% (linear interpolation), max per column.

    One aggregate pass for the moments of every column; exact quartiles of all
    columns by one distributed selection over the stacked (column, value) pairs (``exact_quantiles_long``).  ``approx=True`` uses ``percentile_approx``
    (one pass, bounded memory) instead.
    """
    cols = list(cols)
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"n_{c}"), F.avg(x).alias(f"m_{c}"), F.stddev_samp(x).alias(f"s_{c}"),
                 F.min(x).alias(f"lo_{c}"), F.max(x).alias(f"hi_{c}")]
        if approx:
            aggs.append(F.percentile_approx(x, [0.25, 0.5, 0.75], accuracy).alias(f"p_{c}"))
    wide = df.agg(*aggs)
    pairs = ", ".join(f"'{c}', `n_{c}`, `m_{c}`, `s_{c}`, `lo_{c}`, `hi_{c}`" for c in cols)
    base = wide.select(F.expr(f"stack({len(cols)}, {pairs}) AS (column, count, mean, std, min, max)"))
    if approx:
        qp = ", ".join(f"'{c}', `p_{c}`" for c in cols)
        q = wide.select(F.expr(f"stack({len(cols)}, {qp}) AS (column, _p)")).select(
            "column", F.col("_p")[0].alias("q25"), F.col("_p")[1].alias("q50"), F.col("_p")[2].alias("q75"))
    else:
        q = exact_quantiles_long(df, cols)
    return base.join(q, "column", "left").select(
        "column", "count", "mean", "std", "min", F.col("q25").alias("p25"), F.col("q50").alias("p50"),
        F.col("q75").alias("p75"), "max")


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


def burst_share(df: DataFrame, burst: DataFrame, user: str = "msno") -> DataFrame:
    """Share of rows owned by the given (burst) users: one aggregate after a left join."""
    flagged = df.join(burst.select(user).withColumn("_b", F.lit(1)), on=user, how="left")
    return flagged.agg(F.count(F.lit(1)).alias("total_rows"),
                       F.count("_b").alias("burst_rows"),
                       F.avg(F.coalesce(F.col("_b"), F.lit(0))).alias("burst_share"))


def label_balance(df: DataFrame, label: str = "churn", by: str = "split") -> DataFrame:
    """Total, churned and churn ratio per data set."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("total"),
                              F.sum(F.col(label)).cast("bigint").alias("churned"),
                              F.avg(F.col(label).cast("double")).alias("churn_ratio"))


def gap_histogram(spark: SparkSession, df: DataFrame, col: str = "days_diff", n_bins: int = 49) -> DataFrame:
    """Unit-width histogram on edges 0..n_bins; the last bin is closed ([n-1, n]).

    The bin spine has ``n_bins`` rows (a parameter, not data).
    """
    x = F.col(col)
    binned = df.where((x >= 0) & (x <= n_bins)).select(
        F.when(x == n_bins, F.lit(n_bins - 1)).otherwise(F.floor(x)).cast("int").alias("bin"))
    counts = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    spine = spark.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    return spine.join(counts, "bin", "left").select("bin", F.coalesce("count", F.lit(0)).alias("count"))


def share_within(df: DataFrame, col: str = "days_diff", cutoffs: Sequence[int] = tuple(range(5, 50, 5))) -> DataFrame:
    """Share of all rows (nulls in the denominator) with ``col <= x`` per cut-off; one pass."""
    aggs = [F.count(F.lit(1)).alias("_n")] + [F.count_if(F.col(col) <= x).alias(f"c{x}") for x in cutoffs]
    wide = df.agg(*aggs)
    pairs = ", ".join(f"{x}, c{x}" for x in cutoffs)
    return wide.select("_n", F.expr(f"stack({len(cutoffs)}, {pairs}) AS (days, n_within)")).select(
        F.col("days").cast("int").alias("days"), "n_within", (F.col("n_within") / F.col("_n")).alias("share"))


def top_counts(counts: DataFrame, count_col: str, tie: Sequence[str], n: int = 10) -> DataFrame:
    """First ``n`` rows by descending count (TakeOrdered: top-n per task, then merged)."""
    return counts.orderBy(F.col(count_col).desc(), *[F.col(c).asc_nulls_first() for c in tie]).limit(n)


def head(df: DataFrame, key: Sequence[str], n: int = 5) -> DataFrame:
    """Preview rows in key order (repeatable, unlike ``show``)."""
    return df.orderBy(*[F.col(c).asc_nulls_first() for c in key]).limit(n)


def with_hash_key(df: DataFrame, key: Sequence[str], seed: int | str, name: str = "_h") -> DataFrame:
    """md5 of the key columns and a seed, as an ordering key independent of partitioning."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key] + [F.lit(str(seed))]
    return df.withColumn(name, F.md5(F.concat_ws("|", *parts)))


def rank_in_class(df: DataFrame, label: str, key: Sequence[str], seed: int | str,
                  tie: Sequence[str] = ()) -> DataFrame:
    """1-based rank of each row within its class in md5(key, seed) order, plus the class size.

    Distributed: the md5's first four hex digits cut every class into 65,536
    blocks, so a class holding most of the rows is still ranked in pieces.
    """
    h = with_hash_key(df, key, seed).withColumn("_one", F.lit(1))
    order = [F.col("_h").asc(), *[F.col(c).asc_nulls_first() for c in tie]]
    rs = running_sum(h, order, ["_one"], group=[label], block=hash_blocks("_h"), with_total=True)
    return rs.withColumnRenamed("_one_cum", "_rank").withColumnRenamed("_one_total", "_class_n").drop("_one")


def sample_per_class(df: DataFrame, label: str, key: Sequence[str], n: int = 5, seed: int = 42,
                     tie: Sequence[str] = ()) -> DataFrame:
    """``n`` rows per class, the first in md5(key, seed) order: seeded and repeatable.

    Only the rows in front of each class's cut-off block are ranked: rows are
    counted per (class, hash block) with partial aggregation, the first block
    where the running count reaches ``n`` is found on that small table, and
    the ranking window sees at most ``n`` + one block of rows per class.
    """
    h = with_hash_key(df, key, seed).withColumn("_blk", hash_blocks("_h"))
    counts = h.groupBy(label, "_blk").agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy(label).orderBy("_blk").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(label).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    cut = (counts.select(label, "_blk", F.sum("_c").over(upto).alias("_cum"),
                         F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_prev"))
           .where(F.col("_prev") < n)          # blocks that can still hold one of the first n rows
           .select(label, "_blk"))
    front = h.join(cut.withColumnRenamed(label, "_lab").withColumnRenamed("_blk", "_b2"),
                   (h["_blk"] == F.col("_b2")) & h[label].eqNullSafe(F.col("_lab")), "left_semi")
    w = Window.partitionBy(label).orderBy(F.col("_h").asc(), *[F.col(c).asc_nulls_first() for c in tie])
    return front.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r", "_h", "_blk")


def canonical_order(df: DataFrame, user: str = "msno",
                    order: Sequence[str] = ("transaction_date", "membership_expire_date"),
                    tie: Sequence[str] = ("tx_id",)) -> DataFrame:
    """Position of each row in its user's (date, expiry, tie) order; the order only feeds windows.  Rows without a user
    have no order: their position is null, and they meet in no window."""
    w = Window.partitionBy(user).orderBy(*[F.col(c).asc_nulls_last() for c in (*order, *tie)])
    owned = df.where(F.col(user).isNotNull()).withColumn("seq", F.row_number().over(w))
    return owned.unionByName(df.where(F.col(user).isNull()).withColumn("seq", F.lit(None).cast("int")))
