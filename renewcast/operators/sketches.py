"""Mergeable summaries: quantile sketches per day, counters of heavy values, a bit filter of users.

Each is bounded whatever the data, summed or merged in any order, and says how far it can be trusted: quantiles by their
rank error, heavy values by a proof that nothing larger was missed, the bit filter by never refusing a member.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Size of a quantile sketch, and the share of the rows by which ranks may be off (99 % of the time, for that size).
SKETCH_K, RANK_ERROR = 400, 0.007
COUNTERS, CANDIDATES = 1 << 16, 256
BITMAP = 1 << 15                # bits of one piece of a bit filter, as Spark's bitmap functions have them
BITS_A_KEY, MOST_BITS, HASHES = 12, 1 << 26, 3


# ------------------------------------------------------------------ quantiles

def day_sketches(df: DataFrame, day: str, cols: Sequence[str], k: int = SKETCH_K) -> DataFrame:
    """(day, column, count, mean, m2, min, max, sketch): one row per day and numeric column, from one aggregate.  ``m2`` is
    the sum of squared distances from the mean; nulls do not count."""
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(f"`{c}`").cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), (F.var_pop(x) * F.count(x)).alias(f"s{i}"), F.min(x).alias(f"a{i}"),
                 F.max(x).alias(f"z{i}"), F.kll_sketch_agg_double(x, F.lit(k)).alias(f"q{i}")]
    wide = df.groupBy(F.col(day).alias("day")).agg(*aggs)
    rows = ", ".join(f"'{c}', n{i}, m{i}, s{i}, a{i}, z{i}, q{i}" for i, c in enumerate(cols))
    return wide.select("day", F.expr(f"stack({len(cols)}, {rows}) AS (column, count, mean, m2, min, max, sketch)")).where("count > 0")


def describe_days(sketches: DataFrame, first: str | None = None, last: str | None = None, qs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """column, count, mean, std (sample), min, p25, p50, p75, max over a range of days, read from the written sketches alone.

    Counts, means and deviations are exact (parallel variance); quantiles are values of the column whose rank is within RANK_ERROR."""
    days = sketches
    if first is not None:
        days = days.where(F.col("day") >= F.lit(first).cast("date"))
    if last is not None:
        days = days.where(F.col("day") <= F.lit(last).cast("date"))
    whole = Window.partitionBy("column")                # a row per day and column
    mean = F.sum(F.col("count") * F.col("mean")).over(whole) / F.sum("count").over(whole)
    d = days.withColumn("_mean", mean)
    m2 = F.sum(F.col("m2") + F.col("count") * (F.col("mean") - F.col("_mean")) * (F.col("mean") - F.col("_mean")))
    n = F.sum("count")
    merged = d.groupBy("column").agg(n.alias("count"), F.max("_mean").alias("mean"), F.when(n > 1, F.sqrt(m2 / (n - 1))).alias("std"),
                                     F.min("min").alias("min"), F.max("max").alias("max"), F.kll_merge_agg_double("sketch").alias("_q"))
    quantile = [F.kll_sketch_get_quantile_double("_q", F.lit(float(q))).alias(f"p{round(q * 100)}") for q in qs]
    return merged.select("column", "count", "mean", "std", "min", *quantile, "max")


# ------------------------------------------------------------------ heavy values

def value_counters(df: DataFrame, col: str, counters: int = COUNTERS, by: Sequence[str] = ()) -> DataFrame:
    """(by, slot, n): rows per hash slot of the values, at most ``counters`` rows a group, combined before the shuffle.  Nulls do not count.
    Tables of several days merge by adding."""
    x = df.where(F.col(col).isNotNull())
    return x.groupBy(*by, F.pmod(F.xxhash64(F.col(col).cast("string")), F.lit(counters)).cast("int").alias("slot")).agg(F.count(F.lit(1)).alias("n"))


def top_values(df: DataFrame, col: str, n: int = 10, counters: int = COUNTERS, candidates: int = CANDIDATES,
               summary: DataFrame | None = None) -> DataFrame:
    """(value, count, proved): the ``n`` most frequent values, ties by value, for columns whose values are nearly unique.

    A value has at most the rows of its slot.  The values of the heaviest ``candidates`` slots are counted exactly in a second pass; all
    others are bounded by the heaviest slot left out.  ``proved`` says that no value left out can belong to the result, so that it equals the exact one;
    where it is false, more counters or candidates may prove it."""
    slots = (value_counters(df, col, counters) if summary is None else summary).groupBy("slot").agg(F.sum("n").alias("n"))
    heavy = slots.orderBy(F.desc("n"), "slot").limit(candidates + 1).collect()         # a parameter, not data
    bound = heavy[candidates]["n"] if len(heavy) > candidates else 0
    keep = [r["slot"] for r in heavy[:candidates]]
    slot = F.pmod(F.xxhash64(F.col(col).cast("string")), F.lit(counters)).cast("int")
    counted = df.where(F.col(col).isNotNull() & slot.isin(keep)).groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    best = counted.orderBy(F.desc("count"), "value").limit(n)
    least = F.min("count").over(Window.partitionBy())                                   # over n rows
    rows = F.count(F.lit(1)).over(Window.partitionBy())
    proved = F.lit(True) if bound == 0 else (rows == n) & (least > F.lit(bound))
    return best.select("value", "count", proved.alias("proved"))


# ------------------------------------------------------------------ bit filter

def bit_places(key: str, bits: int, hashes: int = HASHES) -> list[Column]:
    return [F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(i)), F.lit(bits)) for i in range(hashes)]


def filter_bits(keys: DataFrame, key: str) -> int:
    """Bits for a filter of these keys: BITS_A_KEY for each (about one refused key in 300 passes wrongly), a power of two up to MOST_BITS."""
    n = keys.agg(F.approx_count_distinct(key)).first()[0]
    bits = BITMAP
    while bits < min(MOST_BITS, n * BITS_A_KEY):
        bits *= 2
    return bits


def bit_filter(keys: DataFrame, key: str, bits: int, hashes: int = HASHES) -> DataFrame:
    """One row, one binary of ``bits`` bits, set at the places of every key: an aggregate per piece of BITMAP bits, then the pieces in order."""
    places = keys.where(F.col(key).isNotNull()).select(F.explode(F.array(*bit_places(key, bits, hashes))).alias("p"))
    pieces = places.groupBy(F.shiftright("p", 15).cast("int").alias("piece")).agg(F.bitmap_construct_agg(F.col("p") % BITMAP).alias("m"))
    found = pieces.agg(F.map_from_entries(F.collect_list(F.struct("piece", "m"))).alias("by"))
    return found.selectExpr(f"array_join(transform(sequence(0, {bits // BITMAP - 1}), i -> hex(coalesce(element_at(by, i), unhex(repeat('00', {BITMAP // 8}))))), '') AS h") \
        .select(F.unhex("h").alias("bits"))


def may_contain(key: str, filter_: DataFrame, bits: int, hashes: int = HASHES) -> Column:
    """Whether the key may be one of those of the filter, as a condition of the scan: the filter is a scalar subquery."""
    found = F.lit(True)
    for p in bit_places(key, bits, hashes):
        byte = F.conv(F.hex(F.substring(filter_.scalar(), (F.shiftright(p, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        found = found & (F.call_function("getbit", byte, (p % 8).cast("int")) == 1)
    return found
