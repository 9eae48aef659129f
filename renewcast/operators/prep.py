"""Feature preparation: splits, folds, scaling, rare-category mapping, one-hot.

Fitting returns small tables (one row per column or per category level); the
fitted numbers are then used as literals, the way a Spark ML model carries
its parameters.  Nothing row-level passes through the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from renewcast.functions.scalar import map_rare
from renewcast.operators.profiles import rank_in_class, with_hash_key
from renewcast.operators.windows import hash_blocks

# Rare-category lists of the reference (fixed values): categories kept as
# themselves, everything else becomes '99'.
RARE_KEEP = {
    "payment_method_id": ["41", "40", "36", "39", "37"],
    "city": ["1", "13", "5", "4", "15", "22"],
    "registered_via": ["7", "9", "3"],
}
OTHER = "99"
#: Classes a split may have; more of them is an error.
MAX_CLASSES = 1000
# one-hot: all levels for these, first level dropped for the 0/1 flags
ONE_HOT_ALL = ("payment_method_id", "city", "gender", "registered_via")
ONE_HOT_DROP_FIRST = ("is_auto_renew", "is_cancel")


def stratified_split(df: DataFrame, label: str, key: Sequence[str], test_fraction: float = 0.2,
                     seed: int = 611, tie: Sequence[str] = (), name: str = "is_test",
                     exact: bool = True) -> DataFrame:
    """Hold out round(f * n_class) rows of every class, first in md5(key, seed) order.

    Repeatable and independent of partitioning.  Rows are counted per (class, hash block); in the block where a class reaches its
    number the hash of the last row to hold out is looked up (one row per class comes to the driver, from hashes alone), and every row is
    decided by comparing its hash with that one: a projection, no shuffle of rows.  Only where rows that share that very hash are held out
    in part are these ranked, by ``tie``.
    ``exact=False`` skips the counting: a row is held out when its md5 falls in
    the first ``f`` of the hash range -- a pure projection, class shares kept
    in expectation only.
    """
    h = with_hash_key(df, key, seed)
    if not exact:
        frac = F.conv(F.substring("_h", 1, 12), 16, 10).cast("double") / float(16 ** 12)
        return h.withColumn(name, (frac < F.lit(float(test_fraction))).cast("int")).drop("_h")
    narrow = h.select(label, "_h", hash_blocks("_h").alias("_blk"))
    w = Window.partitionBy(label).orderBy("_blk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = narrow.groupBy(label, "_blk").agg(F.count(F.lit(1)).alias("_c"))
    upto = counts.select(label, "_blk", "_c", F.sum("_c").over(w).alias("_upto"), F.sum("_c").over(Window.partitionBy(label)).alias("_n"))
    goal = F.round(F.lit(float(test_fraction)) * F.col("_n"))
    edges = upto.where((F.col("_upto") >= goal) & (F.col("_upto") - F.col("_c") < goal)).select(
        F.col(label).alias("_l"), F.col("_blk").alias("_b"), (goal - F.col("_upto") + F.col("_c")).cast("long").alias("_take"))
    # the hashes of one block per class, in order, each with the rows that have it
    ends = narrow.join(edges, F.col(label).eqNullSafe(F.col("_l")) & (F.col("_blk") == F.col("_b"))) \
        .groupBy("_l", "_take", "_h").agg(F.count(F.lit(1)).alias("_same"))
    run = F.sum("_same").over(Window.partitionBy("_l").orderBy("_h").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = ends.withColumn("_run", run).where((F.col("_run") >= F.col("_take")) & (F.col("_run") - F.col("_same") < F.col("_take"))) \
        .select("_l", "_h", "_same", (F.col("_take") - F.col("_run") + F.col("_same")).alias("_of_these")).limit(MAX_CLASSES + 1).collect()
    if len(last) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes in {label}")
    edge, part = F.lit(""), F.lit(None).cast("long")           # below every hash: a class of which no row is held out
    for e in last:
        own = F.col(label).eqNullSafe(F.lit(e["_l"]))
        edge = F.when(own, e["_h"]).otherwise(edge)
        if e["_of_these"] < e["_same"]:
            part = F.when(own, e["_of_these"]).otherwise(part)
    decided = h.withColumn(name, (F.col("_h") <= edge).cast("int"))
    if all(e["_of_these"] == e["_same"] for e in last):
        return decided.drop("_h")
    split_tie = (F.col("_h") == edge) & part.isNotNull()
    place = F.row_number().over(Window.partitionBy(label, "_h").orderBy(*([F.col(c).asc_nulls_first() for c in tie] or [F.col("_h")])))
    ranked = h.where(split_tie).withColumn(name, (place <= part).cast("int"))
    return decided.where(~F.coalesce(split_tie, F.lit(False))).unionByName(ranked).drop("_h")


def stratified_folds(df: DataFrame, label: str, key: Sequence[str], k: int = 3, seed: int = 42,
                     tie: Sequence[str] = (), name: str = "fold") -> DataFrame:
    """Fold id (rank - 1) mod k within each class in md5(key, seed) order: class shares kept."""
    r = rank_in_class(df, label, key, seed, tie)
    return r.withColumn(name, ((F.col("_rank") - 1) % k).cast("int")).drop("_rank", "_class_n", "_h")


def fit_scaler(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Training mean and population std per column (long form, one aggregate)."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"m_{c}"), F.stddev_pop(x).alias(f"s_{c}")]
    wide = df.agg(*aggs)
    pairs = ", ".join(f"'{c}', `m_{c}`, `s_{c}`" for c in cols)
    return wide.select(F.expr(f"stack({len(cols)}, {pairs}) AS (column, mean, std)"))


def scaler_params(stats: DataFrame) -> dict[str, tuple[float, float]]:
    """Fitted (mean, std) per column; one row per column comes back to the driver."""
    return {r["column"]: (r["mean"], r["std"]) for r in stats.collect()}


def apply_scaler(df: DataFrame, params: Mapping[str, tuple[float, float]]) -> DataFrame:
    """(x - mean) / std with the training statistics; a zero std divides by 1 (Q6)."""
    cols = []
    for c in df.columns:
        if c in params:
            m, s = params[c]
            s = 1.0 if (s is None or s == 0) else s
            m = 0.0 if m is None else m
            cols.append(((F.col(c).cast("double") - F.lit(m)) / F.lit(s)).alias(c))
        else:
            cols.append(F.col(c))
    return df.select(*cols)


def apply_rare_maps(df: DataFrame, keep: Mapping[str, Sequence[str]] = RARE_KEEP,
                    other: str = OTHER) -> DataFrame:
    cols = [map_rare(c, keep[c], other).alias(c) if c in keep else F.col(c) for c in df.columns]
    return df.select(*cols)


def fit_vocabulary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct levels per categorical column on the training rows (long form).

    One scan: the columns are stacked to (column, level) pairs and de-duplicated
    with partial aggregation, whatever the number of columns.
    """
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in cols)
    long = df.select(F.expr(f"stack({len(cols)}, {pairs}) AS (column, level)"))
    return long.where(F.col("level").isNotNull()).distinct()


#: Levels that one-hot columns are made for, over all columns; more of them is an error, not a cut.
MAX_LEVELS = 5000


def vocabulary(vocab: DataFrame, max_levels: int = MAX_LEVELS) -> dict[str, list[str]]:
    """Sorted levels per column; raises beyond ``max_levels`` in all (rows that come to the driver)."""
    out: dict[str, list[str]] = {}
    rows = vocab.limit(max_levels + 1).collect()
    if len(rows) > max_levels:
        raise ValueError(f"more than {max_levels} category levels: map rare ones first")
    for r in rows:
        out.setdefault(r["column"], []).append(r["level"])
    return {k: sorted(v) for k, v in out.items()}


def dummy_names(vocab: Mapping[str, Sequence[str]], all_levels: Sequence[str] = ONE_HOT_ALL,
                drop_first: Sequence[str] = ONE_HOT_DROP_FIRST) -> list[tuple[str, str, str]]:
    """(output name, column, level) in the reference's order: all-level columns first,
    then the drop-first flags."""
    names = []
    for c in all_levels:
        for v in vocab.get(c, []):
            names.append((f"{c}_{v}", c, v))
    for c in drop_first:
        for v in vocab.get(c, [])[1:]:
            names.append((f"{c}_{v}", c, v))
    return names


def one_hot(df: DataFrame, vocab: Mapping[str, Sequence[str]], keep: Sequence[str] = (),
            all_levels: Sequence[str] = ONE_HOT_ALL,
            drop_first: Sequence[str] = ONE_HOT_DROP_FIRST) -> DataFrame:
    """0/1 column per fitted level; a level unseen in training gives all zeros (Q7)."""
    dummies = [(F.coalesce(F.col(c).cast("string") == F.lit(v), F.lit(False))).cast("int").alias(n)
               for n, c, v in dummy_names(vocab, all_levels, drop_first)]
    return df.select(*keep, *dummies)


def feature_matrix(df: DataFrame, params: Mapping[str, tuple[float, float]],
                   vocab: Mapping[str, Sequence[str]], numeric: Sequence[str],
                   keep: Sequence[str] = ()) -> DataFrame:
    """map_rare -> scale -> one-hot -> final column order (numeric, dummies, flags)."""
    mapped = apply_rare_maps(df)
    scaled = apply_scaler(mapped, params)
    dummies = [(F.coalesce(F.col(c).cast("string") == F.lit(v), F.lit(False))).cast("int").alias(n)
               for n, c, v in dummy_names(vocab)]
    return scaled.select(*keep, *numeric, *dummies)


def feature_names(numeric: Sequence[str], vocab: Mapping[str, Sequence[str]]) -> list[str]:
    return [*numeric, *[n for n, _, _ in dummy_names(vocab)]]
