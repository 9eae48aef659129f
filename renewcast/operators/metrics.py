"""Evaluation and monitoring metrics from a table of (y_true, score[, y_pred]).

Everything is an aggregate over the prediction table, grouped by any
columns (model, data set, day), so all groups are evaluated in one job:

* confusion counts: four conditional sums;
* ROC AUC: counts per distinct score, a blocked running sum of negatives,
  sum of pos * (neg_below + neg_tied / 2) / (P * N) -- ties count half;
* threshold sweep: each distinct score is bucketed by the number of cut-offs
  at or below it, then suffix sums over at most (cut-offs + 1) buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from renewcast.operators.windows import first_argmax, order_blocks, running_sum
from renewcast.session import written

BETA = 1.5


def default_cutoffs(lo_pct: int = 10, hi_pct: int = 89, step_pct: int = 1) -> list[float]:
    """Cut-offs 0.10 .. 0.89 written as two-decimal literals (no float drift)."""
    return [round(i / 100, 2) for i in range(lo_pct, hi_pct + 1, step_pct)]


def confusion_counts(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred",
                     by: Sequence[str] = ()) -> DataFrame:
    """TN, FP, FN, TP per group (a single class present is fine: the others are 0)."""
    t, p = F.col(y_true), F.col(y_pred)
    return df.groupBy(*by).agg(
        F.count_if((t == 0) & (p == 0)).alias("tn"),
        F.count_if((t == 0) & (p == 1)).alias("fp"),
        F.count_if((t == 1) & (p == 0)).alias("fn"),
        F.count_if((t == 1) & (p == 1)).alias("tp"),
    )


def _div0(num: Column, den: Column) -> Column:
    """num / den, 0 when den = 0 (sklearn ``zero_division`` default)."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den)


def false_omission_rate(tn: Column | str = "tn", fn: Column | str = "fn") -> Column:
    """FN / (TN + FN), 0 when nothing is predicted negative (the reference's "FN rate")."""
    tn, fn = (F.col(x) if isinstance(x, str) else x for x in (tn, fn))
    return _div0(fn, tn + fn)


def precision(tp="tp", fp="fp") -> Column:
    tp, fp = (F.col(x) if isinstance(x, str) else x for x in (tp, fp))
    return _div0(tp, tp + fp)


def recall(tp="tp", fn="fn") -> Column:
    tp, fn = (F.col(x) if isinstance(x, str) else x for x in (tp, fn))
    return _div0(tp, tp + fn)


def fbeta(tp="tp", fp="fp", fn="fn", beta: float = BETA) -> Column:
    """(1+b^2) TP / ((1+b^2) TP + b^2 FN + FP); 0 on an empty denominator."""
    tp, fp, fn = (F.col(x) if isinstance(x, str) else x for x in (tp, fp, fn))
    b2 = beta * beta
    num = F.lit(1.0 + b2) * tp
    return _div0(num, num + F.lit(b2) * fn + fp)


def hard_auc(tn="tn", fp="fp", fn="fn", tp="tp") -> Column:
    """AUC of 0/1 predictions = (TPR + TNR) / 2; null when a class is absent (Q8)."""
    tn, fp, fn, tp = (F.col(x) if isinstance(x, str) else x for x in (tn, fp, fn, tp))
    pos, neg = tp + fn, tn + fp
    return F.when((pos == 0) | (neg == 0), F.lit(None).cast("double")).otherwise(
        (tp.cast("double") / pos + tn.cast("double") / neg) / 2)


def with_rates(counts: DataFrame, beta: float = BETA) -> DataFrame:
    """Add precision, recall, F-beta, false omission rate and hard AUC to confusion counts."""
    return counts.select("*", precision().alias("precision"), recall().alias("recall"),
                         fbeta(beta=beta).alias("f1_5"), false_omission_rate().alias("fn_rate"),
                         hard_auc().alias("hard_auc"))


def score_counts(df: DataFrame, y_true: str = "y_true", score: str = "score",
                 by: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per (group, distinct score): the input of every ROC metric."""
    return df.where(F.col(score).isNotNull() & F.col(y_true).isNotNull()).groupBy(*by, score).agg(
        F.sum(F.col(y_true).cast("long")).alias("pos"),
        F.count_if(F.col(y_true) == 0).alias("neg"))


def auc_of_counts(sc: DataFrame, score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve per group from positives and negatives per distinct score; ties count half.

    Scores are dealt into blocks by range.  A block counts its own pairs, and its positives meet the negatives of all blocks below it as
    one product, so rows are never joined with offsets.
    null when a group has only one class (sklearn raises there).
    """
    d = order_blocks(sc, [F.col(score).asc_nulls_first()], by)
    within = Window.partitionBy(*by, "_blk").orderBy(score).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    below = (F.sum("neg").over(within) - F.col("neg")).cast("double")
    blocks = d.select(*by, "_blk", "pos", "neg", (F.col("pos").cast("double") * (below + F.col("neg").cast("double") / 2)).alias("_u")) \
        .groupBy(*by, "_blk").agg(F.sum("_u").alias("_u"), F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)       # a row for each block of a group
    under = F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("double")
    agg = blocks.select(*by, "_p", "_n", (F.col("_u") + F.col("_p").cast("double") * under).alias("_u")) \
        .groupBy(*by).agg(F.sum("_u").alias("_u"), F.sum("_p").alias("_p"), F.sum("_n").alias("_n"))
    auc = F.when((F.col("_p") == 0) | (F.col("_n") == 0), F.lit(None).cast("double")).otherwise(
        F.col("_u") / (F.col("_p").cast("double") * F.col("_n").cast("double")))
    return agg.select(*by, auc.alias("auc"))


def roc_auc(df: DataFrame, y_true: str = "y_true", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve per group of rows; tied scores count half."""
    return auc_of_counts(score_counts(df, y_true, score, by), score, by)


def _decided_counts(df: DataFrame, y_true: str, y_pred: str, score: str, by: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per (group, score, decision), written: the one aggregate over the
    predictions that both the confusion counts and the AUC are read from."""
    t = F.col(y_true)
    return written(df.groupBy(*by, F.col(score).alias("_score"), F.col(y_pred).alias("_pred"), *extra).agg(
        F.count_if(t == 1).alias("pos"), F.count_if(t == 0).alias("neg")), "decided_counts")


def _confusion_of(decided: DataFrame, by: Sequence[str], *more: Column) -> DataFrame:
    """Confusion counts from ``_decided_counts``."""
    p = F.col("_pred")

    def total(col: str, pred: int) -> Column:
        return F.coalesce(F.sum(F.when(p == pred, F.col(col))), F.lit(0)).cast("long")

    return decided.groupBy(*by).agg(total("neg", 0).alias("tn"), total("neg", 1).alias("fp"), total("pos", 0).alias("fn"),
                                    total("pos", 1).alias("tp"), *more)


def _auc_of_decided(decided: DataFrame, by: Sequence[str]) -> DataFrame:
    counts = decided.where("_score IS NOT NULL AND pos + neg > 0").groupBy(*by, "_score").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return auc_of_counts(counts, "_score", by)


def roc_curve(df: DataFrame, y_true: str = "y_true", score: str = "score",
              by: Sequence[str] = ()) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score, descending; all points kept."""
    sc = score_counts(df, y_true, score, by)
    rs = running_sum(sc, [score], ["pos", "neg"], group=list(by), descending=True, with_total=True)
    return rs.select(*by, F.col(score).alias("threshold"),
                     _div0(F.col("neg_cum"), F.col("neg_total")).alias("fpr"),
                     _div0(F.col("pos_cum"), F.col("pos_total")).alias("tpr"))


def roc_area_trapezoid(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Trapezoid area under a ``roc_curve`` (origin added); equals ``roc_auc``.

    The points are dealt into blocks by range of (group, threshold).  Within a block a point's neighbour is the one before it;
    the first point of a block takes the last one of its group's block before, from a table with a row per (group, block).
    """
    falling = F.col("threshold").desc_nulls_last()
    d = order_blocks(curve.select(*by, "threshold", "fpr", "tpr"), [falling], by)
    ends = d.groupBy(*by, "_blk").agg(F.min_by(F.struct("fpr", "tpr"), "threshold").alias("_end"))
    before = F.lag("_end").over(Window.partitionBy(*by).orderBy("_blk"))          # as many rows a group as there are blocks
    ends = ends.select(*[F.col(c).alias(f"_b_{c}") for c in by], F.col("_blk").alias("_b_blk"), before.alias("_before"))
    same = F.col("_blk") == F.col("_b_blk")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    last = F.coalesce(F.lag(F.struct("fpr", "tpr")).over(Window.partitionBy(*by, "_blk").orderBy(falling)), F.col("_before"),
                      F.struct(F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")))
    pts = d.join(ends, same).select(*by, "fpr", "tpr", last.alias("_last"))
    return pts.groupBy(*by).agg(F.sum((F.col("fpr") - F.col("_last.fpr")) * (F.col("tpr") + F.col("_last.tpr")) / 2).alias("auc"))


def threshold_sweep(spark: SparkSession, df: DataFrame, y_true: str = "y_true", score: str = "score",
                    cutoffs: Sequence[float] | None = None, beta: float = BETA) -> DataFrame:
    """Confusion counts and rates at every cut-off in one pass over the data.

    A score s is predicted positive at cut-off t when s >= t.  Each row gets
    bucket k = number of cut-offs <= s (a comparison tree in the generated code), so TP at cut-off i is the sum of
    positives over buckets k >= i + 1.  After the one aggregate there are at most len(cutoffs) + 1 rows; they are
    gathered into one, and all cut-offs are read from it.
    """
    cuts = sorted(float(c) for c in (cutoffs if cutoffs is not None else default_cutoffs()))
    rows = df.where(F.col(score).isNotNull() & F.col(y_true).isNotNull()) \
        .select(F.col(score).cast("double").alias("_s"), F.col(y_true).alias("_y"))
    buckets = rows.groupBy(cuts_reached("_s", cuts).alias("k")).agg(
        F.sum(F.col("_y").cast("long")).alias("pos"), F.count_if(F.col("_y") == 0).alias("neg"))
    table = buckets.agg(F.collect_list(F.struct("k", "pos", "neg")).alias("b"))

    def total(part: str, least: str) -> str:
        return f"aggregate(filter(b, x -> x.k >= {least}), 0L, (a, x) -> a + x.{part})"

    listed = f"CAST(split('{','.join(map(repr, cuts))}', ',') AS ARRAY<DOUBLE>)"
    t = table.selectExpr(
        f"{total('pos', '0')} AS _p", f"{total('neg', '0')} AS _n",
        f"inline(transform({listed}, (c, i) -> struct(c AS threshold, {total('pos', 'i + 1')} AS tp, {total('neg', 'i + 1')} AS fp)))")
    out = t.select("threshold", "tp", "fp", (F.col("_p") - F.col("tp")).alias("fn"), (F.col("_n") - F.col("fp")).alias("tn"))
    return out.select("threshold", "tp", "fp", "fn", "tn",
                      fbeta(beta=beta).alias("f1_5"), false_omission_rate().alias("fn_rate"),
                      precision().alias("precision"), recall().alias("recall"))


def cuts_reached(column: str, cuts: Sequence[float]) -> Column:
    """How many of the ascending cut-offs are at or below the value; NaN reaches all.  As deep as the logarithm of their number."""
    def tree(low: int, high: int) -> str:
        if low == high:
            return str(low)
        mid = (low + high) // 2
        return f"CASE WHEN `{column}` < double('{cuts[mid]!r}') THEN {tree(low, mid)} ELSE {tree(mid + 1, high)} END"

    return F.expr(tree(0, len(cuts)))


def best_threshold(sweep: DataFrame, metric: str = "f1_5") -> DataFrame:
    """First cut-off (lowest threshold) having the largest ``metric``."""
    return first_argmax(sweep, metric, ["threshold"])


def campaign_metrics(counts: DataFrame) -> DataFrame:
    """Targeted share, churners caught / missed, campaign efficiency from confusion counts."""
    total = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    churn = F.col("tp") + F.col("fn")
    target = F.col("tp") + F.col("fp")
    return counts.select(
        "*", total.alias("total_users"), churn.alias("total_churn"), target.alias("targeted"),
        _div0(target, total).alias("targeted_share"), F.col("tp").alias("caught"),
        _div0(F.col("tp"), churn).alias("caught_share"), F.col("fn").alias("missed"),
        _div0(F.col("fn"), churn).alias("missed_share"), _div0(F.col("tp"), target).alias("efficiency"))


def evaluate_split(df: DataFrame, by: Sequence[str], threshold: float | Column,
                   y_true: str = "y_true", score: str = "score", beta: float = BETA) -> DataFrame:
    """AUC, F-beta, precision, recall, counts, threshold, totals per (model, data set)."""
    thr = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    pred = df.withColumn("_thr", thr).withColumn("_decision", (F.col(score) >= F.col("_thr")).cast("int"))
    # the cut-off may be a per-row column (e.g. each model's own threshold): report it per group
    decided = _decided_counts(pred, y_true, "_decision", score, by, ["_thr"])
    counts = with_rates(_confusion_of(decided, by, F.max("_thr").alias("threshold")), beta)
    auc = _auc_of_decided(decided, by)
    j = join_groups(counts, auc, by, "left") if by else _attach(counts, auc)
    return campaign_metrics(j)


def join_groups(a: DataFrame, b: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join two per-group results on the group columns, null-safe: rows in no
    group (e.g. the split gap) form a group of their own."""
    bb = b.select(*[F.col(c).alias(f"_b_{c}") for c in by], *[c for c in b.columns if c not in by])
    cond = None
    for c in by:
        e = F.col(c).eqNullSafe(F.col(f"_b_{c}"))
        cond = e if cond is None else cond & e
    return a.join(bb, cond, how).drop(*[f"_b_{c}" for c in by])


def _attach(a: DataFrame, one_row: DataFrame) -> DataFrame:
    from renewcast.operators.profiles import attach_scalar
    return attach_scalar(a, one_row)


def daily_monitor(preds: DataFrame, day: str = "day", y_true: str = "y_true", y_pred: str = "y_pred",
                  score: str | None = None, beta: float = BETA) -> DataFrame:
    """Per day: rows, false omission rate, F-beta, hard AUC of 0/1 predictions (Q8) and,
    when a score column is given, the score AUC.

    All days come from one aggregate over the predictions, (day, score, decision) counts; the null day is a day of its own.
    """
    if score:
        decided = _decided_counts(preds, y_true, y_pred, score, [day])
        counts = _confusion_of(decided, [day])
    else:
        counts = confusion_counts(preds, y_true, y_pred, [day])
    out = counts.select(day, (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("rows"),
                        "tn", "fp", "fn", "tp", false_omission_rate().alias("fn_rate"),
                        fbeta(beta=beta).alias("f1_5"), hard_auc().alias("auc"))
    if score:
        out = join_groups(out, _auc_of_decided(decided, [day]).withColumnRenamed("auc", "score_auc"), [day], "left")
    return out
