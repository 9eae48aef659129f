"""Metric and monitoring queries on the fixture predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from renewcast import oracle as O
from renewcast.operators import filters as flt
from renewcast.operators import metrics as M
from renewcast.registry import query
from renewcast.sources import fixtures as fx


def _div0(num: str, den: str) -> str:
    return f"CASE WHEN ({den}) = 0 THEN 0.0 ELSE CAST({num} AS DOUBLE) / ({den}) END"


RATES = (f"{_div0('tp', 'tp + fp')} AS precision, {_div0('tp', 'tp + fn')} AS recall, "
         f"{_div0('CAST(3.25 AS DOUBLE) * tp', 'CAST(3.25 AS DOUBLE) * tp + CAST(2.25 AS DOUBLE) * fn + fp')} AS f1_5, "
         f"{_div0('fn', 'tn + fn')} AS fn_rate, "
         "CASE WHEN tp + fn = 0 OR tn + fp = 0 THEN NULL "
         "ELSE (CAST(tp AS DOUBLE) / (tp + fn) + CAST(tn AS DOUBLE) / (tn + fp)) / 2 END AS hard_auc")
RATE_COLS = ["precision", "recall", "f1_5", "fn_rate", "hard_auc"]
COUNTS = ("CAST(count_if(y_true = 0 AND y_pred = 0) AS BIGINT) AS tn, "
          "CAST(count_if(y_true = 0 AND y_pred = 1) AS BIGINT) AS fp, "
          "CAST(count_if(y_true = 1 AND y_pred = 0) AS BIGINT) AS fn, "
          "CAST(count_if(y_true = 1 AND y_pred = 1) AS BIGINT) AS tp")
CAMPAIGN = (f"tn + fp + fn + tp AS total_users, tp + fn AS total_churn, tp + fp AS targeted, "
            f"{_div0('tp + fp', 'tn + fp + fn + tp')} AS targeted_share, tp AS caught, "
            f"{_div0('tp', 'tp + fn')} AS caught_share, fn AS missed, {_div0('fn', 'tp + fn')} AS missed_share, "
            f"{_div0('tp', 'tp + fp')} AS efficiency")
CAMPAIGN_DOUBLES = ["targeted_share", "caught_share", "missed_share", "efficiency"]


def midrank_auc(src: str, by: str = "") -> str:
    """Mann-Whitney AUC with average ranks (ties half) -- a different formula from the Spark side."""
    part = f"PARTITION BY {by}" if by else ""
    part_s = f"PARTITION BY {by}, score" if by else "PARTITION BY score"
    sel = f"{by}, " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    return f"""
SELECT {sel}CASE WHEN p = 0 OR n = 0 THEN NULL ELSE (rs - p * (p + 1) / 2.0) / (CAST(p AS DOUBLE) * n) END AS auc
FROM (
  SELECT {sel}sum(CASE WHEN y_true = 1 THEN mr ELSE 0 END) AS rs, count_if(y_true = 1) AS p, count_if(y_true = 0) AS n
  FROM (SELECT *, rank() OVER ({part} ORDER BY score) + (count(*) OVER ({part_s}) - 1) / 2.0 AS mr
        FROM {src} WHERE score IS NOT NULL AND y_true IS NOT NULL) r
  {grp}) x"""


@query("confusion_counts", O.with_base(f"SELECT {COUNTS} FROM hard_preds"))
def confusion_counts(spark, sf):
    """TN, FP, FN, TP of the hard (0/1) predictions."""
    return M.confusion_counts(fx.hard_predictions(spark, sf))


@query("false_omission_rate", O.with_base(f"SELECT {_div0('fn', 'tn + fn')} AS fn_rate FROM (SELECT {COUNTS} FROM hard_preds) c",
                                          doubles=["fn_rate"]))
def false_omission_rate(spark, sf):
    c = M.confusion_counts(fx.hard_predictions(spark, sf))
    return c.select(M.false_omission_rate().alias("fn_rate"))


@query("precision_recall_fbeta", O.with_base(f"SELECT tn, fp, fn, tp, {RATES} FROM (SELECT {COUNTS} FROM hard_preds) c",
                                             doubles=RATE_COLS))
def precision_recall_fbeta(spark, sf):
    """Precision, recall, F1.5 (beta = 1.5), FN rate and hard AUC of the hard predictions."""
    return M.with_rates(M.confusion_counts(fx.hard_predictions(spark, sf)))


@query("hard_auc", O.with_base(f"""
SELECT CASE WHEN tp + fn = 0 OR tn + fp = 0 THEN NULL
            ELSE (CAST(tp AS DOUBLE) / (tp + fn) + CAST(tn AS DOUBLE) / (tn + fp)) / 2 END AS auc
FROM (SELECT {COUNTS} FROM hard_preds) c""", doubles=["auc"]))
def hard_auc(spark, sf):
    """AUC of 0/1 predictions (what the monitor reports, Q8)."""
    return M.confusion_counts(fx.hard_predictions(spark, sf)).select(M.hard_auc().alias("auc"))


@query("roc_auc", O.with_base(midrank_auc("scored_preds"), doubles=["auc"]), headline=True)
def roc_auc(spark, sf):
    """ROC AUC of the scored line items (11 distinct scores, heavy ties)."""
    return M.roc_auc(fx.scored_predictions(spark, sf))


@query("roc_auc__by_day", O.with_base(midrank_auc("scored_preds", "day"), doubles=["auc"]))
def roc_auc_by_day(spark, sf):
    """ROC AUC per ship day, all days in one job."""
    return M.roc_auc(fx.scored_predictions(spark, sf), by=["day"])


_SC = """
sc AS (SELECT score, sum(y_true) AS pos, count_if(y_true = 0) AS neg FROM scored_preds
       WHERE score IS NOT NULL GROUP BY score),
curve AS (
  SELECT score AS threshold,
         sum(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) / sum(neg) OVER () AS fpr,
         sum(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) / sum(pos) OVER () AS tpr
  FROM sc)"""


@query("roc_curve", O.with_base("SELECT * FROM curve", _SC, doubles=["threshold", "fpr", "tpr"]))
def roc_curve(spark, sf):
    """(threshold, fpr, tpr) per distinct score, descending; every point kept."""
    return M.roc_curve(fx.scored_predictions(spark, sf))


@query("roc_area_trapezoid", O.with_base("""
SELECT sum((fpr - coalesce(f0, 0.0)) * (tpr + coalesce(t0, 0.0)) / 2) AS auc FROM (
  SELECT *, lag(fpr) OVER (ORDER BY threshold DESC) AS f0, lag(tpr) OVER (ORDER BY threshold DESC) AS t0
  FROM curve) x""", _SC, doubles=["auc"]))
def roc_area_trapezoid(spark, sf):
    return M.roc_area_trapezoid(M.roc_curve(fx.scored_predictions(spark, sf)))


_SWEEP = f"""
cuts AS (SELECT CAST(i AS DOUBLE) / 100 AS threshold FROM range(10, 90) t(i)),
sweep_counts AS (
  SELECT c.threshold,
         CAST(count_if(s.score >= c.threshold AND s.y_true = 1) AS BIGINT) AS tp,
         CAST(count_if(s.score >= c.threshold AND s.y_true = 0) AS BIGINT) AS fp,
         CAST(count_if(s.score < c.threshold AND s.y_true = 1) AS BIGINT) AS fn,
         CAST(count_if(s.score < c.threshold AND s.y_true = 0) AS BIGINT) AS tn
  FROM cuts c, scored_preds s GROUP BY c.threshold),
sweep AS (
  SELECT threshold, tp, fp, fn, tn,
         {_div0('CAST(3.25 AS DOUBLE) * tp', 'CAST(3.25 AS DOUBLE) * tp + CAST(2.25 AS DOUBLE) * fn + fp')} AS f1_5,
         {_div0('fn', 'tn + fn')} AS fn_rate, {_div0('tp', 'tp + fp')} AS precision,
         {_div0('tp', 'tp + fn')} AS recall
  FROM sweep_counts)"""
SWEEP_DOUBLES = ["threshold", "f1_5", "fn_rate", "precision", "recall"]


@query("threshold_sweep", O.with_base("SELECT * FROM sweep", _SWEEP, doubles=SWEEP_DOUBLES), headline=True)
def threshold_sweep(spark, sf):
    """Metrics at the 80 cut-offs 0.10..0.89, one pass over the scores."""
    return M.threshold_sweep(spark, fx.scored_predictions(spark, sf))


@query("best_threshold__f1_5", O.with_base("SELECT * FROM sweep ORDER BY f1_5 DESC, threshold LIMIT 1",
                                          _SWEEP, doubles=SWEEP_DOUBLES))
def best_threshold_f1(spark, sf):
    """First cut-off with the largest F1.5 (training scripts)."""
    return M.best_threshold(M.threshold_sweep(spark, fx.scored_predictions(spark, sf)), "f1_5")


@query("best_threshold__recall", O.with_base("SELECT * FROM sweep ORDER BY recall DESC, threshold LIMIT 1",
                                            _SWEEP, doubles=SWEEP_DOUBLES))
def best_threshold_recall(spark, sf):
    """First cut-off with the largest recall (notebook)."""
    return M.best_threshold(M.threshold_sweep(spark, fx.scored_predictions(spark, sf)), "recall")


@query("first_argmax", O.with_base("SELECT threshold, fn_rate FROM sweep ORDER BY fn_rate DESC, threshold LIMIT 1",
                                   _SWEEP, doubles=["threshold", "fn_rate"]))
def first_argmax(spark, sf):
    """First row in threshold order with the largest FN rate."""
    from renewcast.operators.windows import first_argmax as fa
    return fa(M.threshold_sweep(spark, fx.scored_predictions(spark, sf)), "fn_rate", ["threshold"]) \
        .select("threshold", "fn_rate")


@query("campaign_metrics", O.with_base(f"SELECT tn, fp, fn, tp, {CAMPAIGN} FROM (SELECT {COUNTS} FROM hard_preds) c",
                                       doubles=CAMPAIGN_DOUBLES))
def campaign_metrics(spark, sf):
    return M.campaign_metrics(M.confusion_counts(fx.hard_predictions(spark, sf)))


def _split_scored(spark, sf):
    s = fx.scored_predictions(spark, sf)
    return flt.split_by_time(s, "day", fx.SPLIT_TRAIN_BEFORE, fx.SPLIT_OOT_END, fx.SPLIT_INFERENCE_AFTER,
                             name="dataset")


_DS = f"""
ds AS (
  SELECT *, CASE WHEN day < DATE '{fx.SPLIT_TRAIN_BEFORE}' THEN 'train'
                 WHEN day <= DATE '{fx.SPLIT_OOT_END}' THEN 'oot'
                 WHEN day > DATE '{fx.SPLIT_INFERENCE_AFTER}' THEN 'inference' END AS dataset,
         CAST(score >= 0.5 AS INTEGER) AS y_pred
  FROM scored_preds),
ds_auc AS ({midrank_auc('ds', 'dataset')})"""


@query("evaluate_split", O.with_base(f"""
SELECT c.dataset, tn, fp, fn, tp, {RATES}, a.auc, {CAMPAIGN}, CAST(0.5 AS DOUBLE) AS threshold
FROM (SELECT dataset, {COUNTS} FROM ds GROUP BY dataset) c
LEFT JOIN ds_auc a ON a.dataset IS NOT DISTINCT FROM c.dataset""", _DS,
                                     doubles=[*RATE_COLS, "auc", *CAMPAIGN_DOUBLES, "threshold"]))
def evaluate_split(spark, sf):
    """Per data set (train / oot / inference / none): AUC, F1.5, precision, recall, counts, campaign."""
    return M.evaluate_split(_split_scored(spark, sf), ["dataset"], 0.5)


@query("daily_monitor", O.with_base(f"""
SELECT c.day, tn + fp + fn + tp AS rows, tn, fp, fn, tp, {_div0('fn', 'tn + fn')} AS fn_rate,
       {_div0('CAST(3.25 AS DOUBLE) * tp', 'CAST(3.25 AS DOUBLE) * tp + CAST(2.25 AS DOUBLE) * fn + fp')} AS f1_5,
       CASE WHEN tp + fn = 0 OR tn + fp = 0 THEN NULL
            ELSE (CAST(tp AS DOUBLE) / (tp + fn) + CAST(tn AS DOUBLE) / (tn + fp)) / 2 END AS auc,
       a.auc AS score_auc
FROM (SELECT day, {COUNTS} FROM ds GROUP BY day) c LEFT JOIN day_auc a ON a.day IS NOT DISTINCT FROM c.day""",
                                    _DS + f",\nday_auc AS ({midrank_auc('ds', 'day')})",
                                    doubles=["fn_rate", "f1_5", "auc", "score_auc"]), headline=True)
def daily_monitor(spark, sf):
    """Per day: rows, FN rate, F1.5, AUC of 0/1 predictions and AUC of the scores -- one job for all days."""
    s = fx.scored_predictions(spark, sf).withColumn("y_pred", (F.col("score") >= 0.5).cast("int"))
    return M.daily_monitor(s, "day", score="score")


@query("daily_monitor__stream", O.with_base(f"""
SELECT c.day, tn + fp + fn + tp AS rows, tn, fp, fn, tp, {_div0('fn', 'tn + fn')} AS fn_rate,
       {_div0('CAST(3.25 AS DOUBLE) * tp', 'CAST(3.25 AS DOUBLE) * tp + CAST(2.25 AS DOUBLE) * fn + fp')} AS f1_5,
       CASE WHEN tp + fn = 0 OR tn + fp = 0 THEN NULL
            ELSE (CAST(tp AS DOUBLE) / (tp + fn) + CAST(tn AS DOUBLE) / (tn + fp)) / 2 END AS auc,
       a.auc AS score_auc
FROM (SELECT day, {COUNTS} FROM ds GROUP BY day) c LEFT JOIN day_auc a ON a.day IS NOT DISTINCT FROM c.day""",
                                            _DS + f",\nday_auc AS ({midrank_auc('ds', 'day')})",
                                            doubles=["fn_rate", "f1_5", "auc", "score_auc"]))
def daily_monitor_stream(spark, sf):
    """Stored predictions (partitioned by month) monitored by an available-now stream:
    new files -> days of the touched months recomputed -> those partitions overwritten."""
    from renewcast.session import scratch_path
    from renewcast.streaming.daily import monitor_days, read_monitor, write_predictions
    preds = scratch_path(spark, "predictions_by_month")
    s = fx.scored_predictions(spark, sf).withColumn("y_pred", (F.col("score") >= 0.5).cast("int"))
    write_predictions(s, preds)
    out = scratch_path(spark, "monitor_by_day")
    monitor_days(spark, preds, out, scratch_path(spark, "monitor_checkpoint"))
    return read_monitor(spark, out)
