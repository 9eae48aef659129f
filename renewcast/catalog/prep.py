"""Model-set assembly and feature-preparation queries."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F

from renewcast import oracle as O
from renewcast.catalog.features import GOLD_DOUBLES, _GOLD_SQL, gold
from renewcast.operators import prep as PR
from renewcast.operators import profiles as P
from renewcast.plans import assembly as A
from renewcast.plans import labels as L
from renewcast.plans.features import USAGE_FEATURES
from renewcast.registry import query
from renewcast.session import written
from renewcast.sources import fixtures as fx

KEY = ["msno", "membership_start_date", "membership_expire_date"]
W = (fx.WINDOW_LO, fx.WINDOW_HI)
FEATS = list(A.FEATURE_COLUMNS)
NUMERIC = list(A.NUMERIC)
MS_DOUBLES = [c for c in GOLD_DOUBLES if c in FEATS]


def labels_with_tie(spark, sf, tx=None):
    return L.renewal_labels(fx.transactions(spark, sf) if tx is None else tx, window=W, burst_n=fx.BURST_THRESHOLD_ORDERS,
                            tail_end=fx.TAIL_END, tail_days=fx.TAIL_DAYS, keep=("tx_id",))


def model_set(spark, sf):
    """Labels and features both read one written table of transactions; of the feature store only the periods that
    ``assemble_model_set`` takes are built: those of its plan lengths that have a label."""
    tx = written(fx.transactions(spark, sf), "transactions")
    labels = written(labels_with_tie(spark, sf, tx).select(*KEY, "churn", "tx_id"), "labels")
    return A.assemble_model_set(labels, gold(spark, sf, tx=tx, plan_days=A.PLAN_DAYS, periods=labels.select(*KEY)),
                                plan_days=A.PLAN_DAYS, train_before=fx.SPLIT_TRAIN_BEFORE, oot_end=fx.SPLIT_OOT_END,
                                inference_after=fx.SPLIT_INFERENCE_AFTER)


def train_part(spark, sf, cols=()):
    """Training rows of the model set with the 80/20 hold-out flag: keys, label and ``cols``.  The split reads its rows more than
    once, so they are written."""
    ms = written(model_set(spark, sf).where(F.col("split") == "train").select(*KEY, "churn", *cols), "training_rows")
    return PR.stratified_split(ms, "churn", KEY, 0.2, 611)


_FEAT_ORDER = ", ".join(f"{c} NULLS FIRST" for c in ["tx_id", *USAGE_FEATURES])
_NOT_NULL = " AND ".join(f"f.{c} IS NOT NULL" for c in FEATS)
_MS = f"""
gold AS ({_GOLD_SQL}),
lab AS (
  SELECT msno, membership_start_date, membership_expire_date, churn FROM (
    SELECT *, CASE WHEN days_diff IS NULL THEN 0 WHEN days_diff > 5 THEN 1 ELSE 0 END AS churn,
           row_number() OVER (PARTITION BY msno, membership_start_date, membership_expire_date
                              ORDER BY tx_id NULLS FIRST) AS rn
    FROM label_silver) x WHERE rn = 1),
feat AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY msno, membership_start_date, membership_expire_date
                                 ORDER BY {_FEAT_ORDER}) AS rn
    FROM gold WHERE datediff('day', membership_start_date, membership_expire_date) IN (30, 31)) x
  WHERE rn = 1),
joined AS (
  SELECT l.msno, l.membership_start_date, l.membership_expire_date, l.churn,
         {", ".join("f." + c for c in FEATS)}
  FROM lab l LEFT JOIN feat f ON f.msno = l.msno AND f.membership_start_date = l.membership_start_date
   AND f.membership_expire_date = l.membership_expire_date
  WHERE {_NOT_NULL}),
ms AS (
  SELECT *, CASE WHEN membership_start_date < DATE '{fx.SPLIT_TRAIN_BEFORE}' THEN 'train'
                 WHEN membership_start_date <= DATE '{fx.SPLIT_OOT_END}' THEN 'oot'
                 WHEN membership_start_date > DATE '{fx.SPLIT_INFERENCE_AFTER}' THEN 'inference' END AS split
  FROM joined),
tr AS (
  SELECT * EXCLUDE (rn, n), CAST(rn <= round(0.2 * n) AS INTEGER) AS is_test FROM (
    SELECT *, row_number() OVER (PARTITION BY churn ORDER BY md5(concat_ws('|', msno,
               CAST(membership_start_date AS VARCHAR), CAST(membership_expire_date AS VARCHAR), '611'))) AS rn,
           count(*) OVER (PARTITION BY churn) AS n
    FROM ms WHERE split = 'train') x),
fit AS (SELECT * FROM tr WHERE is_test = 0),
stats AS (
  {" UNION ALL ".join(f"SELECT '{c}' AS col, avg(CAST({c} AS DOUBLE)) AS mean, stddev_pop(CAST({c} AS DOUBLE)) AS std FROM fit" for c in NUMERIC)})"""


def _ms_sql(body, doubles=()):
    return O.with_base(body, O.usage_block(1, False) + "," + _MS, doubles=doubles)


@query("assemble_model_set", _ms_sql("SELECT * FROM ms", MS_DOUBLES), headline=True)
def assemble_model_set(spark, sf):
    """Labels (deduped) x 30/31-day features (deduped), null rows dropped, time split (gap -> null)."""
    return model_set(spark, sf)


@query("label_feature_join", _ms_sql("SELECT * FROM joined", MS_DOUBLES))
def label_feature_join(spark, sf):
    """Labels and features, each deduped by period, joined; rows with any null dropped."""
    from renewcast.operators.joins import label_feature_join as join
    from renewcast.operators.windows import dedupe_first
    lab = dedupe_first(labels_with_tie(spark, sf).select(*KEY, "churn", "tx_id"), KEY, ["tx_id"]).drop("tx_id")
    feat = gold(spark, sf).where(F.datediff("membership_expire_date", "membership_start_date").isin(30, 31))
    order = ["tx_id", *USAGE_FEATURES]
    feat = dedupe_first(feat.select(*KEY, *dict.fromkeys([*FEATS, *order])), KEY, order)
    return join(lab, feat.select(*KEY, *FEATS)).select(*KEY, "churn", *FEATS)


@query("label_balance", _ms_sql("""
SELECT split, count(*) AS total, CAST(sum(churn) AS BIGINT) AS churned, avg(CAST(churn AS DOUBLE)) AS churn_ratio
FROM ms GROUP BY split""", ["churn_ratio"]))
def label_balance(spark, sf):
    """Total, churned and churn ratio per data set (null = the split gap)."""
    return P.label_balance(model_set(spark, sf), "churn", "split")


@query("stratified_split", _ms_sql("SELECT msno, membership_start_date, membership_expire_date, churn, is_test FROM tr"))
def stratified_split(spark, sf):
    """80/20 hold-out of the training rows, class shares kept, md5-ordered (seed 611)."""
    return train_part(spark, sf).select(*KEY, "churn", "is_test")


@query("stratified_folds", _ms_sql("""
SELECT msno, membership_start_date, membership_expire_date, churn,
       CAST((row_number() OVER (PARTITION BY churn ORDER BY md5(concat_ws('|', msno,
               CAST(membership_start_date AS VARCHAR), CAST(membership_expire_date AS VARCHAR), '42'))) - 1) % 3
            AS INTEGER) AS fold
FROM fit"""))
def stratified_folds(spark, sf):
    """3 folds per class in md5 order (seed 42) over the fitting rows."""
    fit = train_part(spark, sf).where(F.col("is_test") == 0)
    return PR.stratified_folds(fit, "churn", KEY, 3, 42).select(*KEY, "churn", "fold")


def fit_rows(spark, sf, cols):
    return train_part(spark, sf, cols).where(F.col("is_test") == 0)


@query("fit_scaler", _ms_sql('SELECT col AS "column", mean, std FROM stats', ["mean", "std"]))
def fit_scaler(spark, sf):
    """Training mean and population std of the 20 numeric columns."""
    return PR.fit_scaler(fit_rows(spark, sf, NUMERIC), NUMERIC)


_SCALED = ", ".join(
    f"(CAST(m.{c} AS DOUBLE) - (SELECT mean FROM stats WHERE col = '{c}')) / "
    f"(SELECT CASE WHEN std = 0 OR std IS NULL THEN 1.0 ELSE std END FROM stats WHERE col = '{c}') AS {c}"
    for c in NUMERIC)


@query("apply_scaler", _ms_sql(f"SELECT m.msno, m.membership_start_date, m.membership_expire_date, {_SCALED} FROM ms m",
                               NUMERIC))
def apply_scaler(spark, sf):
    """Every model-set row scaled with the training statistics (no re-fit per day, Q6)."""
    p = prepared(spark, sf)
    return PR.apply_scaler(p.model_set.select(*KEY, *NUMERIC), p.scaler)


def _rare_sql(c, alias=None):
    alias = alias or c
    if c in PR.RARE_KEEP:
        keep = ", ".join(f"'{v}'" for v in PR.RARE_KEEP[c])
        return f"CASE WHEN {c} IN ({keep}) THEN {c} ELSE '99' END AS {alias}"
    return f"CAST({c} AS VARCHAR) AS {alias}"


@query("fit_vocabulary", _ms_sql(" UNION ALL ".join(
    f"SELECT DISTINCT '{c}' AS \"column\", lv AS level FROM (SELECT {_rare_sql(c, 'lv')} FROM fit) x "
    f"WHERE lv IS NOT NULL" for c in A.CATEGORICAL)))
def fit_vocabulary(spark, sf):
    """Levels per categorical column after rare mapping, fitted on the training rows only."""
    return PR.fit_vocabulary(PR.apply_rare_maps(fit_rows(spark, sf, A.CATEGORICAL)), list(A.CATEGORICAL))


@lru_cache(maxsize=None)
def _fixture_vocab():
    """Levels the fixture's training rows hold (payment 36..41, nations 0..24, segments, 0..11)."""
    return {
        "payment_method_id": sorted(["36", "37", "39", "40", "41", "99"]),
        "city": sorted(["1", "13", "15", "22", "4", "5", "99"]),
        "gender": sorted(["AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY", "na"]),
        "registered_via": sorted(["3", "7", "9", "99"]),
        "is_auto_renew": ["0", "1"],
        "is_cancel": ["0", "1"],
    }


def _dummies_sql():
    parts = []
    for name, c, v in PR.dummy_names(_fixture_vocab()):
        src = _rare_sql(c, "x").rsplit(" AS ", 1)[0]
        parts.append(f"CAST(coalesce(({src}) = '{v}', false) AS INTEGER) AS \"{name}\"")
    return ", ".join(parts)


def prepared(spark, sf):
    """Model set and training pool written once; scaler and vocabulary fitted on the
    training rows (flags keep both levels) -- see ``plans.training.prepare``."""
    from renewcast.plans.training import prepare
    return prepare(spark, model_set(spark, sf))


@query("one_hot", _ms_sql(f"SELECT msno, membership_start_date, membership_expire_date, {_dummies_sql()} FROM ms"))
def one_hot(spark, sf):
    """0/1 column per training level (flags: first level dropped) for every model-set row."""
    p = prepared(spark, sf)
    return PR.one_hot(PR.apply_rare_maps(p.model_set), p.vocabulary, keep=KEY)


_LEVELS = " UNION ALL ".join(
    f"SELECT DISTINCT '{c}' AS col, lv FROM (SELECT {_rare_sql(c, 'lv')} FROM fit) x WHERE lv IS NOT NULL" for c in PR.ONE_HOT_ALL)
_MAPPED = " UNION ALL ".join(
    f"SELECT msno, membership_start_date, membership_expire_date, '{c}' AS col, {_rare_sql(c, 'v')} FROM ms"
    for c in (*PR.ONE_HOT_ALL, *PR.ONE_HOT_DROP_FIRST))


@query("one_hot__fitted_levels", _ms_sql(f"""
SELECT m.msno, m.membership_start_date, m.membership_expire_date, l.col || '_' || l.lv AS name,
       CAST(coalesce(m.v = l.lv, false) AS INTEGER) AS value
FROM ({_MAPPED}) m JOIN ({_LEVELS} UNION ALL SELECT 'is_auto_renew', '1' UNION ALL SELECT 'is_cancel', '1') l ON l.col = m.col"""))
def one_hot_fitted_levels(spark, sf):
    """The one-hot columns in long form, against the levels that SQL finds in the training rows itself."""
    p = prepared(spark, sf)
    names = [n for n, _, _ in PR.dummy_names(p.vocabulary)]
    wide = PR.one_hot(PR.apply_rare_maps(p.model_set), p.vocabulary, keep=KEY)
    pairs = ", ".join(f"'{n}', `{n}`" for n in names)
    return wide.select(*KEY, F.expr(f"stack({len(names)}, {pairs}) AS (name, value)"))


@query("feature_matrix", _ms_sql(f"SELECT m.msno, m.membership_start_date, m.membership_expire_date, {_SCALED}, "
                                 f"{_dummies_sql()} FROM ms m", NUMERIC))
def feature_matrix(spark, sf):
    """map_rare -> scale -> one-hot -> fixed column order (20 numeric + dummies + 2 flags)."""
    p = prepared(spark, sf)
    return PR.feature_matrix(p.model_set, p.scaler, p.vocabulary, NUMERIC, keep=KEY)
