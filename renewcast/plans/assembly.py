"""Model-set assembly: labels x features -> train / out-of-time / inference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from renewcast.operators.filters import plan_days_in, split_by_time
from renewcast.operators.joins import PERIOD_KEY, label_feature_join
from renewcast.operators.windows import dedupe_first
from renewcast.plans.features import USAGE_FEATURES

CATEGORICAL = ("payment_method_id", "is_auto_renew", "is_cancel", "city", "gender", "registered_via")
NUMERIC = ("discount_ratio", *USAGE_FEATURES, "account_age")
PLAN_DAYS = (30, 31)
FEATURE_COLUMNS = ("payment_method_id", "is_auto_renew", "is_cancel", "discount_ratio", *USAGE_FEATURES,
                   "city", "gender", "registered_via", "account_age")


def assemble_model_set(labels: DataFrame, features: DataFrame,
                       label_order: Sequence[str] = ("tx_id",),
                       feature_order: Sequence[str] = ("tx_id", *USAGE_FEATURES),
                       plan_days: Sequence[int] = PLAN_DAYS,
                       train_before: str = "2016-11-01", oot_end: str = "2016-11-30",
                       inference_after: str = "2016-12-01") -> DataFrame:
    """Dedupe labels, keep 30/31-day feature periods, dedupe features, left join,
    drop rows with any null, add the ``split`` column (null = in no set, Q5).

    ``labels`` needs the period key, ``churn`` and the ``label_order`` columns;
    ``features`` the period key, the 26 feature columns and ``feature_order``.
    Every "keep first" is a ``min_by`` aggregate over an explicit order (Q4).
    """
    lab = dedupe_first(labels.select(*PERIOD_KEY, "churn", *label_order), PERIOD_KEY, label_order) \
        .select(*PERIOD_KEY, "churn")
    feat = plan_days_in(features.select(*PERIOD_KEY, *dict.fromkeys([*FEATURE_COLUMNS, *feature_order])),
                        plan_days)
    feat = dedupe_first(feat, PERIOD_KEY, feature_order).select(*PERIOD_KEY, *FEATURE_COLUMNS)
    j = label_feature_join(lab, feat)
    j = j.select(*PERIOD_KEY, "churn", *FEATURE_COLUMNS)
    return split_by_time(j, "membership_start_date", train_before, oot_end, inference_after)


def write_model_set(model_set: DataFrame, root: str) -> None:
    """Train and OOT as parquet tables, inference fanned out by expiry day."""
    from renewcast.sources.io import write_by_day, write_layer
    write_layer(model_set.where(F.col("split") == "train"), f"{root}/train")
    write_layer(model_set.where(F.col("split") == "oot"), f"{root}/oot")
    write_by_day(model_set.where(F.col("split") == "inference"), f"{root}/inference", "membership_expire_date")
