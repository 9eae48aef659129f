"""Plan checks: no single-task step on row-level data, pruned scans (cross products and Python: test_oracle)."""

import pytest

from sf_paths import SF_SMALL
from renewcast import registry

registry.load_all()
QUERIES = registry.QUERIES
ROW_LEVEL = ["renewal_labels", "renewal_labels__day_blocks", "next_active_transaction", "interval_join", "usage_features", "feature_store",
             "assemble_model_set", "drop_burst_users", "cancel_resume_gap", "user_churn_label",
             "stratified_split", "dedupe_first", "daily_monitor", "roc_auc__by_day", "with_prior_month"]


def _plan(spark, name):
    return QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ROW_LEVEL)
def test_row_level_never_single_partition(spark, name):
    assert "SinglePartition" not in _plan(spark, name)


def test_scan_prunes_columns_and_pushes_filters(spark):
    df = QUERIES["valid_range"](spark, SF_SMALL)
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_extendedprice), GreaterThanOrEqual(l_extendedprice,1000.0)" in p
    # lineitem scan reads only the columns the adapter needs
    assert "l_comment" not in p and "l_tax" not in p


def test_layer_read_prunes_partitions(spark):
    p = QUERIES["read_layer"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in p and "snapshot_month" in p
