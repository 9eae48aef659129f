"""renewcast: subscription-churn analytics as Spark DataFrame operators.

Layers:
  sources    scans, sinks, month spines and the test-table adapters
  functions  Column -> Column scalar helpers
  operators  DataFrame -> DataFrame filters, joins, aggregates, windows,
             profiles, feature preparation, metrics and Spark ML models
  plans      composed pipelines (usage features, feature store, renewal
             labels, model set assembly, scoring, monitoring)
  streaming  incremental (available-now) daily scoring and monitoring
"""

from renewcast.session import get_session, shared_dir  # noqa: F401

__all__ = ["get_session", "shared_dir"]
