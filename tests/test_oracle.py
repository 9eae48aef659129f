"""Every registered query with SQL against DuckDB on the smallest tables (the driver runs sf0.01)."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E
from sf_paths import SF_SMALL
from renewcast import registry

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
registry.load_all()
SQL, QUERIES = registry.ORACLES, registry.QUERIES
#: No all-pairs join and no Python in any plan that has SQL.
BAD = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas")


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return repr(v)
    if type(v).__name__ == "date":
        return v.isoformat()
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_every_query_has_sql_or_is_rows_only():
    rows_only = set(QUERIES) - set(SQL)
    # the SQL-free ones are model fits / tuning and the approximate profile
    assert rows_only <= {"train_logistic", "train_forest", "tune_model", "cv_report", "score_batch",
                         "save_load_bundle", "evaluate_model", "daily_monitor__model",
                         "describe_profile__approx", "tune_model__forest"}
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_duckdb(spark, duck, name):
    sdf = QUERIES[name](spark, SF_SMALL)
    plan = sdf._jdf.queryExecution().executedPlan().toString()
    assert not [b for b in BAD if b in plan]
    rows = sdf.collect()
    res = duck.execute(SQL[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    order = sorted(sdf.columns)
    si = [sdf.columns.index(c) for c in order]
    di = [dcols.index(c) for c in order]
    got = Counter(tuple(_norm(r[i]) for i in si) for r in rows)
    want = Counter(tuple(_norm(r[i]) for i in di) for r in drows)
    assert got == want, f"{name}: spark-only {list((got - want).elements())[:2]} duck-only {list((want - got).elements())[:2]}"


#: The others have a twin with SQL that runs the same code.
@pytest.mark.parametrize("name", ["describe_profile__approx", "tune_model"])
def test_query_without_sql_runs(spark, name):
    rows = QUERIES[name](spark, SF_SMALL).collect()
    assert rows and not any(math.isnan(v) for r in rows for v in r if isinstance(v, float))


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["snapshot_month", "n_periods", "n_churn"]


def test_entry_holds_the_core_queries():
    assert set(QUERIES) <= set(E.queries()) and set(SQL) <= set(E.oracle_sql())
