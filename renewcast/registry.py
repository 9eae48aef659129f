"""Query registry behind ``__spark_entry__``: name -> (Spark callable, DuckDB SQL or None).

Each callable takes (spark, sf_dir) and returns a DataFrame built from the
fixture adapters.  Doubles are rounded to 6 decimals in the output (both here
and in the SQL) so float summation order cannot change a value hash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}
HEADLINE: list[str] = []


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    cols = []
    for name, typ in df.dtypes:
        if typ in ("double", "float"):
            cols.append(F.round(F.col(name).cast("double"), digits).alias(name))
        else:
            cols.append(F.col(name))
    return df.select(*cols)


def query(name: str, sql: str | None = None, headline: bool = False, rounded: bool = True):
    """Register a query; ``sql=None`` means rows-only check (no SQL form)."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return round_doubles(df) if rounded else df

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        if headline:
            HEADLINE.append(name)
        return fn

    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    import importlib

    for mod in ("labels", "features", "scalars", "eda", "evaluation", "prep", "modelling", "fitted", "sources"):
        try:
            importlib.import_module(f"renewcast.catalog.{mod}")
        except ModuleNotFoundError as e:
            if e.name != f"renewcast.catalog.{mod}":
                raise
