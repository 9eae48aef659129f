"""Helpers the operators share: tables, ASCII lower case, written intermediates, row keys."""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from renewcast.session import written  # noqa: F401  (operators take it from here)

#: Rows up to which a table that has been counted may be broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 200_000
#: The same for the bytes of rows that hold texts or lists.
BROADCAST_BYTES = 32_000_000


#: Rows of one Arrow batch between Spark and Python, at most: whole texts make the default of 10,000 rows heavy on both sides.
BATCH_ROWS = 2_000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS rows, where they are larger; no result depends on it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(spark.conf.get(key, "10000"))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone (``lower`` would also fold other letters); texts of ASCII bytes take the fast way."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(
        F.translate(c, string.ascii_uppercase, string.ascii_lowercase))


def bounded_broadcast(df: DataFrame, size: Column | None = None) -> DataFrame:
    """Marks a written table for broadcast only if its rows, counted here, are within BROADCAST_ROWS and, for rows without a fixed
    size, their bytes (the sum of ``size``) within BROADCAST_BYTES; otherwise the table is left to a shuffled join."""
    n = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.lit(0) if size is None else size), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if n["rows"] <= BROADCAST_ROWS and n["bytes"] <= BROADCAST_BYTES else df


def key_of(c: Column) -> Column:
    """A join key that is never null: null ids get a text no number has."""
    return F.coalesce(c.cast("string"), F.lit("null"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def per_text(df: DataFrame, id_col: str, text_col: str, make: Callable[[], Callable[[str], tuple]], fields: str,
             carry: Sequence[str] = ()) -> DataFrame:
    """One row per input row: the id and what a Python function says of its whole text (null: empty).

    ``make`` builds the function once per task (automata, tokenizers); texts are taken from the Arrow
    batch one at a time, so a task holds one batch and one text's intermediates.  ``fields``: the
    schema of the tuple.  ``carry``: further columns to hand through.  All keep their names and types.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    kinds = _parse_datatype_string(fields)
    own = [id_col, *carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        types = [to_arrow_type(f.dataType) for f in kinds.fields]
        for b in batches:
            texts = b.column(0)
            rows = [fn(texts[i].as_py() or "") for i in range(b.num_rows)]
            columns = zip(*rows) if rows else [[] for _ in types]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *[pa.array(c, type=t) for c, t in zip(columns, types, strict=True)]],
                                             names=[*own, *[f.name for f in kinds.fields]])

    schema = StructType([*[StructField(c, df.schema[c].dataType) for c in own], *kinds.fields])
    return df.select(F.col(text_col).alias("_text"), *[F.col(f"`{c}`") for c in own]).mapInArrow(run, schema)
