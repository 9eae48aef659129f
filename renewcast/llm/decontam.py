"""Benchmark decontamination by winnowing.

A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is
one window as it stands.  A window of n words holds n - k + 1 grams of k = min(``gram``, n)
words; its fingerprint is the smallest of their hashes.  Equal windows have equal
fingerprints, so every shared span of a window's length or more is found.  Three steps:

1. the distinct fingerprints of each document are joined to those of the benchmark;
2. only in the documents found, and only at windows whose fingerprint was found, the
   window's words are written out and joined to the benchmark's windows (this extends a
   hit to the exact span; neighbouring windows add up to the whole shared passage);
3. per document, the hit intervals are merged and the items listed.

Everything is DataFrame functions on arrays; the only wide data that is shuffled is the text of documents
with a fingerprint hit, and not even that where the list of those is small.  Distinct windows carry the list of their
items, so a passage in many items and many documents makes one row per document, not all pairs.
Tables are broadcast only after their rows were counted.

Defined results: each row is judged on its own text, so repeated rows give repeated results; a null or empty
text has no words; null ids are kept; an item with a null id makes hits but is not listed;
an empty benchmark finds nothing; only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from renewcast.llm.common import ascii_lower, bounded_broadcast, key_of, written

WINDOW, GRAM = 10, 7
#: What lies between words: every ASCII character but letters and digits.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def with_fingerprints(df: DataFrame, lengths: list[int], gram: int = GRAM) -> DataFrame:
    """Adds ``_f<n>`` for each n: the fingerprint of every window of n words of ``_words``, in order.
    Hashes of longer grams and minima of wider windows are put together from shorter ones, two at a time."""
    df = df.withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w)))

    def widen(df: DataFrame, col: str, to: int, both) -> DataFrame:
        have = 1
        while have < to:
            step = min(have, to - have)
            df = df.withColumn(col, F.zip_with(col, F.slice(col, step + 1, F.size(col)), both))
            have += step
        return df

    for n in lengths:
        k, col = min(gram, n), f"_f{n}"
        df = widen(df.withColumn(col, F.col("_h")), col, k, lambda a, b: F.xxhash64(a, b))
        df = widen(df, col, n - k + 1, lambda a, b: F.least(a, b))
        df = df.withColumn(col, F.slice(col, 1, F.greatest(F.size("_words") - (n - 1), F.lit(0))))
    return df.drop("_h")


def benchmark_windows(items: DataFrame, item_col: str, text_col: str, window: int, gram: int) -> tuple[DataFrame, list[int]]:
    """(written table of distinct windows: span, mark, items; lengths of windows there are, ``window`` of them at most)."""
    w = items.select(F.col(item_col).cast("string").alias("_item"), words_of(F.col(text_col)).alias("_words")) \
        .withColumn("_n", F.least(F.size("_words"), F.lit(window))).where("_n > 0")
    lengths = sorted(r[0] for r in w.select("_n").distinct().collect())
    rows = with_fingerprints(w, lengths, gram)
    out = None
    for n in lengths:
        each = F.explode(F.transform(f"_f{n}", _span_at(n)))
        part = rows.where(F.col("_n") == n).select("_item", each.alias("x")).select("_item", "x.*")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return items.sparkSession.createDataFrame([], "span string, mark long, items array<string>"), []
    return written(out.groupBy("span").agg(F.first("mark").alias("mark"), F.collect_set("_item").alias("items")), "benchmark_windows"), lengths


def _span_at(n: int):
    return lambda m, i: F.struct(F.concat_ws(" ", F.slice("_words", i + 1, F.lit(n))).alias("span"), m.alias("mark"))


def _hit_at(n: int):
    return lambda m, i: F.when(F.array_contains("_marks", m), F.struct(
        i.cast("long").alias("start"), (i + n).cast("long").alias("end"),
        F.concat_ws(" ", F.slice("_words", i + 1, F.lit(n))).alias("span")))


def covered(spans: Column) -> Column:
    """Length of the union of array<struct<start, end>>."""
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))

    def add(acc: Column, x: Column) -> Column:
        new = F.greatest(F.lit(0).cast("long"), x["end"] - F.greatest(x["start"], acc["end"]))
        return F.struct(F.greatest(acc["end"], x["end"]).alias("end"), (acc["n"] + new).alias("n"))

    return F.aggregate(F.sort_array(spans), start, add)["n"]


def hit_windows(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_id_col: str, item_text_col: str,
                window: int, gram: int) -> DataFrame:
    """Rows (_id, _tx, start, end, items): each place in a document where a benchmark window stands, in words."""
    bench, lengths = benchmark_windows(items, item_id_col, item_text_col, window, gram)
    d = docs.select(key_of(F.col(id_col)).alias("_id"), F.xxhash64(text_col).alias("_tx"), words_of(F.col(text_col)).alias("_words"))
    if not lengths:
        return d.select("_id", "_tx", F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"),
                        F.lit(None).cast("array<string>").alias("items")).where(F.lit(False))
    marked = with_fingerprints(d, lengths, gram)
    prints = F.array_distinct(F.concat(*[F.col(f"_f{n}") for n in lengths]))
    marks = bounded_broadcast(written(bench.select("mark").distinct(), "benchmark_marks"))
    found = marked.select("_id", "_tx", F.explode(prints).alias("mark")).join(marks, "mark")
    found = written(found.groupBy("_id", "_tx").agg(F.collect_set("mark").alias("_marks")), "fingerprint_hits")

    near = with_fingerprints(d.join(bounded_broadcast(found, 8 * F.size("_marks")), ["_id", "_tx"]), lengths, gram)
    places = F.concat(*[F.array_compact(F.transform(f"_f{n}", _hit_at(n))) for n in lengths])
    windows = near.select("_id", "_tx", F.explode(places).alias("x")).select("_id", "_tx", "x.*")
    listed = F.aggregate("items", F.lit(0), lambda n, x: n + F.octet_length(x) + 16)
    return windows.join(bounded_broadcast(bench.select("span", "items"), F.octet_length("span") + listed), "span").select("_id", "_tx", "start", "end", "items")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per document: id, n_words, n_hit, spans (merged later by the reader; start and end in words),
    items (sorted as strings)."""
    hits = hit_windows(docs, items, id_col, text_col, item_id_col, item_text_col, window, gram)
    per_doc = written(hits.groupBy("_id", "_tx").agg(
        F.collect_set(F.struct("start", "end")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")), "document_hits")
    none = F.expr("CAST(array() AS array<struct<start:bigint,end:bigint>>)")
    base = docs.select(F.col(id_col).alias("_out_id"), key_of(F.col(id_col)).alias("_id"), F.xxhash64(text_col).alias("_tx"),
                       F.size(words_of(F.col(text_col))).cast("long").alias("n_words"))
    listed = F.aggregate("items", F.lit(0), lambda n, x: n + F.octet_length(x) + 16)
    out = base.join(bounded_broadcast(per_doc, 16 * F.size("spans") + listed), ["_id", "_tx"], "left")
    return out.select(F.col("_out_id").alias(id_col), "n_words", F.coalesce(covered(F.col("spans")), F.lit(0)).cast("long").alias("n_hit"),
                      F.coalesce(F.sort_array("spans"), none).alias("spans"),
                      F.coalesce("items", F.expr("CAST(array() AS array<string>)")).alias("items"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
                      item_text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The rows without any benchmark window, with the columns they had."""
    hits = hit_windows(docs, items, id_col, text_col, item_id_col, item_text_col, window, gram)
    gone = bounded_broadcast(written(hits.select("_id", "_tx").distinct(), "contaminated"))
    return docs.join(gone, (key_of(docs[id_col]) == gone["_id"]) & (F.xxhash64(docs[text_col]) == gone["_tx"]), "left_anti")
