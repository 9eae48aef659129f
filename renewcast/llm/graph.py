"""Connected components of an edge table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from renewcast.llm.common import written

ROUNDS = 100


def components(edges: DataFrame) -> DataFrame:
    """(id, label) for every id of ``edges`` (a, b): label is the smallest id that can be reached.

    Each round takes the smallest label among a node's neighbours (combined before the shuffle, so a centre
    of many edges is one row per task) and then jumps to that label's own label, which halves
    long chains.  Labels are written each round; the loop ends when no label changes.
    """
    both = edges.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(
        edges.select(F.col("b").alias("id"), F.col("a").alias("other"))).distinct()
    both = written(both, "edges")
    labels = written(both.groupBy("id").agg(F.least(F.col("id"), F.min("other")).alias("label")), "labels")
    for _ in range(ROUNDS):
        seen = labels.withColumnsRenamed({"id": "other", "label": "theirs"})
        least = both.join(seen, "other").groupBy("id").agg(F.min("theirs").alias("theirs"))
        near = labels.join(least, "id").select("id", F.col("label").alias("was"), F.least("label", "theirs").alias("now"))
        up = labels.select(F.col("id").alias("now"), F.col("label").alias("top"))
        after = written(near.join(up, "now").select("id", "was", F.col("top").alias("label")), "labels")
        labels = after.select("id", "label")
        if after.where("was <> label").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
