"""Filter interaction audit: what each filter would remove after every possible set of filters before it.

1. One pass over the texts decides all filters for every row; only narrow facts are kept.  A rule on
   repeated texts is decided by the smallest id of each text's SHA-256, combined before the shuffle.
2. Each filter's failing rows are stored as a relation of their ids, in buckets by id, so every join below runs bucket by bucket without an
   exchange.
3. For each filter and each set of others before it, left-anti joins of its relation with those of the set leave the rows it
   removes, with their label losses.  A left-semi join at each step of that chain gives the rows that
   another filter takes first, which are the redundant ones.  An order of filters matters only through the set before each step, so the
   sets of all orders, 2 ** (filters - 1) for each filter, hold all that the orders need.
4. Counts per part come from all branches by one partial aggregate; the orders are laid over them.

Defined results: a null text is empty; a null part is the empty string; a null id equals no label and no smaller id and is no
smaller id itself; rows that repeat (ids too) are rows of their own; an id labelled twice counts as marked if any of its labels is 1;
labels null or missing mark nothing; an empty table gives no parts and so no rows; columns beyond id, text and part are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce
from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from renewcast.llm.common import bounded_broadcast, per_text, written
from renewcast.session import written_buckets

#: About the rows of one bucket of a filter's relation (some 30 bytes each), and the fewest buckets.
BUCKET_ROWS, LEAST_BUCKETS = 2_000_000, 8
SIGNS = re.compile(r"[#$%&*|]")
_NOT_UPPER = bytes(c for c in range(256) if not 65 <= c <= 90)

#: A rule takes (text, its UTF-8 bytes, its words) and says whether the text fails.
Rule = Callable[[str, bytes, list[bytes]], bool]
RULES: dict[str, Rule] = {
    "A": lambda text, raw, words: len(words) < 200,
    "B": lambda text, raw, words: 100 * len(set(words)) < 50 * len(words),
    "C": lambda text, raw, words: 100 * len(raw.translate(None, _NOT_UPPER)) > 2 * len(text),
    "D": lambda text, raw, words: SIGNS.search(text) is not None,
}
#: The filter on texts that stand under a smaller id as well.
REPEATED = "E"


def filter_facts(docs: DataFrame, id_col: str, text_col: str, part_col: str, rules: dict[str, Rule]) -> DataFrame:
    """(row, doc, part, digest, one boolean per rule): whole texts, one pass; row numbers are fixed by writing them."""
    import hashlib

    names = sorted(rules)

    def make():
        def judge(text: str) -> tuple:
            raw = text.encode("utf-8", "surrogatepass")
            words = raw.split()                         # bytes.split parts at the six ASCII white-space signs alone
            return (hashlib.sha256(raw).digest(), *[bool(rules[x](text, raw, words)) for x in names])
        return judge

    narrow = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc"),
                         F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).alias("text"))
    fields = "digest binary, " + ", ".join(f"`{x}` boolean" for x in names)
    return written(per_text(narrow, "row", "text", make, fields, carry=("doc", "part")), "filter_facts")


def with_repeats(facts: DataFrame, name: str = REPEATED) -> DataFrame:
    """Adds whether the text stands under a smaller id too."""
    first = facts.groupBy("digest").agg(F.min("doc").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    first = bounded_broadcast(written(first, "repeated_texts"))
    return facts.join(first, "digest", "left").withColumn(name, F.coalesce(F.col("doc") > F.col("_first"), F.lit(False))).drop("_first", "digest")


def failing_relations(facts: DataFrame, labels: DataFrame, id_col: str, marks: dict[str, str], filters: Sequence[str]) -> dict[str, DataFrame]:
    """For each filter the table (row, part, one 0/1 column per mark) of the rows failing it."""
    marked = labels.groupBy(F.col(id_col).alias("doc")).agg(*[F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(m) for m, c in marks.items()])
    fails = reduce(Column.__or__, [F.col(f"`{x}`") for x in filters])
    rows = written(facts.where(fails).join(marked, "doc", "left").select(
        "row", "part", *[F.coalesce(m, F.lit(0)).cast("byte").alias(m) for m in marks], *filters), "failing_rows")
    buckets = max(LEAST_BUCKETS, -(-rows.count() // BUCKET_ROWS))
    return {x: written_buckets(rows.where(F.col(x)).select("row", "part", *marks), f"fails_{x.lower()}", "row", buckets) for x in filters}


def subsets(names: Sequence[str]) -> list[str]:
    """All sets of names, each as its sorted names in one string."""
    return ["".join(c) for k in range(len(names) + 1) for c in combinations(sorted(names), k)]


def filter_cells(name: str, relations: dict[str, DataFrame], marks: Sequence[str]) -> DataFrame:
    """(part, filter, before, removed, redundant, marks lost): counts for one filter after each set of others, where not all are 0."""
    others = sorted(x for x in relations if x != name)
    zero = F.lit(0).cast("byte")
    left: dict[str, DataFrame] = {}
    branches = []
    for before in subsets(others):
        if before:
            *head, last = before
            rest, by = left["".join(head)], relations[last].select("row")
            left[before] = rest.join(by, "row", "left_anti")
            # rows that the last of the set takes away, redundant from here on in every set that begins so
            taken = rest.join(by, "row", "left_semi")
            wider = [x for x in subsets(others) if x.startswith(before)]
            branches.append(taken.select("part", *[zero.alias(m) for m in marks], F.lit(True).alias("taken"), F.array(*map(F.lit, wider)).alias("sets")))
        else:
            left[before] = relations[name]
        branches.append(left[before].select("part", *marks, F.lit(False).alias("taken"), F.array(F.lit(before)).alias("sets")))
    while len(branches) > 1:                            # pairwise, so that the plan stays shallow
        branches = [a.union(b[0]) if b else a for a, *b in (branches[i:i + 2] for i in range(0, len(branches), 2))]
    counted = branches[0].groupBy("part", "taken", "sets").agg(F.count(F.lit(1)).alias("n"), *[F.sum(m).alias(m) for m in marks])
    return counted.select("*", F.explode("sets").alias("before")).groupBy("part", "before").agg(
        F.coalesce(F.sum(F.when(~F.col("taken"), F.col("n"))), F.lit(0)).alias("removed"),
        F.coalesce(F.sum(F.when(F.col("taken"), F.col("n"))), F.lit(0)).alias("redundant"),
        *[F.sum(m).alias(m) for m in marks]).withColumn("filter", F.lit(name))


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source",
                  marks: dict[str, str] | None = None, rules: dict[str, Rule] | None = None) -> DataFrame:
    """One row per part, order of all filters and step: kept, removed, redundant, unique_fails, one count of lost rows per mark, shapley.

    ``marks`` names the label columns whose rows (value 1) are counted when removed: name of the result column -> column of ``labels``.
    """
    marks = marks if marks is not None else {"good_lost": "quality", "toxic_lost": "toxic"}
    rules = rules if rules is not None else RULES
    filters = sorted([*rules, REPEATED])
    facts = filter_facts(docs, id_col, text_col, part_col, rules)
    relations = failing_relations(with_repeats(facts), labels, id_col, marks, filters)
    cells = [written(filter_cells(x, relations, list(marks)), f"cells_{x.lower()}") for x in filters]
    cells = reduce(DataFrame.unionByName, cells)

    orders = ",".join("".join(o) for o in permutations(filters))
    steps = facts.groupBy("part").agg(F.count(F.lit(1)).alias("total")).select(
        "part", "total", F.explode(F.split(F.lit(orders), ",")).alias("filter_order")).select(
        "part", "total", "filter_order", F.posexplode(F.split("filter_order", "")).alias("place", "filter"))
    before = F.array_join(F.array_sort(F.split(F.substring("filter_order", F.lit(1), F.col("place")), "")), "")
    laid = steps.withColumn("before", before).join(cells, ["part", "filter", "before"], "left") \
        .fillna(0, ["removed", "redundant", *marks])
    along = Window.partitionBy("part", "filter_order").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    alike = Window.partitionBy("part", "filter")
    return laid.select(
        "part", "filter_order", (F.col("place") + 1).cast("int").alias("step"),
        (F.col("total") - F.sum("removed").over(along)).alias("kept"), "removed", "redundant",
        F.max(F.when(F.col("place") == len(filters) - 1, F.col("removed"))).over(alike).alias("unique_fails"), *marks,
        F.sum("removed").over(alike).alias("shapley"))
