"""Filter audit: every order against a plain run over rows, defined cases, joins without exchanges."""
import re
from itertools import permutations

from pyspark.sql import functions as F

from renewcast.llm import audit

LABELS = "doc_id long, quality int, toxic int"


def plain_audit(rows, labels):
    """rows: (doc_id, text, source); runs all orders one by one."""
    mark = {}
    for i, q, t in labels:
        if i is not None:
            a, b = mark.get(i, (0, 0))
            mark[i] = (max(a, int(q == 1)), max(b, int(t == 1)))
    items = []
    for n, (i, text, source) in enumerate(rows):
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        smaller = any(j is not None and i is not None and j < i and (t or "") == text for j, t, _ in rows)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
                 "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": smaller}
        items.append((source or "", {x for x, f in fails.items() if f}, *mark.get(i, (0, 0))))
    out = {}
    for part in {p for p, *_ in items}:
        mine = [x for x in items if x[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [r for r in left if x in r[1]]
                left = [r for r in left if x not in r[1]]
                total[x] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(x in r[1] for r in mine) - len(gone), sum(r[1] == {x} for r in mine),
                    sum(r[2] for r in gone), sum(r[3] for r in gone), x]
        for k, v in out.items():
            if k[0] == part:
                out[k] = v[:6] + [total[v[6]]]
    return out


def as_table(df):
    cols = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = df.collect()
    assert len({(r["part"], r["filter_order"], r["step"]) for r in rows}) == len(rows)
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in cols] for r in rows}


LONG = " ".join(f"w{i}" for i in range(250))
CASES = [(1, LONG, "s"), (2, LONG, "s"), (3, LONG, "t"), (None, LONG, "s"), (4, "A B", "s"), (5, None, "s"), (6, "", None), (7, "x " * 300, "t"),
         (7, "x " * 300, "t"), (8, LONG.upper() + " #", "s"), (9, LONG + " |", None), (9, LONG + " |", "s"), (10, "\x1c".join("ab"), "s"),
         (11, LONG + " \u2003\u00a0", "s"), (-12, LONG, "u"), (13, "É" * 10 + "A", "t"), (14, ("é" * 30 + " ") * 7000, "t"), (None, None, None)]
MARKED = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (4, 0, 1), (7, 1, 1), (9, None, 1), (None, 1, 1), (99, 1, 1)]


def docs_of(spark, rows, extra=""):
    df = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for c in extra.split():
        df = df.withColumn(c, F.lit("clash"))
    return df


def test_all_orders_against_a_plain_run(spark):
    docs = docs_of(spark, CASES, "part row doc digest A B removed kept quality toxic").repartition(5)
    assert as_table(audit.audit_filters(docs, spark.createDataFrame(MARKED, LABELS))) == plain_audit(CASES, MARKED)


def test_given_documents_against_a_plain_run(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    marks = [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()]
    assert as_table(audit.audit_filters(docs, labels)) == plain_audit(rows, marks)


def test_no_part_fails_a_filter(spark):
    rows = [(1, LONG, "s")]
    got = as_table(audit.audit_filters(docs_of(spark, rows), spark.createDataFrame([], LABELS)))
    assert got == plain_audit(rows, []) and len(got) == 600


def test_empty_table(spark):
    assert audit.audit_filters(docs_of(spark, []), spark.createDataFrame([], LABELS)).collect() == []


def test_other_rules_and_marks(spark):
    rules = {"A": lambda text, raw, words: len(words) < 2, "B": lambda text, raw, words: b"x" in raw}
    rows = [(1, "a", "s"), (2, "x y", "s"), (3, "x", "s"), (4, "x", "s")]
    got = audit.audit_filters(docs_of(spark, rows), spark.createDataFrame(MARKED, LABELS), marks={"bad_lost": "toxic"}, rules=rules)
    by = {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["bad_lost"], r["shapley"]) for r in got.collect()}
    assert len(by) == 18 and by["ABE", 1] == (1, 3, 0, 1, 1, 11) and by["EAB", 3] == (0, 1, 2, 1, 1, 11)


def test_joins_need_no_exchange(spark):
    conf = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "-1")
    try:
        facts = audit.with_repeats(audit.filter_facts(docs_of(spark, CASES), "doc_id", "text", "source", audit.RULES))
        tables = audit.failing_relations(facts, spark.createDataFrame(MARKED, LABELS), "doc_id", {"good_lost": "quality"}, list("ABCDE"))
        plan = audit.filter_cells("C", tables, ["good_lost"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(conf, before)
    assert plan.count("LeftAnti") > 15 and plan.count("LeftSemi") >= 15
    exchanges = [x for x in plan.split("\n") if "Exchange" in x]
    assert exchanges and all("hashpartitioning(row" not in x for x in exchanges)
