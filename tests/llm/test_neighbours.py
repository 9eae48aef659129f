"""Nearest-neighbour voting: plain counting, an exact space, all cosines one by one, held-out labels, defined cases."""
import zlib
from collections import Counter

import numpy as np
import pytest

from renewcast.llm import neighbours, queries
from renewcast.llm.common import table

SF = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int"
JUNK = "FREE!! NOW!! BUY!! " * 12
GOOD = "the quiet river runs below an old stone bridge and the small town sleeps"


def plain_terms(text):
    """Counts by cell, counted word by word."""
    words = [w for w in "".join(chr(c) if c in b" \t\n\r\x0b\x0c" else f"{c:03d}" for c in text.encode()).split()]
    words = [bytes(int(w[i:i + 3]) for i in range(0, len(w), 3)) for w in words]
    n = Counter()
    before = None
    for w in words:
        low = bytes(c + 32 if 65 <= c <= 90 else c for c in w)
        shape = bytearray()
        for c in w:
            s = ord("A") if 65 <= c <= 90 else ord("0") if 48 <= c <= 57 else ord("a") if 97 <= c <= 122 or c >= 128 else c
            if not (shape and shape[-1] == s and s in b"aA0"):
                shape.append(s)
        n[zlib.crc32(low) % neighbours.WORDS] += 1
        n[neighbours.WORDS + zlib.crc32(bytes(shape)) % neighbours.SHAPES] += 1
        n[neighbours.TERMS - 1] += before == low
        before = low
    return {k: v for k, v in n.items() if v}


def test_terms_match_plain_counting():
    for text in ("", " \n", "Ab ab AB é9 é9 99x!!", "a\x1cb  c", "x " * 50, GOOD, JUNK, "#|# 1,000.5 -- Über"):
        cells, counts = neighbours.term_counts(text)
        assert dict(zip(cells.tolist(), counts.tolist())) == plain_terms(text)
        assert (np.diff(cells) > 0).all()


def test_space_holds_the_leading_directions():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 8)) * np.array([9, 7, 5, 3, .1, .1, .1, .1]) @ rng.normal(size=(8, 40))
    v = neighbours.latent_space(x, 4)
    _, s, exact = np.linalg.svd(x)
    assert np.allclose(np.linalg.svd(exact[:4] @ v)[1], 1, atol=1e-3)


def brute_score(space, vector, k):
    """One document against every labelled vector, in plain Python."""
    near = [(round(float(np.float32(vector) @ v) * 1e5) / 1e5, -i) for i, v in enumerate(space.vectors)]
    best = sorted(near, reverse=True)[:k]
    good = sum(max(c, 0) ** neighbours.POWER for c, i in best if space.labels[-i] == 1) / space.share
    bad = sum(max(c, 0) ** neighbours.POWER for c, i in best if space.labels[-i] == 0) / (1 - space.share)
    return good / (good + bad) if good + bad else space.share


def test_query_against_all_cosines_and_held_out_labels(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    space = neighbours.learn_space(docs, labels)
    got = {r["doc_id"]: r for r in queries.QUERIES["op11_quality_classifier"](spark, SF).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(got) == set(texts)
    for i in sorted(texts)[::17]:
        want = brute_score(space, space.project([texts[i] or ""])[0], neighbours.NEIGHBOURS)
        assert got[i]["score"] == pytest.approx(want, abs=2e-3)
    truth = [(r["quality"], got[r["doc_id"]]) for r in labels.collect() if r["doc_id"] in got]
    held = [(q, r) for q, r in truth if r["held_out"]]
    assert len(held) > 40 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got.values())
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got.values())
    assert sum(r["predicted"] == q for q, r in held) >= 0.97 * len(held)
    good = [r["score"] for q, r in held if q == 1]
    junk = [r["score"] for q, r in held if q == 0]
    assert np.mean([a > b for a in good for b in junk]) > 0.99


def test_labels_of_held_out_ids_change_nothing(spark, make_docs):
    docs = make_docs([(i, GOOD if i % 2 else JUNK) for i in range(1, 60)])
    held = [i for i in range(1, 60) if zlib.crc32(str(i).encode()) % 5 == 0]
    base = [(i, i % 2, 0) for i in range(1, 60) if i not in held]
    a = neighbours.learn_space(docs, spark.createDataFrame(base, LABELS))
    b = neighbours.learn_space(docs, spark.createDataFrame(base + [(i, 1 - i % 2, 0) for i in held], LABELS))
    assert np.array_equal(a.vectors, b.vectors) and np.array_equal(a.labels, b.labels)


def test_defined_cases(spark, make_docs):
    rows = [(i, f"{GOOD} {i}" if i % 2 else f"{JUNK}{i}") for i in range(1, 80)]
    odd = [(100, None), (101, ""), (102, " \n"), (None, JUNK), (None, None), (103, GOOD), (103, GOOD), (104, JUNK * 4000), (105, "☃")]
    docs = make_docs(rows + odd, "score predicted held_out _text _id _y quality cells")
    marks = [(i, i % 2, 0) for i in range(1, 80)] + [(1, 1, 0), (None, 0, 0), (3, None, 0), (999, 0, 0)]
    space = neighbours.learn_space(docs, spark.createDataFrame(marks, LABELS))
    got = neighbours.score_quality(docs, space).collect()
    assert len(got) == len(rows + odd) and [f for f in got[0].asDict()] == ["doc_id", "held_out", "score", "predicted"]
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert all(r["score"] == pytest.approx(space.share, abs=1e-6) for i in (100, 101, 102) for r in by[i])
    assert by[103][0] == by[103][1] and by[103][0]["score"] > 0.9 and by[104][0]["score"] < 0.1
    assert [r["held_out"] for r in by[None]] == [False, False]


def test_without_labels_and_with_one_class(spark, make_docs):
    docs = make_docs([(i, GOOD) for i in range(1, 9)] + [(9, None)])
    none = neighbours.learn_space(docs, spark.createDataFrame([], LABELS))
    assert {r["score"] for r in neighbours.score_quality(docs, none).collect()} == {0.5}
    one = neighbours.learn_space(docs, spark.createDataFrame([(i, 0, 0) for i in range(1, 9)], LABELS))
    assert {r["score"] for r in neighbours.score_quality(docs, one).collect()} == {0.0}
    empty = make_docs([])
    assert neighbours.score_quality(empty, neighbours.learn_space(empty, spark.createDataFrame([], LABELS))).collect() == []


def test_sample_is_bounded_and_copies_are_one_neighbour(spark, make_docs):
    docs = make_docs([(i, GOOD) for i in range(200)] + [(200 + i, f"{JUNK}{i}") for i in range(100)])
    marks = [(i, int(i < 200), 0) for i in range(300)]
    space = neighbours.learn_space(docs, spark.createDataFrame(marks, LABELS), sample=20)
    assert len(space.labels) == 11 and space.labels.sum() == 1
