"""Fill-in-the-middle: wavelet matrix against plain counting, cuts against the token pattern, exact restoration."""
import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from renewcast.llm import fim, queries

TOKEN = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)
MIXED = st.text(st.sampled_from(list("aZq09 \t\n<>PSM-é中𝒳")), max_size=80)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 7), max_size=300))
def test_rank_is_a_count(symbols):
    x = np.array(symbols, dtype=np.uint8)
    m = fim.WaveletMatrix(x)
    for i in {0, len(x) // 3, len(x) // 2, len(x)}:
        for c in range(8):
            assert m.rank(c, i) == int((x[:i] == c).sum())
            assert m.rank(c, i, levels=2) == int((x[:i] >> 1 == c >> 1).sum())


@settings(max_examples=150, deadline=None)
@given(MIXED)
def test_boundaries_are_those_of_the_pattern(text):
    tokens = TOKEN.findall(text)
    b = fim.Boundaries(text)
    assert b.n == len(tokens)
    at = 0
    for k in range(len(tokens) + 1):
        assert b.after_tokens(k) == at == b.after_tokens(k, max(0, at - 1))
        at += len(tokens[k]) if k < len(tokens) else 0


def test_runs_over_chunk_edges(monkeypatch):
    text = "ab1 Cd" * 50 + "x" * 500 + "é" + "y" * 40
    whole = fim.character_classes(text)
    for size in (1, 3, 7, 64):
        monkeypatch.setattr(fim, "CHUNK", size)
        assert (fim.character_classes(text) == whole).all()


def plain_rule(doc_id, text):
    text = text or ""
    key = "null" if doc_id is None else str(doc_id)
    x = hashlib.sha256(f"1:{key}".encode()).hexdigest()
    h = [int(x[8 * k:8 * k + 8], 16) for k in range(4)]
    t = TOKEN.findall(text)
    if not text or any(m in text for m in fim.MARKERS) or h[2] % 100 >= 90:
        return doc_id, len(t), "plain", None, None, text
    a, b = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
    p, m, s = "".join(t[:a]), "".join(t[a:b]), "".join(t[b:])
    if h[3] % 100 < 20:
        return doc_id, len(t), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(t), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_forms_cuts_and_round_trip(spark, make_docs):
    texts = [None, "", "a", " ", "<P>", "x<M>y", "<", "<P", "S><S", "one two three", "é" * 5, "A1b2" * 700, "\r\n" * 9, "word " * 40_000, "𝒳y" * 50]
    rows = [(i, texts[i % len(texts)]) for i in range(300)] + [(None, "no id here"), (None, None), (7, "again"), (7, "again"), (-7, "minus")]
    docs = make_docs(rows, "n form output _hash _text")
    got = fim.fill_in_middle(docs)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    found = got.select("*", fim.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert sorted(map(repr, (tuple(r)[:6] for r in found))) == sorted(map(repr, (plain_rule(*r) for r in rows)))
    assert sorted(r["back"] for r in found) == sorted(t or "" for _, t in rows)
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}


def test_empty_table(spark, make_docs):
    assert fim.fill_in_middle(make_docs([])).collect() == []


def test_markers_that_could_arise_are_refused(spark, make_docs):
    for bad in (("aa", "ab", "ac"), ("<P>", "<S>", "<MM>"), ("<P>", "<P>", "<M>")):
        with pytest.raises(ValueError):
            fim.fill_in_middle(make_docs([(1, "x")]), markers=bad)


def test_other_shares(spark, make_docs):
    docs = make_docs([(i, "some words to cut") for i in range(200)])
    forms = lambda **k: {r["form"] for r in fim.fill_in_middle(docs, **k).collect()}
    assert forms(plain_percent=100) == {"plain"} and forms(plain_percent=0, spm_percent=100) == {"spm"}


def test_query_columns(spark):
    got = queries.QUERIES["op13_fill_in_middle"](spark, "/root/testdata/sf0.001")
    assert got.where("output_sha256 IS NULL OR restored_sha256 IS NULL").isEmpty()
