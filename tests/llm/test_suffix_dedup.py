"""Byte removal against brute force, and the transform against plain substrings."""
import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from renewcast.llm import suffix_dedup
from renewcast.llm.bwt import long_repeats


def brute(rows, least):
    """(id, text) in order -> removed flags per row; ids may repeat (rows then come sorted as the operator counts copies)."""
    seen, out = set(), []
    for _, text in rows:
        b = (text or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - least + 1):
            w = b[p:p + least]
            if w in seen:
                gone[p:p + least] = [True] * least
            seen.add(w)
        out.append((b, gone))
    return out


def digest(b, gone):
    runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
    return len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()


def result(docs, **kw):
    return sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest())
                  for r in suffix_dedup.remove_repeats(docs, **kw).collect())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=0, max_size=40).map(lambda b: bytes(97 + x % 2 for x in b)), min_size=1, max_size=5), st.integers(1, 9))
def test_transform_finds_exactly_the_repeated_places(strings, least):
    string, offset, group = long_repeats(strings, least)
    got, want = {}, {}
    for s, o, g in zip(string.tolist(), offset.tolist(), group.tolist()):
        got.setdefault(g, set()).add((s, o))
    for i, x in enumerate(strings):
        for p in range(len(x) - least + 1):
            want.setdefault(x[p:p + least], set()).add((i, p))
    assert {frozenset(v) for v in got.values()} == {frozenset(v) for v in want.values() if len(v) > 1}


def sample(seed):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "é", "ö", "x"]
    def prose(n):
        return " ".join(rng.choice(words) + str(rng.randrange(500)) for _ in range(n))
    shared = [prose(30), prose(60), "ab" * 200]
    rows = []
    for i in range(40):
        parts = [prose(rng.randrange(0, 40)) for _ in range(3)]
        parts.insert(rng.randrange(3), rng.choice(shared)[rng.randrange(20):])
        rows.append((i * 3, "\n".join(parts)))
    return rows + [(1, rows[5][1]), (200, None), (201, ""), (202, "short"), (203, rows[0][1] + rows[0][1])]


@pytest.mark.parametrize("least,gram", [(100, 32), (30, 12)])
def test_same_bytes_as_brute_force(make_docs, least, gram):
    rows = sorted(sample(least))
    want = sorted((True, i, *digest(*x)) for (i, _), x in zip(rows, brute(rows, least)))
    assert result(make_docs(rows, "copy doc place hash spans"), least=least, gram=gram) == want


def test_many_different_stretches_of_one_anchor_take_the_grouped_way(make_docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 5)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 1000)
    rows = sorted(sample(7))
    want = sorted((True, i, *digest(*x)) for (i, _), x in zip(rows, brute(rows, 100)))
    assert result(make_docs(rows)) == want


def test_hot_anchors_are_dealt_out_by_their_stretches(spark, make_docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "TRIED", 1)
    monkeypatch.setattr(suffix_dedup, "HOT", 3)
    monkeypatch.setattr(suffix_dedup, "partitions", lambda spark: 10_000)
    rows = sorted(sample(11))
    docs = make_docs(rows).repartition(4)
    d = suffix_dedup.numbered(docs.select("doc_id", "text"), "doc_id", "text").select("doc", "copy", "text")
    hot = frozenset(r["anchor"] for r in suffix_dedup.hot_anchors(d, 100, 32).collect())
    dealt = suffix_dedup.stretches(d, 100, 32, hot).where("NOT sure").select("anchor", "route").distinct().collect()
    routes = {a: sum(r["anchor"] == a for r in dealt) for a in hot}
    assert len(hot) > 5 and max(routes.values()) > 5 and all(r["anchor"] == r["route"] for r in dealt if r["anchor"] not in hot)
    want = sorted((True, i, *digest(*x)) for (i, _), x in zip(rows, brute(rows, 100)))
    assert result(docs) == want


def test_stretches_that_agree_in_32_bits_are_not_taken_for_one(make_docs):
    """150,000 different stretches round one anchor: some agree in 32 bits of their hash, and none of their bytes may go."""
    rng = random.Random(4)
    find = suffix_dedup.Anchors(100, 32)
    letters = "abcdefghijklmnopqrstuvwxyz"
    tries = "".join(rng.choices(letters, k=200_000))
    h = np.concatenate([x[0] for x in suffix_dedup.Anchors(32, 32).of(tries.encode())]).view(np.uint64)
    anchor = tries[int(h.argmin()):][:32]
    seen, pairs = {}, []
    for n in range(150_000):
        text = "".join(rng.choices(letters, k=34)) + anchor + "".join(rng.choices(letters, k=34))
        (h, s1, _, start, length), = find.of(text.encode())
        assert len(h) == 1 and (start[0], length[0]) == (0, 100)
        key = int(h[0]), int(s1[0]) & 0xFFFFFFFF
        if key in seen:
            pairs.append((seen[key], text))
        seen[key] = text
    rows = [(k, t) for k, t in enumerate(t for pair in pairs for t in pair)]
    assert len({h for h, _ in seen}) < 200 and pairs                 # nearly all have that anchor
    assert {r[3] for r in result(make_docs(rows))} == {0}


def test_rows_that_share_an_id_are_copies(make_docs):
    text = "".join(chr(97 + k % 23) + str(k) for k in range(80))
    got = result(make_docs([(4, text), (4, text), (None, text), (9, text + "tail")]))
    n = len(text.encode())
    assert [g[3] for g in got if not g[0]] == [0]                      # the null id comes first and keeps its bytes
    assert sorted(g[3] for g in got if g[1] == 4) == [n, n]
    assert [g[3] for g in got if g[1] == 9] == [n]
    alone = result(make_docs([(4, text), (4, text)]))
    assert sorted(g[3] for g in alone) == [0, n]


def test_many_rows_of_one_id_keep_one_of_each_text(make_docs):
    texts = ["".join(chr(97 + (k * m) % 23) + str(k * m) for k in range(60)) for m in range(2, 9)]
    rows = [(None, t) for t in texts * 30] + [(5, texts[0])] * 40 + [(6, "other " * 3)]
    got = result(make_docs(rows, "doc copy _at _h _b _row"))
    assert len(got) == len(rows)
    kept = [g for g in got if not g[0] and g[3] == 0]
    assert len(kept) == len(texts) and {g[2] for g in kept} == {len(t.encode()) for t in texts}
    assert all(g[3] == len(texts[0].encode()) for g in got if g[1] == 5)


def test_empty_table_and_whole_characters(make_docs):
    assert result(make_docs([])) == []
    text = "é" * 120
    rows = suffix_dedup.remove_repeats(make_docs([(1, text), (2, "x" + text + "é")]), least=101, gram=32, whole_characters=True, whole_rows=True)
    got = {r["doc_id"]: r for r in rows.collect()}
    assert rows.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert set(got[2]["text"]) <= {"x", "é"} and got[2]["text"].startswith("x")


def test_very_long_text_is_cut_into_chunks(make_docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1 << 12)
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefghij ") for _ in range(20_000))
    rows = [(1, long), (2, long[3000:15_000] + "z" + long[:500])]
    assert result(make_docs(rows)) == sorted((True, i, *digest(*x)) for (i, _), x in zip(rows, brute(rows, 100)))
