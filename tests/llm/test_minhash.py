"""Components against brute force over all pairs of shingle sets."""
import random

import numpy as np
import pytest

from renewcast.llm import minhash


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(rows, k, similarity):
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = {}

    def top(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and similarity[1] * len(a & b) >= similarity[0] * len(a | b):
                x, y = top(i), top(j)
                if x != y:
                    parent[max(x, y)] = min(x, y)
    return sorted((i, len(s), top(i), top(i) == i) for i, s in sets)


def corpus(seed, n=150):
    rng = random.Random(seed)
    prose = lambda m: [f"w{rng.randrange(3000)}" for _ in range(m)]
    bases = [prose(rng.choice([8, 20, 60, 150])) for _ in range(12)]
    rows = []
    for i in range(n):
        if rng.random() < 0.2:
            words = prose(rng.randrange(1, 80))
        else:                                    # edits of every strength, so that many pairs lie near the threshold
            words = list(rng.choice(bases))
            for _ in range(rng.randrange(0, max(1, len(words) // 8) + 1)):
                words[rng.randrange(len(words))] = f"w{rng.randrange(3000)}"
        rows.append((i * 7 % n, " ".join(words).upper() if rng.random() < 0.1 else " ".join(words)))
    return rows


def got(docs, **kw):
    return sorted(tuple(r) for r in minhash.near_duplicates(docs, **kw).collect())


@pytest.mark.parametrize("shingle,similarity", [(3, (85, 100)), (5, (80, 100))])
def test_same_components_as_all_pairs(make_docs, shingle, similarity):
    rows = corpus(shingle)
    assert got(make_docs(rows, "id n regs key label"), shingle=shingle, similarity=similarity) == brute(rows, shingle, similarity)


def test_one_large_group_in_many_blocks(make_docs, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 500)
    rng = random.Random(1)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(rng.randrange(0, 12)):
            words[rng.randrange(120)] = f"e{rng.randrange(9999)}"
        rows.append((i, " ".join(words)))
    assert got(make_docs(rows), shingle=3, similarity=(85, 100)) == brute(rows, 3, (85, 100))


def test_defined_cases(make_docs):
    rows = [(5, "a b c d"), (3, "a b c d"), (5, "a b c d"), (7, None), (8, ""), (9, " \t\n"), (10, "one two"), (11, "ONE  two"), (None, "a b c d")]
    out = minhash.near_duplicates(make_docs(rows), shingle=3, similarity=(85, 100)).collect()
    key = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"], r["kept"]) for r in out)
    assert key == sorted([("5", 2, 3, False), ("3", 2, 3, True), ("5", 2, 3, False), ("7", 0, 7, True), ("8", 0, 8, True), ("9", 0, 9, True),
                          ("10", 1, 10, True), ("11", 1, 10, False), ("None", 2, None, True)])
    assert got(make_docs([])) == []
    assert got(make_docs([(1, None), (2, "")])) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_rows_of_one_id_are_judged_by_their_own_texts(make_docs):
    """Ids shared by unrelated texts, by near copies and by repeated rows, against all pairs of rows."""
    rows = corpus(9, 90)
    rows = [(i // 3 if i % 2 else i, t) for i, t in rows] + [(1, "quite another text stands here now"), (1, "and a third one that is like none"), (1, "")] \
        + [rows[4], rows[4], rows[7]]
    sets = [(i, shingles(t, 3)) for i, t in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                parent[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[top(k)] = min(i, least.get(top(k), i))
    want = sorted((i, len(x), least[top(k)], i == least[top(k)]) for k, (i, x) in enumerate(sets))
    assert got(make_docs(rows), shingle=3, similarity=(85, 100)) == want
    left = minhash.drop_near_duplicates(make_docs(rows, "_row _id"), shingle=3, similarity=(85, 100)).collect()
    kept = [(r["doc_id"], r["text"]) for r in left]
    groups = {top(k) for k, (_, x) in enumerate(sets) if x}
    empty = [(i, t) for i, t in rows if not shingles(t, 3)]
    assert len(kept) == len(groups) + len(empty)
    by_text = {}
    for k, (i, t) in enumerate(rows):
        by_text.setdefault((i, t), set()).add(top(k))
    found = [next(iter(by_text[x])) for x in kept if shingles(x[1], 3)]
    assert sorted(found) == sorted(groups) and all(i == least[g] for (i, _), g in zip([x for x in kept if shingles(x[1], 3)], found))


def test_estimate_is_near_the_truth():
    rng = np.random.default_rng(5)
    for share in (0.3, 0.6, 0.85):
        both = rng.integers(0, 2 ** 63, size=2000, dtype=np.uint64)
        cut = int(2000 * (1 - share) / 2)
        a, b = both[cut:], both[:2000 - cut]
        true = (2000 - 2 * cut) / 2000
        ra, rb = minhash.registers(a, 4096), minhash.registers(b, 4096)
        assert abs(minhash.estimate(ra, rb, len(a), len(b)) - true) < 0.04


def test_stage_keeps_one_row_of_each_group(make_docs):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, "other words stand here now then"), (None, "x y"), (None, "x y")]
    left = minhash.drop_near_duplicates(make_docs(rows, "kept _gone"))
    assert sorted(str(r["doc_id"]) for r in left.collect()) == ["1", "3", "None", "None"]
    assert left.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
