"""Quality rules, license scan and toxicity against plain re-implementations and held-out labels."""
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from renewcast.llm import licenses, quality, toxicity
from renewcast.llm.common import table

SF = "/root/testdata/sf0.01"
ODD = [None, "", " \n\t", "a", "a b c a b c a b c", "x\nx\n\nx\n \n \n", "#*$ %& |<> é", "word " * 3000, "naïve space kept one\x0bword"]


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        dup += bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in lines
        lines.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_rule_counts_match_plain_counting():
    texts = ODD + [t for t, in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet' LIMIT 300").fetchall()]
    for t in texts:
        assert quality.rule_counts(t or "") == plain_counts(t), (t or "")[:80]


def test_decoding_is_the_best_of_all_label_sequences():
    rng = np.random.default_rng(2)
    from itertools import product
    for _ in range(40):
        masks = rng.integers(0, 2 ** len(quality.FEATURES), size=rng.integers(1, 7)).tolist()
        w, moves = rng.normal(size=len(quality.FEATURES)), rng.normal(size=(2, 2))
        score = [sum(w[k] for k in range(len(w)) if m >> k & 1) for m in masks]

        def value(path):
            return sum(s for s, y in zip(score, path) if y) + sum(moves[int(a), int(b)] for a, b in zip(path, path[1:]))

        best = max(product((False, True), repeat=len(masks)), key=value)
        assert value(quality.content_lines(masks, w, moves)) == pytest.approx(value(best))


def test_quality_keeps_clean_documents_and_drops_junk(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = {r["doc_id"]: r for r in quality.judge_quality(docs, quality.fit_lines(docs, labels)).collect()}
    assert len(rows) == docs.count()
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    good = [rows[i]["kept"] for i, q in truth.items() if q == 1 and i in rows and not rows[i]["base_failed"]]
    junk = [rows[i]["kept"] for i, q in truth.items() if q == 0 and i in rows and not rows[i]["base_failed"]]
    assert sum(good) >= 0.99 * len(good) and sum(junk) <= 0.1 * len(junk)


def test_quality_defined_cases(spark, make_docs):
    docs = make_docs(list(enumerate(ODD)) + [(None, "a b"), (3, "a b"), (3, "a b")], "kept n_words masks")
    empty = spark.createDataFrame([], "doc_id long, quality int")
    out = quality.judge_quality(docs, quality.fit_lines(docs, empty)).collect()
    assert len(out) == len(ODD) + 3
    by = {r["doc_id"]: r for r in out if r["doc_id"] is not None and r["doc_id"] != 3}
    for i, t in enumerate(ODD):
        if i != 3:
            assert tuple(by[i][1:6]) == plain_counts(t)
    assert by[0]["base_failed"] and not by[0]["kept"] and by[7]["base_failed"]
    assert quality.judge_quality(make_docs([]), quality.fit_lines(docs, empty)).count() == 0


def plain_scan(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at, labels = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split(" ")
        found = [i for i in range(len(words)) if words[i:i + len(p)] == p]
        at += found
        labels |= {label} if found else set()
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_license_places_match_plain_search(spark, make_docs):
    odd = ODD + ["MIT License mit license", "cc by cc by-nc", "(gnu) General-Public_License!", "xmit license", "Émit license mit licensé cc\nby"]
    rows = list(enumerate(odd)) + [(1000 + i, t) for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(make_docs(rows, "labels score")).collect()}
    for i, t in rows:
        assert tuple(got[i][1:6]) == plain_scan(t), t
        assert 0 <= got[i]["score"] <= 1 and set(filter(None, got[i]["base_labels"].split(","))) <= set(got[i]["labels"].split(","))


@pytest.mark.parametrize("text,labels,score", [
    ("mit", {"mit"}, 1.0), ("mit or gpl-3.0", {"mit", "gpl-3.0"}, 1.0), ("mit and gpl-3.0", {"mit", "gpl-3.0"}, 0.3),
    ("gpl-2.0+ with classpath-exception-2.0", {"gpl-2.0", "with-classpath-exception-2.0"}, 0.65),
    ("mit or gpl-3.0 and agpl-3.0", {"mit", "gpl-3.0", "agpl-3.0"}, 1.0), ("(mit or gpl-3.0) and agpl-3.0", {"mit", "gpl-3.0", "agpl-3.0"}, 0.2),
    ("mit or", {"mit"}, 1.0), ("(mit", {"mit"}, 1.0), ("or mit", None, None), ("", None, None),
    ("see the notes", set(), 0.0), ("mit or seen", {"mit"}, 1.0), ("mit and seen", {"mit"}, 0.0), ("licenseref-own", {"licenseref-own"}, 0.5),
    ("seen with classpath-exception-2.0", {"with-classpath-exception-2.0"}, 0.0), ("tbd or mit (", {"mit"}, 1.0), ("see (mit", set(), 0.0),
])
def test_expressions(text, labels, score):
    value = licenses.evaluate(text)
    assert value is None if labels is None else (value[0] == labels and value[1] == pytest.approx(score))


def test_unknown_words_are_no_labels(make_docs):
    rows = [(1, "License-Expression: see the notes"), (2, "License-Expression: MIT OR house-rules"), (None, "SPDX-License-Identifier: house-rules"),
            (3, "MIT License\nLicense-Expression: none of these"), (3, "MIT License\nLicense-Expression: none of these")]
    got = sorted((str(r["doc_id"]), r["labels"], r["score"], r["unknown"]) for r in licenses.scan_licenses(make_docs(rows, "unknown")).collect())
    assert got == [("1", "", 0.0, "see"), ("2", "mit", 1.0, "house-rules"), ("3", "mit", 1.0, "none"), ("3", "mit", 1.0, "none"),
                   ("None", "", 0.0, "house-rules")]
    own = licenses.scan_licenses(make_docs(rows), identifiers=["House-Rules"]).where("doc_id IS NULL").first()
    assert own["labels"] == "house-rules" and own["unknown"] == "" and own["score"] == 0.5


def test_long_labelled_documents_teach_the_field(spark, make_docs):
    """Menus of thousands of lines are the only junk; the field must still learn to tell them."""
    menu = "\n".join(f"link {k} |" for k in range(3000))
    prose = "\n".join("A quiet river runs below the old stone bridge, and the town sleeps on." for _ in range(30))
    docs = make_docs([(i, menu if i % 2 else prose) for i in range(40)])
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    field = quality.fit_lines(docs, labels)
    assert np.array_equal(field[0], quality.fit_lines(docs.repartition(7), labels)[0])
    by = {r["doc_id"]: r["content_share"] for r in quality.judge_quality(docs, field).collect()}
    assert all(by[i] < 0.2 if i % 2 else by[i] > 0.8 for i in range(40))
    twice = docs.unionByName(make_docs([(2, menu)] * 50))
    assert np.array_equal(quality.fit_lines(twice, labels)[0], quality.fit_lines(twice.coalesce(1), labels)[0])


def test_pieces_are_spread_over_the_whole_text():
    lines = list(range(2000))
    parts = quality.spread_pieces(lines, 200, 4)
    assert [p[0] for p in parts] == [0, 600, 1200, 1800] and all(len(p) == 200 for p in parts)
    assert quality.spread_pieces(lines[:450], 200, 4) == [lines[:200], lines[200:400], lines[400:450]]
    assert quality.spread_pieces([], 200, 4) == [] and quality.spread_pieces(lines, 200, 1) == [lines[:200]]


def test_identifier_tags(make_docs):
    got = licenses.scan_licenses(make_docs([(1, "code\n// SPDX-License-Identifier: Apache-2.0 OR MIT\nmore"), (2, "SPDX-License-Identifier:")])).collect()
    by = {r["doc_id"]: r for r in got}
    assert by[1]["labels"] == "apache-2.0,mit" and by[1]["score"] == 1.0 and by[1]["base_labels"] == ""
    assert by[2]["labels"] == "" and by[2]["score"] == 0.0


def auc(rows):
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.fixture(scope="module")
def toxic_model(spark):
    sf = "/root/testdata/sf0.1"
    return toxicity.learn(table(spark, sf, "documents"), table(spark, sf, "labels"))


def test_held_out_accuracy(spark, toxic_model):
    sf = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: r["toxic"] for r in table(spark, sf, "labels").collect()}
    rows = toxicity.score_toxicity(table(spark, sf, "documents"), toxic_model).collect()
    held = [(r["score"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert len(rows) == 10_000 and auc(held) > 0.93
    assert np.mean([s >= 0.5 for s, y in held if not y]) < 0.01 and np.mean([s >= 0.5 for s, y in held if y]) > 0.85


@pytest.mark.parametrize("written", ["idiot", "1d10t", "i d i o t", "i.d.i.o.t", "idioooot", "ID10T!", "w0rthle$$", "$tup1d", "m0r0n", "cl0wn", "d1sgu$ting"])
def test_disguised_words_score_like_plain_ones(toxic_model, written):
    score = toxicity.scorer(toxic_model)
    assert score(f"the and of {written} to in the")[0] >= 0.5
    assert score("the and of to in the")[0] < 0.1


def test_toxicity_defined_cases(spark, make_docs, toxic_model):
    docs = make_docs(list(enumerate(ODD)) + [(None, "you idiot"), (3, "a"), (3, "a")], "score evidence _score toxic")
    rows = toxicity.score_toxicity(docs, toxic_model).collect()
    assert len(rows) == len(ODD) + 3 and all(0 <= r["score"] <= 1 for r in rows)
    assert [r["predicted"] for r in rows if r["doc_id"] is None] == [1] and [r["held_out"] for r in rows if r["doc_id"] is None] == [False]
    import zlib
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows if r["doc_id"] is not None)
    left = toxicity.drop_toxic(docs, toxic_model)
    assert left.columns == docs.columns and left.count() == len(ODD) + 2
    none = toxicity.learn(make_docs([]), spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r["predicted"] for r in toxicity.score_toxicity(make_docs([(1, "idiot")]), none).collect()] == [0]


def test_disguised_words_inside_long_runs(toxic_model):
    score = toxicity.scorer(toxic_model)
    hidden = "the." * 40 + "1d10t" + ".and" * 40
    assert score(hidden)[1] > 0 and score("the." * 200)[1] == 0
    assert score(" ".join("the and of in" * 10) + " " + " ".join("1d10t"))[1] > 0


@pytest.mark.parametrize("written", ["well,idiot", "end.1d10t", "<b>idiot</b>", "total/idiot", "end.$tupid", "x.m0r0n,y", "xx1d10tyy"])
@pytest.mark.parametrize("before", ["", "foo-" * 30, "x" * 80 + "."])
def test_joined_words_score_alike_at_every_length(toxic_model, written, before):
    score = toxicity.scorer(toxic_model)
    assert score(f"the {before}{written} of")[1] > 0
    assert score(f"the {before}sunlose-up,unidiomatic of")[1] == 0


@pytest.mark.parametrize("written", ["iddiot", "stuupid", "sccum", "i" * 100 + "diot", "id iot", "mo ron", "(stu  pid)", "i  d  i  o  t", "1d 10t",
                                     "$c um", "well, i. d. i. o. t."])
def test_doubled_letters_and_spaces_are_decoded(toxic_model, written):
    score = toxicity.scorer(toxic_model)
    assert score(f"the and of {written} to in the")[0] >= 0.5


@pytest.mark.parametrize("written", ["1053 2024-10-53 407", "i do it as is", "said id. iot", "a b c d", "attion too good", "i " * 500])
def test_plain_texts_are_not_decoded_into_words(toxic_model, written):
    assert toxicity.scorer(toxic_model)(written)[1] == 0


def test_words_without_letters_and_of_three_signs():
    features = {"fuk$": 7.0, "goat$": 7.0}
    read = toxicity.reader(features, toxicity.trigram_cost(np.zeros(toxicity.LETTERS ** 3), ["fuk", "goat"]))
    assert read("f u k")[1] == read("well,fuk-you")[1] == read("60@7")[1] == 1 and read("6047")[1] == 0


def test_rare_toxic_words_are_learned_at_every_size(spark):
    """A word of eight toxic texts out of 4,500, and of no other text."""
    import zlib
    learns = [i for i in range(60_000) if zlib.crc32(str(i).encode()) % 5 in (1, 2, 3)]
    toxic, rare = set(learns[:4500]), set(learns[:8])
    rows = [(i, f"some text number {i} {'zorblax' if i in rare else 'grumbo' if i in toxic else 'fine'}") for i in range(60_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.learn(docs, spark.createDataFrame([(i, int(i in toxic)) for i in learns], "doc_id long, toxic int"))
    assert {"zorblax$", "grumbo$"} <= set(model.features) and "fine$" not in model.features
    assert toxicity.scorer(model)("a z0rblax")[1] > 0


def all_readings(token, cost):
    """Every way through the lattice of a token, sign by sign: word -> its least cost."""
    edge, n = toxicity.EDGE_CODE, toxicity.LETTERS
    paths = [("", 0.0)]
    for ch in token:
        after = []
        for word, total in paths:
            before = [edge, edge, *[toxicity.code(c) for c in word]][-2:]
            if ch.isalpha():
                ways = [(ch, 0.0)]
            else:
                ways = [(x, toxicity.SWAP_COST) for x in toxicity.LOOKALIKE.get(ch, "")]
                ways.append(("", toxicity.KEEP_SIGN_COST if ch.isdigit() else toxicity.DROP_COST))
            for letter, pay in ways:
                if not letter:
                    after.append((word, total + pay))
                    continue
                after.append((word + letter, total + pay + float(cost[(before[0] * n + before[1]) * n + toxicity.code(letter)])))
                if word.endswith(letter):
                    after.append((word, total + pay + toxicity.REPEAT_COST))
        paths = after
    found = {}
    for word, total in paths:
        a, b = [edge, edge, *[toxicity.code(c) for c in word]][-2:]
        whole = total + float(cost[(a * n + b) * n + edge])
        found[word] = min(whole, found.get(word, whole))
    return found


def test_decoding_is_the_cheapest_of_all_lattice_paths(toxic_model):
    import random
    rng = random.Random(6)
    chance = -np.log(np.random.default_rng(1).dirichlet(np.ones(toxicity.LETTERS), toxicity.LETTERS ** 2)).ravel()
    signs = "aabdeilost" + "0134578@$!|+.-*"
    for cost in (toxic_model.cost, chance):
        for _ in range(400):
            token = "".join(rng.choices(signs, k=rng.randrange(1, 9)))
            ways = all_readings(token, cost)
            assert ways[toxicity.restore(token, cost)] == pytest.approx(min(ways.values()), abs=1e-9), token


def test_words_spread_over_many_signs(toxic_model):
    """The stated limit: words whose signs stand within PART of each other are found, runs of one sign at any length."""
    read = toxicity.reader(toxic_model.features, toxic_model.cost)
    words = sorted({f[:-1] for f in toxic_model.features if f.endswith("$") and len(f) > 5})[:12]
    assert words
    for gap, least in ((1, 0.9), (4, 0.9), (60, 0.9)):
        hit = sum(read("-" * gap + ("-" * gap).join(w) + " end")[0] > 0 for w in words)
        assert hit >= least * len(words), gap
