"""URL filter, chat formatting and decontamination: SQL, brute force and defined cases."""
import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from renewcast.llm import chat, decontam, queries, url_filter

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "benchmark", "labels", "pages", "conversations")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    want = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(repr, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(repr, want.fetchall()))


# ------------------------------------------------------------------ URL filter

@pytest.mark.parametrize("url,host,path", [
    ("http://Ex.ample.NET/En/x?y#z", "ex.ample.net", "/En/x"), ("a://b", "b", ""), ("x", "", ""), (None, "", ""), ("://h?p/q", "h", ""),
    ("http://a://b/c", "a:", "//b/c"), ("s://ÀB.org#f", "Àb.org", ""), ("://", "", ""),
])
def test_split_url(spark, url, host, path):
    h, p = url_filter.split_url(F.col("u"))
    assert tuple(spark.createDataFrame([(url,)], "u string").select(h, p).first()) == (host, path)


def judged(spark, pages, outcomes, **kw):
    df = spark.createDataFrame(pages, "page_id long, url string").withColumn("host", F.lit("clash"))
    out = spark.createDataFrame(outcomes, "ref long, bad int")
    return url_filter.judge_urls(df, out, queries.URL_RULES, **kw).collect()


def test_longest_rule_wins(spark):
    urls = ["http://a.net/x", "http://net", "http://example.net/en/1", "http://example.net/fr/", "http://b.example.com/de/z", "http://example.com/en/",
            "http://q.org/fr/1", "http://org/fr/", "http://xnet/", "http://a.example.net/en/"]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in judged(spark, list(enumerate(urls)), [])}
    assert [got[i] for i in range(len(urls))] == [
        ("net/", "block"), (None, "allow"), ("example.net/en/", "allow"), ("net/", "block"), ("example.com/de/", "block"), (None, "allow"),
        ("org/fr/", "allow"), ("org/fr/", "allow"), (None, "allow"), ("example.net/en/", "allow")]


def test_reputation_shrinks_to_the_domain_and_blocks_bad_hosts(spark):
    pages, outcomes = [], []
    for h, bad, n in (("bad.x.io", 40, 40), ("good.x.io", 1, 40), ("new.y.io", 0, 0), ("few.z.io", 2, 2), ("c.w.io", 2, 30)):
        for k in range(max(n, 1)):
            i = len(pages)
            pages.append((i, f"http://{h}/{k}"))
            if k < n:
                outcomes.append((i, int(k < bad)))
    got = {r["host"]: r for r in judged(spark, pages, outcomes)}
    assert got["bad.x.io"]["verdict"] == "block" and got["good.x.io"]["verdict"] == "allow"
    assert got["new.y.io"]["bad_rate"] < got["few.z.io"]["bad_rate"] < got["bad.x.io"]["bad_rate"]      # two bad pages prove little
    assert 0 < got["new.y.io"]["bad_rate"] < 1 and got["bad.x.io"]["bad_rate"] > got["new.y.io"]["bad_rate"] > got["good.x.io"]["bad_rate"]


@pytest.mark.parametrize("host,domain,suffix", [
    ("a.b.co.uk", "b.co.uk", "co.uk"), ("b.co.uk", "b.co.uk", "co.uk"), ("co.uk", "co.uk", "co.uk"), ("me.github.io", "me.github.io", "github.io"),
    ("x.me.github.io:8080", "me.github.io", "github.io"), ("a.example.com", "example.com", "com"), ("example.com:80", "example.com", "com"),
    ("10.0.0.1", "10.0.0.1", "ip"), ("10.0.0.1:99", "10.0.0.1", "ip"), ("[::1]:80", "[::1]", "ip"), ("1.2.3.4.net", "4.net", "net"),
    ("localhost", "localhost", "localhost"), ("", "", ""), ("a.k12.ca.us", "a.k12.ca.us", "k12.ca.us")])
def test_levels_of_a_host(spark, host, domain, suffix):
    d, x = url_filter.levels(F.col("h"), [*url_filter.SUFFIXES, "k12.ca.us"])
    assert tuple(spark.createDataFrame([(host,)], "h string").select(d, x).first()) == (domain, suffix)


def test_strangers_under_one_suffix_do_not_share_a_domain(spark):
    pages, outcomes = [], []
    for h, bad, n in (("bad.github.io", 60, 60), ("good.github.io", 0, 60), ("10.0.0.1", 50, 50), ("10.0.0.2:80", 0, 50)):
        for k in range(n):
            pages.append((len(pages), f"http://{h}/{k}"))
            outcomes.append((len(outcomes), int(k < bad)))
    pages += [(900, "http://www.bad.github.io/"), (901, "http://www.good.github.io/"), (902, "http://10.0.0.1:81/"), (903, "http://10.0.0.2/")]
    got = {r["page_id"]: r["bad_rate"] for r in judged(spark, pages, outcomes)}
    assert got[900] > got[901] + 0.1 and got[902] > got[903] + 0.1


def test_url_defined_cases(spark):
    rows = judged(spark, [(1, None), (1, None), (None, "http://a.b/"), (2, "junk")], [])
    assert len(rows) == 4 and {r["verdict"] for r in rows} == {"allow"}
    assert judged(spark, [], []) == []


# ------------------------------------------------------------------ chat formatting

RECORDS = [
    '{"conv_id": 1, "messages": [{"role": "user", "content": "hi <|end|>"}, {"role": "assistant", "content": "a\\nb"}]}',
    '{"conv_id": 2, "prompt": "p & q", "response": "[INST] r"}',
    '{"conv_id": 3, "instruction": "do", "input": "this", "output": "done"}',
    '{"conv_id": 4, "instruction": "do", "output": "done"}',
    '{"conv_id": 5, "conversations": [{"from": "human", "value": "x"}, {"from": "gpt", "value": null}]}',
    '{"conv_id": 6, "dialog": {"turns": [{"speaker": "s1", "utterance": "u&lt;"}]}}',
    '{"conv_id": 7, "something": "else"}',
    '{"conv_id": 8, "system": "s", "prompt": "p", "response": "r"}',
    '{"conv_id": 9, "question": "q", "answer": "&amp;", "note": "extra"}',
]


def test_layouts_of_one_file(spark, tmp_path):
    (tmp_path / "mixed.json").write_text("\n".join(RECORDS))
    records = spark.read.json(str(tmp_path / "mixed.json"))
    out = chat.format_chats(records)
    back = {r["conv_id"]: [tuple(t) for t in r["t"]] for r in out.select("conv_id", chat.read_turns(F.col("formatted")).alias("t")).collect()}
    assert back == {
        1: [("user", "hi <|end|>"), ("assistant", "a\nb")], 2: [("user", "p & q"), ("assistant", "[INST] r")],
        3: [("user", "do\n\nthis"), ("assistant", "done")], 4: [("user", "do"), ("assistant", "done")],
        5: [("user", "x"), ("assistant", "")], 6: [("s1", "u&lt;")], 7: [],
        8: [("system", "s"), ("user", "p"), ("assistant", "r")], 9: [("user", "q"), ("assistant", "&amp;")]}
    for r in out.collect():
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
        assert r["formatted"].count(chat.CLOSE) == len(back[r["conv_id"]])


def test_null_fields_keep_their_texts(spark, tmp_path):
    lines = ['{"conv_id": 1, "prompt": "hi", "response": null}', '{"conv_id": 2, "instruction": null, "input": null, "output": "done"}',
             '{"conv_id": 3, "instruction": "do", "input": "this"}', '{"conv_id": 4, "messages": [{"role": "user"}, {"role": "assistant"}]}',
             '{"conv_id": 5, "prompt": "p", "question": "two layouts"}', '{"conv_id": 6, "system": "s", "response": "r"}', '{"conv_id": 7}',
             '{"conv_id": 8, "messages": [{"content": "no role"}]}', '{"conv_id": 9, "response": "alone"}']
    (tmp_path / "nulls.json").write_text("\n".join(lines))
    out = chat.format_chats(spark.read.json(str(tmp_path / "nulls.json")))
    rows = {r["conv_id"]: r for r in out.select("*", chat.read_turns(F.col("formatted")).alias("t")).collect()}
    back = {k: [tuple(t) for t in r["t"]] for k, r in rows.items()}
    assert back == {1: [("user", "hi"), ("assistant", "")], 2: [("user", ""), ("assistant", "done")], 3: [("user", "do\n\nthis"), ("assistant", "")],
                    4: [("user", ""), ("assistant", "")], 5: [], 6: [("system", "s"), ("user", ""), ("assistant", "r")], 7: [], 8: [("", "no role")],
                    9: [("user", ""), ("assistant", "alone")]}
    assert rows[1]["layout"] == "prompt and response" and rows[5]["layout"] is None
    assert rows[5]["fingerprint"] == chat.hash_of(["prompt", "question"]) and rows[7]["fingerprint"] == hashlib.sha256(b"").hexdigest()


def test_a_table_without_some_columns_of_a_layout(spark):
    out = chat.format_chats(spark.createDataFrame([(1, "only a prompt"), (2, None)], "conv_id long, prompt string"))
    assert {r["conv_id"]: r["formatted"].count(chat.CLOSE) for r in out.collect()} == {1: 2, 2: 0}


def test_every_fingerprint_selects_a_layout_that_has_its_paths():
    table = chat.fingerprints()
    assert all(table[lay.fingerprint] is lay for lay in chat.LAYOUTS) and len(table) > len(chat.LAYOUTS)


def test_rows_by_turn_defined_cases(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (1, None, None, None), (None, 1, "user", "z"),
            (2, 1, "a\nb<", "&lt; &nl; [ <|turn|>"), (3, 1, "user", "x" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(0)).withColumn("canonical", F.lit(0))
    out = chat.format_chats(chat.turn_records(df))
    back = {r["conv_id"]: [tuple(t) for t in r["t"]] for r in out.select("conv_id", chat.read_turns(F.col("formatted")).alias("t")).collect()}
    assert back[1] == [("", ""), ("user", "a"), ("assistant", "b"), ("assistant", "b")]
    assert back[None] == [("user", "z")] and back[2] == [("a\nb<", "&lt; &nl; [ <|turn|>")] and len(back[3][0][1]) == 100_000
    assert chat.format_chats(chat.turn_records(df.limit(0))).count() == 0


def test_probe_conversation(spark):
    r = queries.op7_chat_format(spark, SF).where("conv_id = -7").first()
    text = queries.PROBE_TEXT
    assert r["n_turns"] == 2 and r["loss_chars"] == len(text) and r["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert r["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


# ------------------------------------------------------------------ decontamination

def brute(docs, items, window):
    import re
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[k:k + n]), set()).add(str(i))
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in range(1, window + 1):
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in wins:
                    hit |= set(range(k, k + n))
                    found |= wins[tuple(w[k:k + n])]
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


def test_decontamination_matches_brute_force(spark, make_docs):
    import random
    rng = random.Random(4)
    prose = lambda n: " ".join(rng.choice("ab cd ef gh ij kl mn op".split()) + rng.choice(["", "1", "É"]) for _ in range(n))
    items = [(k, prose(rng.choice([0, 1, 3, 7, 9, 10, 11, 25]))) for k in range(12)] + [(50, None), (51, "Twin words, here"), (52, "twin WORDS here")]
    docs = [(k, prose(rng.randrange(60)) + ". " + items[rng.randrange(12)][1].upper() + "! " + prose(rng.randrange(30))) for k in range(30)]
    docs += [(99, None), (98, ""), (97, "x " * 5000 + items[7][1]), (3, "twin-words;HERE"), (3, "twin-words;HERE")]
    df = make_docs(docs, "mark span items start _words")
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("mark", F.lit(1))
    for window, gram in ((10, 7), (5, 3)):
        got = decontam.decontaminate(df, bench, window=window, gram=gram).collect()
        assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"])) for r in got), key=repr) == brute(docs, items, window)


def test_decontamination_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.decontaminate(make_docs([]), none).collect() == []
    assert [(r["n_words"], r["n_hit"]) for r in decontam.decontaminate(make_docs([(1, "a b"), (None, None)]), none).collect()] in ([(2, 0), (0, 0)], [(0, 0), (2, 0)])
    item = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    docs = make_docs([(1, "x a b"), (2, "clean"), (None, "a b")])
    left = decontam.drop_contaminated(docs, item)
    assert [r["doc_id"] for r in left.collect()] == [2] and left.columns == docs.columns


def test_native_plans_have_no_python(spark):
    for name in ("op7_chat_format", "op8_decontamination", "op10_url_filter"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoop")), name
