"""Toxicity: noisy-channel deobfuscation, then evidence of the restored words.

A written token is taken as a plain word sent through a channel that swaps letters for look-alike
digits and signs, repeats letters, and puts signs or spaces between them.  Suspicious tokens become a lattice of
possible letters, and Viterbi decoding under a character trigram model finds the likeliest word.  Decoded is what the
lattice can read as the start of a learned word: a token from its start or from behind a sign, a token with doubled letters,
or short tokens joined over the spaces between them (then only whole learned words, or six letters of one).
The trigrams are counted over every text of the corpus, mixed with those of the learned words.

Learning uses labelled rows alone, distinct texts only.  Features of a text are its words and the first
four to six letters of its words.  A feature is kept when enough toxic texts have it and its log-odds
between toxic and other texts is clearly above zero (a lower bound).  A text's evidence is its strongest
feature and the number of words with one; a logistic curve over counts of a separate fold makes them a score.

Features and trigrams are summed over Spark with a combining step first, so texts of one hot source
or label are spread like all others, and the bound of the log-odds is taken in Spark.  To the driver and the tasks come the
trigrams (as many as the alphabet allows) and the kept features, which grow with the words of the corpus.  Labels are
broadcast only after their rows were counted.

Defined results: null or empty texts have no evidence and get the score of such texts; rows are judged one by
one, so repeated rows repeat; several labels of one id count as toxic if one is; null ids have no label; without labels of both classes
every score is 0; only id, text and label are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from renewcast.llm.common import bounded_broadcast, per_text, written

PREFIXES = (4, 5, 6)
LEAST_TEXTS = 5                          # toxic texts that must have a feature, at every size
LEAST_EVIDENCE, BOUND_Z = 1.5, 2.0       # kept features: lower bound of the log-odds
EVIDENCE_STEP, MOST_HITS = 0.5, 8        # bins of the calibration counts

#: Signs read as letters; every sign may also stand for nothing.
LOOKALIKE = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i",
             "|": "il", "+": "t", "€": "e", "(": "c"}
SWAP_COST, DROP_COST, REPEAT_COST, KEEP_SIGN_COST = 0.5, 1.0, 0.2, 6.0
EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»„“”‘’…–—¿¡"
PLAIN_EDGE = "".join(c for c in EDGE if c not in "$@")     # at an edge, only these two are taken for letters
SPACED = re.compile(r"(?<![^\W_])(?:[^\s.\-_*][\s.\-_*]+){3,}[^\s.\-_*](?![^\W_])")
RUN = re.compile(r"(.)\1{3,}")              # more than three of a sign say no more than three
DOUBLE = re.compile(r"([^\W\d_])\1")
PART, OVERLAP = 64, 24                    # signs decoded at a time in long runs
NUMBER = re.compile(r"[\d.,:/+()\-%#|]*")   # digits with the signs that numbers are written with: not words
PART_END = re.compile("(?<=.)[^\\w" + re.escape("".join(c for c in LOOKALIKE if not c.isalnum())) + "]|_")
LETTERS = 28                              # a-z, any other letter, word edge
OTHER, EDGE_CODE = 26, 27
CODES = np.full(256, EDGE_CODE, dtype=np.int64)
CODES[ord("a"):ord("z") + 1] = np.arange(26)
CODES[128:] = OTHER


def trigram_counts(text: str) -> np.ndarray:
    """Counts of letter trigrams (with word edges) of a text, by code."""
    x = CODES[np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", dtype=np.uint8)]
    return np.bincount((x[:-2] * LETTERS + x[1:-1]) * LETTERS + x[2:], minlength=LETTERS ** 3)


def features_of(word: str) -> list[str]:
    return [word + "$", *[word[:n] for n in PREFIXES if len(word) >= n]]


def plain_words(text: str) -> set[str]:
    return {w for t in text.lower().split() if len(w := t.strip(EDGE)) > 2 and w.isalpha()}


@dataclass
class Model:
    """features: feature -> log-odds; cost: -log P(letter | two before) by trigram code; curve: intercept, weights."""
    features: dict[str, float]
    cost: np.ndarray
    curve: tuple[float, float, float]


def trigram_cost(counts: np.ndarray, words: Iterable[str], share: float = 0.3) -> np.ndarray:
    """-log of the mixed conditional probabilities: corpus and learned words."""
    def conditional(c: np.ndarray, add: float) -> np.ndarray:
        c = c.reshape(-1, LETTERS) + add
        return c / c.sum(1, keepdims=True)

    own = np.zeros(LETTERS ** 3)
    for w in words:
        own += trigram_counts(w)
    return -np.log((1 - share) * conditional(counts.astype(float), 0.5) + share * conditional(own, 0.01)).ravel()


def code(ch: str) -> int:
    return ord(ch) - 97 if "a" <= ch <= "z" else OTHER


def restore(token: str, cost: np.ndarray) -> str:
    """The likeliest plain word behind a token: Viterbi over the lattice of its signs, state the last two letters."""
    states: dict[tuple[int, int], tuple[float, str]] = {(EDGE_CODE, EDGE_CODE): (0.0, "")}
    for ch in token:
        if ch.isalpha():
            ways = [(ch, 0.0)]
        else:
            ways = [(x, SWAP_COST) for x in LOOKALIKE.get(ch, "")] + [("", DROP_COST if not ch.isdigit() else KEEP_SIGN_COST)]
        after: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (total, word) in states.items():
            for letter, pay in ways:
                if letter == "":
                    options = (((a, b), total + pay, word),)
                else:
                    c = code(letter)
                    step = total + pay + float(cost[(a * LETTERS + b) * LETTERS + c])
                    options = (((b, c), step, word + letter),)
                    if word.endswith(letter):
                        options += (((a, b), total + pay + REPEAT_COST, word),)
                for at, value, new in options:
                    if at not in after or value < after[at][0]:
                        after[at] = (value, new)
        states = after
    ends = [(v + float(cost[(a * LETTERS + b) * LETTERS + EDGE_CODE]), w) for (a, b), (v, w) in states.items()]
    return min(ends)[1]


def reader(features: dict[str, float], cost: np.ndarray) -> Callable[[str], tuple[float, int]]:
    """The function text -> (strongest evidence, number of words with evidence)."""
    stems = {f[:4].rstrip("$") for f in features}
    starts = {s[:n] for s in stems for n in range(1, len(s) + 1)}
    whole = {f[:-1] for f in features if f.endswith("$")} | {f for f in features if len(f) == PREFIXES[-1] and not f.endswith("$")}
    ends = {f for f in features if len(f) == PREFIXES[-1] and not f.endswith("$")}
    paths = {w[:n] for w in whole for n in range(len(w) + 1)}
    known: dict[str, float] = {}
    heads: dict[str, frozenset[str]] = {}      # by the first four signs of a token

    def evidence(word: str) -> float:
        return max(0.0, *[features.get(f, 0.0) for f in features_of(word)])

    def opens(token: str, at: int) -> tuple[bool, bool]:
        """Whether the lattice from a place on can begin with a learned stem, and whether it must read a sign for it."""
        plain, read = {""}, set()               # beginnings of stems read from letters alone, and with signs
        for ch in token[at:at + PART]:
            if ch.isalpha():
                plain = {p + ch for p in plain if p + ch in starts} | {p for p in plain if p.endswith(ch) and p}
                read = {p + ch for p in read if p + ch in starts} | {p for p in read if p.endswith(ch)}
            else:
                both = plain | read
                ways = LOOKALIKE.get(ch, "")
                read = {p + x for p in both for x in ways if p + x in starts} | {p for p in both if p}
                plain = set()
            if not plain and not read:
                break
            if not stems.isdisjoint(plain):
                return True, False
            if not stems.isdisjoint(read):
                return True, True
        return False, False

    def decoded(token: str) -> float:
        """Evidence of a token of any length: read from its start and from behind each sign, as far as it goes and to the
        next sign that is no letter; amid letters only what is written with signs counts, and no stem of four letters."""
        e = known.get(token)
        if e is None:
            if len(known) > 200_000:
                known.clear()
            e, full = 0.0, token
            token = RUN.sub(r"\1\1\1", token)
            for at in range(len(token)):
                may, signs = opens(token, at)
                edge = at == 0 or not token[at - 1].isalnum()
                if not may or not (edge or signs):
                    continue
                rest = token[at:at + PART]
                for part in {rest, PART_END.split(rest, maxsplit=1)[0]}:
                    word = restore(part, cost)
                    e = max(e, evidence(word) if edge else max(0.0, *[features.get(word[:n], 0.0) for n in PREFIXES[1:]],
                                                               features.get(word + "$", 0.0)))
            known[full] = e
        return e

    def onward(at: set[str] | frozenset[str], signs: str) -> set[str]:
        """The beginnings of learned words that the lattice reaches from some beginnings by further signs."""
        for ch in signs:
            ways = ch if ch.isalpha() else LOOKALIKE.get(ch, "")
            after = {p + x for p in at for x in ways if p + x in paths} | {p for p in at if p and p[-1] in ways}
            after |= {p for p in at if p in ends}          # six letters are enough, whatever follows
            at = after if ch.isalpha() else after | set(at)
            if not at:
                break
        return at

    def may_open(token: str) -> frozenset[str]:
        """The beginnings that the first four signs of a token can be read as."""
        first = heads.get(token[:4])
        if first is None:
            if len(heads) > 200_000:
                heads.clear()
            first = heads[token[:4]] = frozenset(p for p in onward({""}, token[:4]) if p or not token[:1].isalpha())
        return first

    def head(token: str) -> set[str]:
        """The proper beginnings of learned words that a whole token can be read as."""
        own = RUN.sub(r"\1\1\1", token.lstrip(PLAIN_EDGE))
        first = may_open(own)
        if not first or len(own) > PART or len(own.rstrip(PLAIN_EDGE)) not in (1, len(own)):
            return set()
        return {p for p in (onward(first, own[4:]) if len(own) > 4 else first) if p}

    def joined(tokens: list[str], i: int) -> float:
        """Evidence of a learned word that begins with a token and goes on in the next ones; the space is a sign that stands for
        nothing.  Only a word that ends with a token, or goes on for six letters, counts: 'as shown' begins many words."""
        at, text = head(tokens[i]), tokens[i].strip(PLAIN_EDGE)
        if not at:
            return 0.0
        for token in tokens[i + 1:i + PART]:
            own = token.rstrip(PLAIN_EDGE)
            at, text = onward(at, own[:PART]), text + own[:PART]
            if not at:
                break
            if not whole.isdisjoint(at) and not NUMBER.fullmatch(text):
                word = restore(RUN.sub(r"\1\1\1", text), cost)
                e = max(features.get(word + "$", 0.0), features.get(word[:PREFIXES[-1]], 0.0) if len(word) >= PREFIXES[-1] else 0.0)
                if e > 0:
                    return e
            if len(text) > PART or own != token and len(own) > 1:      # a space behind punctuation parts words, not letters
                break
        return 0.0

    def inside(token: str) -> float:
        """Evidence anywhere in a run of signs; long runs are decoded in parts that overlap."""
        best = 0.0
        for at in range(0, max(1, len(token) - OVERLAP), PART - OVERLAP):
            word = restore(token[at:at + PART], cost)
            best = max([best, *[evidence(word[k:]) for k in range(len(word) - 2) if word[k:k + 4] in stems]])
        return best

    def read(text: str) -> tuple[float, int]:
        best, hits = 0.0, 0

        def run(m: re.Match) -> str:
            """A run of single signs with evidence counts once; its letters are not looked at again."""
            nonlocal best, hits
            e = inside("".join(ch for ch in m[0] if not ch.isspace() and ch not in ".-_*"))
            if e > 0:
                hits += 1
                best = max(best, e)
            return " " if e > 0 else m[0]

        tokens = SPACED.sub(run, text.lower()).split()
        for i, token in enumerate(tokens):
            word = token.strip(EDGE)
            e = evidence(word) if word[:4] in stems else 0.0
            if e == 0.0 and len(word) > 2:
                if not word.isalpha():
                    if not NUMBER.fullmatch(word):
                        e = decoded(word)
                elif (word[:2] in starts or word[0] == word[1]) and DOUBLE.search(word) and opens(RUN.sub(r"\1\1\1", word), 0)[0]:
                    e = decoded(word)
            if e == 0.0 and (token[0] in "$@" or token[-1] in "$@"):
                whole_token = token.strip(PLAIN_EDGE)
                if len(whole_token) > 2 and 0 < len(whole_token) - len(word) <= 2:      # longer runs of signs are decoration
                    e = decoded(whole_token)
            if e == 0.0:
                first = heads.get(token[:4])
                if may_open(token) if first is None else first:
                    e = joined(tokens, i)
            if e > 0:
                hits += 1
                best = max(best, e)
        return best, hits

    return read


def log_odds(toxic: int, other: int, n_toxic: int, n_other: int) -> float:
    return math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((other + 0.5) / (n_other + 1))


def least_log_odds(toxic: Column, other: Column, n_toxic: int, n_other: int) -> Column:
    """The lower bound of ``log_odds`` at BOUND_Z standard errors."""
    t, o = toxic + 0.5, other + 0.5
    return F.log(t / (n_toxic + 1)) - F.log(o / (n_other + 1)) - BOUND_Z * F.sqrt(1 / t + 1 / o)


def fit_curve(rows: Iterable[tuple[float, int, int, int]], rounds: int = 50) -> tuple[float, float, float]:
    """Logistic regression of (evidence, hits, toxic, count) rows by Newton steps with a small ridge."""
    data = np.array([(1.0, e, math.log1p(h), y, n) for e, h, y, n in rows], dtype=float).reshape(-1, 5)
    x, y, n = data[:, :3], data[:, 3], data[:, 4]
    w = np.zeros(3)
    if not len(data) or not 0 < (y * n).sum() < n.sum():
        return (-50.0, 0.0, 0.0)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        ridge = np.array([1e-6, 0.1, 0.1])
        grad = x.T @ (n * (y - p)) - ridge * w
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(ridge), grad)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def fold_of(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5, F.lit(-1))


def _sums(docs: DataFrame) -> DataFrame:
    """(key, toxic, other) over rows (role, text): letter trigrams ``#code`` of every text (as ``toxic``), and the texts of role 1
    (toxic) and of role 2 (other) that have a feature.  Counted per task before the shuffle."""
    import pyarrow as pa

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, found = np.zeros(LETTERS ** 3, dtype=np.int64), (Counter(), Counter())

        def out(items: dict[str, int], role: int) -> pa.RecordBatch:
            n, none = pa.array(list(items.values()), pa.int64()), pa.array([0] * len(items), pa.int64())
            return pa.RecordBatch.from_pydict({"key": pa.array(list(items), pa.string()), "toxic": n if role == 1 else none,
                                               "other": none if role == 1 else n})

        for b in batches:
            roles, texts = b.columns
            for i in range(b.num_rows):
                text, role = texts[i].as_py() or "", roles[i].as_py()
                grams += trigram_counts(text)
                if role:
                    own = found[role - 1]
                    own.update({f for w in plain_words(text) for f in features_of(w)})
                    if len(own) > 200_000:
                        yield out(own, role)
                        own.clear()
        for role in (1, 2):
            if found[role - 1]:
                yield out(found[role - 1], role)
        yield out({f"#{k}": int(grams[k]) for k in np.flatnonzero(grams)}, 1)

    return docs.mapInArrow(run, "key string, toxic long, other long").groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learns from labelled rows whose fold (crc32 of the id's text, modulo 5) is not 0: features from folds 1
    to 3, the curve from fold 4; trigrams from all texts."""
    judged = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")) \
        .agg(F.max(label_col).cast("int").alias("_y")).withColumn("_fold", fold_of("_id")).where("_fold > 0")
    judged = bounded_broadcast(written(judged, "toxicity_labels"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = docs.select(F.col(id_col).alias("_id"), text.alias("_text"))
    # one row for each distinct labelled text; its smallest id stands for it
    one = plain.select("_id", F.xxhash64("_text").alias("_tx")).join(judged, "_id").groupBy("_tx") \
        .agg(F.min(F.struct("_id", "_fold", "_y")).alias("x")).select("x._id", "x._fold", "x._y").distinct()
    one = written(one, "toxicity_rows")
    n = {(r["y"], r["learns"]): r["n"] for r in one.groupBy(F.col("_y").alias("y"), (F.col("_fold") < 4).alias("learns")).agg(F.count("*").alias("n")).collect()}
    n_toxic, n_other = n.get((1, True), 0), n.get((0, True), 0)
    rows = bounded_broadcast(one)

    role = F.when(F.col("_fold") < 4, F.when(F.col("_y") == 1, 1).otherwise(2)).otherwise(0)
    kept_ones = (F.col("toxic") >= LEAST_TEXTS) & (least_log_odds(F.col("toxic"), F.col("other"), n_toxic, n_other) >= LEAST_EVIDENCE)
    sums = _sums(plain.join(rows, "_id", "left").select(role.alias("role"), "_text")).where(F.col("key").startswith("#") | kept_ones)
    grams = np.zeros(LETTERS ** 3, dtype=np.int64)
    kept = {}
    for r in sums.collect():
        if r["key"].startswith("#"):
            grams[int(r["key"][1:])] = r["toxic"]
        else:
            kept[r["key"]] = round(log_odds(r["toxic"], r["other"], n_toxic, n_other), 6)
    cost = trigram_cost(grams, [f[:-1] for f in sorted(kept) if f.endswith("$")])

    def bins():
        read = reader(kept, cost)

        def binned(text: str) -> tuple:
            e, h = read(text)
            return round(e / EVIDENCE_STEP) * EVIDENCE_STEP, min(h, MOST_HITS)

        return binned

    last = plain.join(rows, "_id").where("_fold = 4").select("_y", "_text")
    counts = per_text(last, "_y", "_text", bins, "e double, h int").groupBy("e", "h", "_y").agg(F.count("*").alias("n")).collect()
    return Model(kept, cost, fit_curve((r["e"], r["h"], r["_y"], r["n"]) for r in sorted(counts)))


def scorer(model: Model) -> Callable[[str], tuple[float, float, int]]:
    """The function text -> (score, evidence, hits)."""
    read = reader(model.features, model.cost)
    a, b, c = model.curve

    def score(text: str) -> tuple[float, float, int]:
        e, h = read(text)
        z = a + b * e + c * math.log1p(min(h, MOST_HITS))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z)))), e, h

    return score


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, score, predicted, evidence and hits."""
    scored = per_text(docs, id_col, text_col, lambda: scorer(model), "score double, evidence double, hits int")
    return scored.select(id_col, (fold_of(id_col) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
                         "evidence", "hits")


def drop_toxic(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows scored below 0.5, with the columns they had; one pass, no shuffle."""
    rest = [c for c in docs.columns if c != id_col]
    names = {c: f"_c{k}" for k, c in enumerate(rest)}            # no column can clash with the score
    scored = per_text(docs.withColumnsRenamed(names), id_col, names[text_col], lambda: scorer(model),
                      "_score double, _evidence double, _hits int", carry=list(names.values()))
    return scored.where("_score < 0.5").select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])
