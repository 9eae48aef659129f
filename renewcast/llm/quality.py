"""Quality rules: a linear-chain conditional random field labels a text's lines content or boilerplate.

Counts that any rule may use come first (``rule_counts``).  Then each line gets a set of
binary features, and Viterbi decoding finds the best sequence of labels.  The share of words that
stand in content lines decides whether the document is kept.

The field is fitted here, on a bounded sample: of the ``sample`` labelled documents with the smallest hash of their id the lines, in pieces
of ``piece_lines``.  Of a document with more than ``pieces`` pieces as many are taken, evenly spaced from its start to its end, so
documents of any length teach the field.  Lines of documents of quality 1 count as content, those of quality 0 as
boilerplate; the transition weights and the line features then tell mixed documents apart.  Fitting is
full-batch gradient ascent of the conditional likelihood (forward-backward), on the driver, over that
sample alone; everything else is per text in the tasks.

Defined results: null or empty texts have no words and no lines that count, and fail the base rule; a text
without boilerplate has share 1; rows are judged one by one, so repeated rows repeat; of labelled rows that share an id the smallest text is fitted on; without any labelled
row, or with one class alone, every line is content; only id and text are read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from renewcast.llm.common import per_text

SAMPLE = 2000          # labelled documents the field is fitted on, at most
PIECE_LINES, PIECES = 200, 4   # lines of one training sequence, and sequences taken of one document, at most
LEAST_CONTENT = 0.5    # share of words in content lines that keeps a document
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

WORD = re.compile(r"[^ \t-\r]+")
SYMBOLS = "#*$%&|<>"
FEATURES = ("blank", "short", "medium", "long", "symbols", "exclaims", "upper", "digits", "repeats_line", "few_distinct",
            "sentence_end", "bars", "edge_symbols", "first", "bias")


def rule_counts(text: str) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    words = WORD.findall(text)
    n = len(words)
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += WORD.search(line) is not None
        else:
            seen.add(line)
    repeated = 0
    if n > 3:
        number: dict[str, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=n)
        code = (ids[:-2] * len(number) + ids[1:-1]) * len(number) + ids[2:] if len(number) < 2_000_000 else \
            np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]]), axis=1, return_inverse=True)[1].ravel()
        order = np.argsort(code, kind="stable")
        ranked = code[order]
        same = ranked[1:] == ranked[:-1]
        twice = np.zeros(n - 2, dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        hit = np.zeros(n, dtype=bool)
        for k in range(3):
            hit[k:n - 2 + k] |= twice
        repeated = int(hit.sum())
    return n, len("".join(words)), sum(text.count(c) for c in SYMBOLS), dup, repeated


def line_features(lines: list[str]) -> tuple[list[int], list[int]]:
    """(bit set of FEATURES, number of words) for each line."""
    masks, sizes, seen = [], [], set()
    for i, line in enumerate(lines):
        words = WORD.findall(line)
        n, chars = len(words), max(1, len(line))
        symbols = sum(line.count(c) for c in SYMBOLS)
        upper = sum(map(str.isupper, line)) if line != line.lower() else 0
        bits = (
            n == 0, 0 < n <= 3, 3 < n <= 12, n > 12, symbols > 0.04 * chars, 5 * line.count("!") > n, upper > 0.4 * chars,
            5 * sum(map(str.isdigit, line)) > chars, n > 0 and line in seen, n >= 8 and 2 * len(set(words)) <= n,
            line.rstrip()[-1:] in (".", "?", "!", ":", ";"), 4 * line.count("|") > n, n > 0 and 3 * sum(w[-1] in SYMBOLS for w in words) > n,
            i == 0, True,
        )
        masks.append(sum(1 << k for k, b in enumerate(bits) if b))
        sizes.append(n)
        seen.add(line)
    return masks, sizes


def spread_pieces(masks: list[int], piece_lines: int, pieces: int) -> list[list[int]]:
    """The lines in pieces, all of them or as many as asked for, evenly spaced from the first to the last."""
    parts = [masks[i:i + piece_lines] for i in range(0, len(masks), piece_lines)]
    if len(parts) <= pieces:
        return parts
    return [parts[round(k * (len(parts) - 1) / max(1, pieces - 1))] for k in range(pieces)]


def fit_field(sequences: list[list[int]], labels: list[int], rounds: int = 150, rate: float = 0.5, ridge: float = 1e-3,
              wholes: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(emission weights: features; transition weights: 2 x 2, from and to) of label 1, content, against 0.  ``wholes``: the lines
    of the document behind each sequence, where it is a piece of one."""
    k = len(FEATURES)
    weights, moves = np.zeros(k), np.zeros((2, 2))
    if not sequences or len(set(labels)) < 2:
        weights[-1] = 10.0
        return weights, moves
    # equal weight for both classes; sequences by length, so that little is padded
    wholes = [len(x) for x in sequences] if wholes is None else wholes
    share: Counter = Counter()
    for x, y, n in zip(sequences, labels, wholes, strict=True):
        share[y] += len(x) / n                             # documents of a class, whatever their pieces
    groups = []
    order = sorted(range(len(sequences)), key=lambda i: len(sequences[i]))
    for at in range(0, len(order), 256):
        part = order[at:at + 256]
        longest = max(len(sequences[i]) for i in part)
        x = np.zeros((len(part), longest, k))
        live = np.zeros((len(part), longest), dtype=bool)
        for r, i in enumerate(part):
            m = np.array(sequences[i])
            x[r, :len(m)] = (m[:, None] >> np.arange(k)) & 1
            live[r, :len(m)] = True
        groups.append((x, live, np.array([labels[i] for i in part]), np.array([0.5 / share[labels[i]] / wholes[i] for i in part])))
    step_w, step_m = np.full(k, 1e-8), np.full((2, 2), 1e-8)
    for _ in range(rounds):
        grad_w, grad_m = -ridge * weights, -ridge * moves
        for x, live, y, each in groups:                          # a document counts once, however long
            score = x @ weights                                     # of content; boilerplate has 0
            emit = np.stack([np.zeros_like(score), score], -1)
            ahead = np.zeros_like(emit)
            ahead[:, 0] = emit[:, 0]
            for t in range(1, x.shape[1]):
                into = np.logaddexp(ahead[:, t - 1, 0, None] + moves[0], ahead[:, t - 1, 1, None] + moves[1]) + emit[:, t]
                ahead[:, t] = np.where(live[:, t, None], into, ahead[:, t - 1])
            total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
            back = np.zeros_like(emit)
            for t in range(x.shape[1] - 2, -1, -1):
                out = back[:, t + 1] + emit[:, t + 1]
                into = np.logaddexp(moves[:, 0] + out[:, 0, None], moves[:, 1] + out[:, 1, None])
                back[:, t] = np.where(live[:, t + 1, None], into, 0)
            p1 = np.exp(ahead[..., 1] + back[..., 1] - total[:, None]) * live
            grad_w += np.einsum("rt,rtk,r->k", (y[:, None] - p1) * live, x, each)
            if x.shape[1] > 1:
                pair = np.exp(ahead[:, :-1, :, None] + moves + (emit + back)[:, 1:, None, :] - total[:, None, None, None]) * live[:, 1:, None, None]
                grad_m -= np.einsum("rtab,r->ab", pair, each)
                for c in (0, 1):
                    grad_m[c, c] += ((live[:, 1:].sum(1) * each)[y == c]).sum()
        step_w += grad_w ** 2
        step_m += grad_m ** 2
        weights = weights + rate * grad_w / np.sqrt(step_w)
        moves = np.clip(moves + rate * grad_m / np.sqrt(step_m), -1.5, 1.5)
    return weights, moves


def content_lines(masks: list[int], weights: np.ndarray, moves: np.ndarray, score: dict[int, float] | None = None) -> list[bool]:
    """Viterbi: the most probable labels, True for content; ties go to content."""
    score = {} if score is None else score
    (m00, m01), (m10, m11) = moves.tolist()
    from_content: list[tuple[bool, bool]] = []
    a = b = 0.0
    for t, mask in enumerate(masks):
        s = score.get(mask)
        if s is None:
            s = score[mask] = float(sum(weights[k] for k in range(len(FEATURES)) if mask >> k & 1))
        if t == 0:
            a, b = 0.0, s
            continue
        to0, to1 = b + m10 >= a + m00, b + m11 >= a + m01
        a, b = max(a + m00, b + m10), max(a + m01, b + m11) + s
        from_content.append((to0, to1))
    if not masks:
        return []
    now = b >= a
    path = [now]
    for to0, to1 in reversed(from_content):
        now = to1 if now else to0
        path.append(now)
    return path[::-1]


def fit_lines(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
              sample: int = SAMPLE, piece_lines: int = PIECE_LINES, pieces: int = PIECES) -> tuple[np.ndarray, np.ndarray]:
    """Fits the field; at most sample x pieces x piece_lines lines, as numbers, come to the driver."""
    judged = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")) \
        .agg(F.min(label_col).cast("int").alias("_y"))
    half = max(1, sample // 2)
    drawn = [judged.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(half) for y in (0, 1)]
    chosen = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")) \
        .join(F.broadcast(drawn[0].unionByName(drawn[1])), "_id").groupBy("_id", "_y").agg(F.min("_text").alias("_text"))

    def parts(text: str) -> tuple:
        found = spread_pieces(line_features(text.split("\n"))[0], piece_lines, pieces)
        return found, sum(map(len, found))

    rows = per_text(chosen, "_y", "_text", lambda: parts, "parts array<array<int>>, lines int").collect()
    rows.sort(key=lambda r: (r["_y"], r["parts"]))
    every = [(m, r["_y"], r["lines"]) for r in rows for m in r["parts"] if m]
    return fit_field([m for m, _, _ in every], [y for _, y, _ in every], wholes=[n for _, _, n in every])


def judge_quality(docs: DataFrame, field: tuple[np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text",
                  least_content: float = LEAST_CONTENT) -> DataFrame:
    """One row per document: the rule counts, base_failed, content_share and kept."""
    weights, moves = field

    def make():
        score: dict[int, float] = {}

        def judge(text: str) -> tuple:
            counts = rule_counts(text)
            n, repeated = counts[0], counts[4]
            failed = n < MIN_WORDS or 100 * repeated > MAX_REPEAT_PERCENT * n
            masks, sizes = line_features(text.split("\n"))
            inside = sum(s for s, c in zip(sizes, content_lines(masks, weights, moves, score), strict=True) if c)
            share = inside / n if n else 0.0
            return (*counts, failed, share, not failed and share >= least_content)

        return judge

    return per_text(docs, id_col, text_col, make, "n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                    "n_repeat_words long, base_failed boolean, content_share double, kept boolean")
