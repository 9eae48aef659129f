"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

1. Terms of a text are its lower-cased words and the shapes of its words (letters, capitals and digits as one sign a run, all
   other signs as they are), hashed to ``WORDS`` and ``SHAPES`` cells, and the number of words that repeat the one before.
   Document frequencies of the cells are counted over every document, summed per task before the shuffle.
2. At most ``sample`` distinct labelled texts, half of them of each label (smallest hash of the id), give a weighted term matrix; its
   leading ``rank`` right singular vectors (subspace iteration) are the latent space.
3. The labelled vectors, at most sample x rank numbers, are broadcast.  Every document is projected, and blocks of documents
   are multiplied with all labelled vectors: exact cosines, no index.  The ``k`` nearest vote with
   the fourth power of their cosine, each label's votes divided by its share of the sample.

Defined results: a null text is empty; a text without terms, or with no neighbour of a positive cosine, gets the share of label 1 among the
labelled texts, 0.5 if there are none; ties of the nearest (equal to five decimals) go to the smaller id; repeated rows are scored alike;
several labels of one id count as the smallest, null ids and null labels as none, and null ids are not held out; an empty table gives no
rows; only id, text and label are read.  Fitting takes at most ``sample`` labelled texts; all else covers all rows and whole texts.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from renewcast.llm.common import bounded_broadcast, per_text, written
from renewcast.llm.toxicity import fold_of

SAMPLE = 4_000                  # labelled texts the space and the votes come from, at most
RANK, NEIGHBOURS, POWER = 64, 25, 4
WORDS, SHAPES = 4096, 512       # cells of words and of shapes
TERMS = WORDS + SHAPES + 1      # the last counts words equal to the one before
WORD_WEIGHT = 0.5               # length of the word part against that of the shape part
BLOCK = 512                     # documents multiplied at a time
PREDICT = 0.3

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SHAPE = bytes(ord("a") if 97 <= c <= 122 or c >= 128 else ord("A") if 65 <= c <= 90 else ord("0") if 48 <= c <= 57 else c for c in range(256))
_RUN = re.compile(rb"a+|A+|0+")


def term_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(cells in ascending order, counts) of a whole text."""
    raw = text.encode("utf-8", "replace")
    words = raw.translate(_LOWER).split()
    shapes = _RUN.sub(lambda m: m[0][:1], raw.translate(_SHAPE)).split()
    a, b = Counter(words), Counter(shapes)
    cells = [zlib.crc32(w) & (WORDS - 1) for w in a]
    cells += [WORDS + (zlib.crc32(s) & (SHAPES - 1)) for s in b]
    n = np.bincount(cells, weights=[*a.values(), *b.values()], minlength=TERMS) if cells else np.zeros(TERMS)
    n[-1] = sum(map(eq, words, words[1:]))
    at = np.flatnonzero(n)
    return at, n[at]


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[int, np.ndarray]:
    """(documents, documents per cell); at most TERMS + 1 rows a task are shuffled, and as many come to the driver."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(TERMS + 1, dtype=np.int64)
        for b in batches:
            for x in b.column(0):
                found[term_counts(x.as_py() or "")[0]] += 1
            found[-1] += b.num_rows
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], names=["cell", "n"])

    out = np.zeros(TERMS + 1, dtype=np.int64)
    for r in docs.select(text_col).mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return int(out[-1]), out[:-1]


def weighted(cells: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The weights of a text's cells: words at length WORD_WEIGHT, shapes and repeats at length 1."""
    x = np.log1p(counts) * idf[cells]
    cut = int(np.searchsorted(cells, WORDS))
    for part, length in ((x[:cut], WORD_WEIGHT), (x[cut:], 1.0)):
        norm = float(np.sqrt(part @ part))
        if norm > 0:
            part *= length / norm
    return x


def latent_space(matrix: np.ndarray, rank: int, rounds: int = 5) -> np.ndarray:
    """(terms x rank) leading right singular vectors of a (texts x terms) matrix, by subspace iteration from a fixed start."""
    rank = max(1, min(rank, *matrix.shape))
    wide = min(rank + 16, *matrix.shape)
    q = np.linalg.qr(np.random.default_rng(20).standard_normal((matrix.shape[1], wide)))[0]
    for _ in range(rounds):
        q = np.linalg.qr(matrix.T @ (matrix @ q))[0]
    _, _, v = np.linalg.svd(matrix @ q, full_matrices=False)
    return (q @ v.T[:, :rank]).astype(np.float32)


@dataclass
class Space:
    """idf: per cell; axes: cells x rank; vectors: labelled texts x rank, unit rows in the order of their ids; labels: 0 or 1."""
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    @property
    def share(self) -> float:
        return float(self.labels.mean()) if len(self.labels) else 0.5

    def project(self, texts: Iterable[str]) -> np.ndarray:
        """One unit row per text; zeros for a text without terms."""
        rows = []
        for text in texts:
            cells, counts = term_counts(text)
            rows.append(weighted(cells, counts, self.idf).astype(np.float32) @ self.axes[cells])
        x = np.array(rows, dtype=np.float32).reshape(len(rows), self.axes.shape[1])
        length = np.sqrt((x * x).sum(1, keepdims=True))
        return np.divide(x, length, out=np.zeros_like(x), where=length > 1e-6)

    def votes(self, block: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
        """Scores of projected texts: cosines with all labelled vectors, votes of the k nearest."""
        n = len(self.labels)
        if not n:
            return np.full(len(block), 0.5)
        near = np.rint((block @ self.vectors.T).astype(np.float64) * 1e5).astype(np.int64)
        k = min(k, n)
        order = near * n + np.arange(n - 1, -1, -1)      # of equal cosines, the smaller id
        top = np.argpartition(order, n - k, axis=1)[:, n - k:]
        top.sort(axis=1)
        vote = np.maximum(np.take_along_axis(near, top, 1) / 1e5, 0) ** POWER
        ones = max(self.share, 1e-9)
        zeros = max(1 - self.share, 1e-9)
        y = self.labels[top]
        good, bad = (vote * y).sum(1) / ones, (vote * (1 - y)).sum(1) / zeros
        total = good + bad
        return np.divide(good, total, out=np.full(len(block), self.share), where=total > 0)


def learn_space(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                sample: int = SAMPLE, rank: int = RANK) -> Space:
    """Fits the space; labels of held-out ids (fold 0) are not read."""
    judged = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")) \
        .agg(F.min(label_col).cast("int").alias("_y")).where((fold_of("_id") != 0) & F.col("_y").isin(0, 1))
    judged = bounded_broadcast(written(judged, "quality_labels"))
    plain = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    # one row for each distinct labelled text: a large group of copies is one neighbour
    one = plain.select("_id", F.xxhash64("_text").alias("_tx")).join(judged, "_id").groupBy("_tx") \
        .agg(F.min(F.struct("_id", "_y")).alias("x")).select("x._id", "x._y")
    one = written(one, "quality_rows")
    half = max(1, sample // 2)
    drawn = [one.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(half) for y in (0, 1)]
    drawn = written(drawn[0].unionByName(drawn[1]), "quality_sample")     # at most ``sample`` rows of two numbers
    chosen = plain.join(F.broadcast(drawn), "_id").groupBy("_id", "_y").agg(F.min("_text").alias("_text"))
    rows = per_text(chosen, "_id", "_text", lambda: lambda text: tuple(x.tolist() for x in term_counts(text)), "cells array<int>, counts array<float>",
                    carry=("_y",)).collect()
    rows.sort(key=lambda r: r["_id"])

    n, found = document_frequencies(docs, text_col)
    idf = np.log((1 + n) / (1 + found)).astype(np.float32)
    idf[WORDS:] += 0.5                                   # shapes that most texts have still count
    y = np.array([r["_y"] for r in rows], dtype=np.int64)
    matrix = np.zeros((len(rows), TERMS), dtype=np.float32)
    for i, r in enumerate(rows):
        cells = np.array(r["cells"], dtype=np.int64)
        matrix[i, cells] = weighted(cells, np.array(r["counts"], dtype=np.float64), idf)
    axes = latent_space(matrix, rank) if len(rows) else np.zeros((TERMS, 1), dtype=np.float32)
    x = matrix @ axes
    length = np.sqrt((x * x).sum(1, keepdims=True))
    return Space(idf, axes, np.divide(x, length, out=np.zeros_like(x), where=length > 1e-6), y)


def score_quality(docs: DataFrame, space: Space, id_col: str = "doc_id", text_col: str = "text", k: int = NEIGHBOURS,
                  least: float = PREDICT) -> DataFrame:
    """One row per document: id, held_out, score (0 to 1, rounded to six decimals) and predicted (score >= ``least``)."""
    shared = docs.sparkSession.sparkContext.broadcast(space)
    kind = docs.schema[id_col]
    out = pa.schema([(id_col, to_arrow_type(kind.dataType)), ("score", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                vectors = fitted.project(x.as_py() or "" for x in part.column(0))
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(np.round(fitted.votes(vectors, k), 6))], schema=out)

    scored = docs.select(F.col(text_col).alias("_text"), F.col(id_col)).mapInArrow(run, StructType([kind]).add("score", "double"))
    return scored.select(id_col, (fold_of(id_col) == 0).alias("held_out"), "score",
                         (F.col("score") >= least).cast("int").alias("predicted"))
