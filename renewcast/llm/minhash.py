"""Near-duplicate groups by HyperMinHash, banding, corrected estimates and exact checks.

1. Signature: a document's distinct word shingles are hashed; for each of bands x rows hash functions the minimum is
   kept as a 16-bit register, its leading-zero count (6 bits) and the 10 bits after its first one.
2. Rows of equal shingle sets (equal 128-bit digest) are one node, numbered for the rest.  Every band of registers is one 64-bit key.
3. In each bucket every member is paired with the smallest member (a star, never all pairs).  The Jaccard estimate of a
   pair, corrected for registers that agree by chance, drops hopeless pairs (six standard deviations below the
   threshold); the others are checked on their full shingle sets.  Components of these links follow.
4. Buckets whose other members are still in different components are finished exactly.  Jaccard distance is a metric,
   so members whose distances to the bucket's centre differ by more than the threshold distance cannot link;
   what is left, members outside the bucket's main component against all others, is counted with an inverted index over the full
   sets, in blocks of bounded size on both sides, and only links that join two components are emitted.

So every candidate pair of different components is checked or excluded by a bound, no group is expanded into
all its pairs, and a bucket with a third of all rows is many blocks.  A link of similarity s is a candidate with
probability 1 - (1 - s^rows)^bands: 1 - 2e-8 at 0.85, 1 - 4e-6 at 0.8.

Defined results: null, empty and white-space texts have no shingles and link with nothing; a text of fewer
words than a shingle is one shingle; rows with the same id and different texts are judged each by its own text, repeated rows alike;
a null id links with nothing and is kept; all rows come back; empty tables give no rows; only id and text are read.
The stage keeps one row of each group: of the group's smallest id, there of the smallest digest, and of rows that still are
equal the first by a hash of their columns; rows without shingles or id all stay.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from renewcast.llm.common import bounded_broadcast, per_text, written
from renewcast.llm.graph import components

BANDS, ROWS, MANTISSA = 24, 4, 10
DEVIATIONS = 6
BLOCK = 200_000            # shingles of one block of a bucket
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)


class WordHash(dict):
    """Word -> 64-bit hash, computed once per task."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 250_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_hashes(text: str, k: int, words: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's k-word shingles (A-Z lower-cased, ASCII white space between words)."""
    w = text.encode("utf-8", "replace").lower().split()
    if not w:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(words.__getitem__, w), dtype=np.uint64, count=len(w))
    n = max(1, len(w) - k + 1)
    g = np.full(n, len(w) if len(w) < k else k, dtype=np.uint64)
    for i in range(min(k, len(w))):
        g = (g ^ h[i:i + n]) * MIX[i % len(MIX)]
        g ^= g >> np.uint64(29)
    return np.unique(g)


@functools.cache
def multipliers(count: int) -> np.ndarray:
    return np.random.default_rng(20240229).integers(0, 2 ** 63, size=count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def registers(hashes: np.ndarray, count: int) -> np.ndarray:
    """HyperMinHash registers of a non-empty set: leading zeros and mantissa of the minimum under each hash function."""
    a = multipliers(count)
    low = np.full(count, np.uint64(2 ** 64 - 1))
    for at in range(0, len(hashes), 2048):
        low = np.minimum(low, (a[:, None] * hashes[None, at:at + 2048]).min(1))
    zeros = np.minimum(64 - np.frexp(low.astype(np.float64))[1], 62).astype(np.uint64)
    rest = (low << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    return ((zeros << np.uint64(MANTISSA)) | rest).astype(np.uint16)


@functools.lru_cache(maxsize=4096)
def _chance(log_n: int, log_m: int) -> float:
    """Probability that registers of two disjoint sets agree; sizes as powers of 2^(1/4)."""
    n, m = 2 ** (log_n / 4), 2 ** (log_m / 4)
    cells = 1 << MANTISSA
    total = 0.0
    for z in range(40):
        edge = 2.0 ** -(z + 1) * (1 + np.arange(cells + 1) / cells)
        a, b = (np.exp(s * np.log1p(-np.minimum(edge, 1 - 1e-12))) for s in (n, m))
        total += float(((a[:-1] - a[1:]) * (b[:-1] - b[1:])).sum())
    return total


def chance(n: int, m: int) -> float:
    return _chance(round(4 * math.log2(max(n, 1))), round(4 * math.log2(max(m, 1))))


def estimate(a: np.ndarray, b: np.ndarray, n: int, m: int) -> float:
    """Jaccard similarity from registers, corrected for chance agreement."""
    e = chance(n, m)
    return max(0.0, (float((a == b).mean()) - e) / (1 - e))


def linked(inter: int, n: int, m: int, similarity: tuple[int, int]) -> bool:
    num, den = similarity
    return den * inter >= num * (n + m - inter)


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int, bands: int, rows: int) -> DataFrame:
    """(id, n, digest, regs) for each row; digest and regs are null without shingles."""
    import xxhash

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHash()
        for b in batches:
            n, digest, regs = [], [], []
            for cell in b.column(1):
                h = shingle_hashes(cell.as_py() or "", shingle, words)
                n.append(len(h))
                digest.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
                regs.append(registers(h, bands * rows).tobytes() if len(h) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(regs, pa.binary())],
                                             names=["id", "n", "digest", "regs"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).mapInArrow(run, "id long, n long, digest binary, regs binary")


def band_rows(reps: DataFrame, bands: int, rows: int) -> DataFrame:
    """(key, id, n): a row for each band of each document; the key mixes band number and registers."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mix = multipliers(bands)
        for b in batches:
            if not b.num_rows:
                continue
            packed = np.stack([np.frombuffer(r.as_py(), dtype=np.uint16) for r in b.column(2)]).reshape(-1, bands, rows).astype(np.uint64)
            key = np.zeros((len(packed), bands), dtype=np.uint64)
            for r in range(rows):
                key = (key ^ packed[:, :, r]) * mix
                key ^= key >> np.uint64(31)
            ids, n = (np.repeat(b.column(c).to_numpy(), bands) for c in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(ids), pa.array(n)], names=["key", "id", "n"])

    return reps.select("id", "n", "regs").mapInArrow(run, "key long, id long, n long")


def promising(pairs: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) whose sizes and corrected estimate leave the threshold possible; takes a, b, na, nb, ra, rb."""
    s = similarity[0] / similarity[1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            na, nb, ra, rb = (b.column(k).to_pylist() for k in range(2, 6))
            keep = []
            for n, m, x, y in zip(na, nb, ra, rb, strict=True):
                x, y = np.frombuffer(x, dtype=np.uint16), np.frombuffer(y, dtype=np.uint16)
                least = s - DEVIATIONS * math.sqrt(s * (1 - s) / len(x))
                keep.append(min(n, m) >= s * max(n, m) - 1e-9 and estimate(x, y, n, m) >= least)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, "a long, b long")


def full_sets(texts: DataFrame, needed: DataFrame, shingle: int, repeats: bool) -> DataFrame:
    """(id, hashes): the whole shingle set of each needed node (id, doc, digest); another text under that doc id is left out.
    ``repeats``: whether rows repeat an id with its text."""
    import xxhash

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHash()
        for b in batches:
            sets = [shingle_hashes(t.as_py() or "", shingle, words).tobytes() for t in b.column(1)]
            own = [xxhash.xxh3_128_digest(h) == d.as_py() for h, d in zip(sets, b.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["id", "hashes"]).filter(pa.array(own, pa.bool_()))

    found = texts.join(bounded_broadcast(needed), "doc").select("id", "text", "digest").mapInArrow(run, "id long, hashes binary")
    return found.groupBy("id").agg(F.min("hashes").alias("hashes")) if repeats else found


def common_shingles(pairs: DataFrame) -> DataFrame:
    """(a, b, inter, na, nb) of pairs (a, b, ha, hb) on the full sets."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = ([np.frombuffer(x.as_py(), dtype=np.uint64) for x in b.column(c)] for c in (2, 3))
            inter = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(left, right, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), *[pa.array(c, pa.int64()) for c in (inter, [len(x) for x in left], [len(x) for x in right])]],
                names=["a", "b", "inter", "na", "nb"])

    return pairs.select("a", "b", "ha", "hb").mapInArrow(run, "a long, b long, inter long, na long, nb long")


def finish_block(similarity: tuple[int, int]):
    """The function of one block pair of a bucket: rows (id, label, minor, dist, hashes, side) -> links (a, b) between
    different labels that are not joined yet."""
    far = 1 - similarity[0] / similarity[1] + 1e-9

    def run(table: pa.Table) -> pa.Table:
        found: list[tuple[int, int]] = []
        ids, label, dist = table["id"].to_pylist(), table["label"].to_pylist(), np.array(table["dist"].to_pylist(), dtype=float)
        sets = [np.frombuffer(x, dtype=np.uint64) for x in table["hashes"].to_pylist()]
        sides = table["side"].to_pylist()
        sizes = np.array([len(x) for x in sets])
        rows = [i for i, s in enumerate(sides) if s == "y"]
        if not rows or len(set(label)) < 2:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        owner = np.repeat(np.array(rows), sizes[rows])
        values = np.concatenate([sets[i] for i in rows])
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        for i in (i for i, s in enumerate(sides) if s == "x"):
            from_, to = np.searchsorted(values, sets[i], "left"), np.searchsorted(values, sets[i], "right")
            length = to - from_
            at = np.repeat(from_ - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(length.sum())
            inter = np.bincount(owner[at], minlength=len(ids))
            union = sizes + sizes[i] - inter
            near = similarity[1] * inter >= similarity[0] * union
            near &= ~(np.abs(dist - dist[i]) > far)      # a distance that is not known excludes nothing
            for j in np.flatnonzero(near):
                a, b = top(label[i]), top(label[j])
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    found.append((ids[i], ids[j]))
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def grouped_rows(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: tuple[int, int], bands: int = BANDS,
                 rows: int = ROWS) -> DataFrame:
    """(id, n, digest, component, label) for each row; component and label are null for rows without id or shingles.  Components of
    different texts may have the same smallest id, so ``label`` tells them apart."""
    sig = written(signatures(docs, id_col, text_col, shingle, bands, rows), "signatures")
    own = sig.where("id IS NOT NULL AND digest IS NOT NULL")
    reps = own.groupBy("digest").agg(F.min(F.struct("id", "n", "regs")).alias("x"))
    # numbered when written: from here on a node's number is fixed
    reps = written(reps.select("digest", F.col("x.id").alias("doc"), "x.n", "x.regs", F.monotonically_increasing_id().alias("id")), "nodes")
    repeats = not own.groupBy("id", "digest").count().where("count > 1").isEmpty()
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))

    keys = band_rows(reps, bands, rows)
    buckets = keys.groupBy("key").agg(F.min("id").alias("centre"), F.count("*").alias("members")).where("members > 1")
    members = written(keys.join(buckets, "key").where("id <> centre").select("key", "id", "n", "centre", "members"), "bucket_members")

    stars = members.select(F.col("id").alias("a"), F.col("centre").alias("b")).distinct()
    r = reps.select("id", "n", "regs")
    stars = stars.join(r.toDF("a", "na", "ra"), "a").join(r.toDF("b", "nb", "rb"), "b")
    stars = written(promising(stars, similarity), "star_pairs")
    ids = stars.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = full_sets(texts, written(reps.select("id", "doc", "digest").join(ids, "id"), "pair_ids"), shingle, repeats)
    pairs = stars.join(sets.toDF("b", "hb"), "b").join(sets.toDF("a", "ha"), "a")
    checked = written(common_shingles(pairs), "star_checks")
    num, den = similarity
    links = checked.where(F.col("inter") * den >= (F.col("na") + F.col("nb") - F.col("inter")) * num).select("a", "b")
    labels = components(links)

    # buckets whose members but the centre are in different components
    distance = checked.select(F.col("a").alias("id"), F.col("b").alias("centre"),
                              (1 - F.col("inter") / (F.col("na") + F.col("nb") - F.col("inter"))).alias("dist"))
    open_ = members.where("members > 2").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")) \
        .join(distance, ["id", "centre"], "left")
    several = open_.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.mode("label").alias("main")).where("low <> high")
    todo = written(open_.join(several.select("key", "main"), "key"), "open_buckets")
    needed = written(reps.select("id", "doc", "digest").join(todo.select("id").distinct(), "id"), "open_ids")
    more = finished(todo, full_sets(texts, needed, shingle, repeats), similarity)
    joined = more.join(labels.toDF("a", "la"), "a", "left").join(labels.toDF("b", "lb"), "b", "left") \
        .select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    known = labels.select(F.col("id").alias("a"), F.col("label").alias("b")).where("a <> b")
    final = components(known.unionByName(joined))

    # a component is named by the smallest id of its rows; nodes without links are their own
    linked_nodes = written(reps.select("id", "doc", "digest").join(final, "id"), "linked_nodes")
    least = linked_nodes.groupBy("label").agg(F.min("doc").alias("component"))
    named = linked_nodes.join(least, "label").select("digest", "component", "label")
    named = reps.select("digest", "doc", "id").join(named, "digest", "left").select(
        "digest", F.coalesce("component", "doc").alias("component"), F.coalesce("label", "id").alias("label"))
    key = F.when(F.col("id").isNotNull(), F.col("digest"))
    return sig.select("id", "n", "digest", key.alias("_key")).join(named.withColumnRenamed("digest", "_key"), "_key", "left").drop("_key")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
                    similarity: tuple[int, int] = (80, 100), bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest linked id) and kept.  ``similarity`` is a fraction
    (numerator, denominator), so that the threshold is tested on whole numbers."""
    out = grouped_rows(docs, id_col, text_col, shingle, similarity, bands, rows)
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def finished(todo: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Links between components inside open buckets: members outside the bucket's main component against all others.  Both sides are cut
    into blocks of about BLOCK shingles, each side by its own sum: a set is copied once for each block of the other side."""
    outside = F.when(F.col("label") != F.col("main"), F.col("n"))
    size = todo.groupBy("key").agg(F.ceil(F.sum("n") / F.lit(BLOCK)).cast("int").alias("ys"),
                                   F.ceil(F.coalesce(F.sum(outside), F.lit(0)) / F.lit(BLOCK)).cast("int").alias("xs"))
    todo = todo.join(size, "key")

    def block(n: str) -> Column:
        return F.pmod(F.xxhash64("id"), F.col(n)).cast("int")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    x = todo.where("label <> main").select("key", "id", "label", "dist", block("xs").alias("xb"), every("ys").alias("yb"), F.lit("x").alias("side"))
    y = todo.where("xs > 0").select("key", "id", "label", "dist", every("xs").alias("xb"), block("ys").alias("yb"), F.lit("y").alias("side"))
    return x.unionByName(y).join(sets, "id").groupBy("key", "xb", "yb").applyInArrow(finish_block(similarity), "a long, b long").distinct()


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
                         similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """One row of each group, with the columns it had (see above which); rows without shingles or id stay."""
    groups = written(grouped_rows(docs, id_col, text_col, shingle, similarity).where("component IS NOT NULL"), "near_groups")
    # ids that stand for one row alone need no look at the text; the rows of all others are told by their digest
    shared = groups.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    none = docs.where(F.col(id_col).isNull())
    ids = docs.where(F.col(id_col).isNotNull())
    on = F.col(id_col).cast("long")
    gone = bounded_broadcast(written(groups.where("id <> component").select(F.col("id").alias("_gone")).distinct(), "near_duplicates"))
    if shared.isEmpty():
        return docs.join(gone, on == gone["_gone"], "left_anti")
    shared = bounded_broadcast(written(shared.toDF("_shared"), "shared_ids"))
    alone = ids.join(shared, on == shared["_shared"], "left_anti").join(gone, on == gone["_gone"], "left_anti")
    told = with_digests(ids.join(shared, on == shared["_shared"], "left_semi"), id_col, text_col, shingle)
    best = groups.where("id = component").groupBy("label", "id").agg(F.min("digest").alias("best"))
    chosen = told.where("_digest IS NOT NULL").join(best, (F.col("_id") == F.col("id")) & (F.col("_digest") == F.col("best")))
    one = chosen.groupBy("_id", "_digest").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    rest = told.where("_digest IS NULL").select("_row").unionByName(one.select("_row"))
    return alone.unionByName(none).unionByName(rest.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns]))


def with_digests(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(_id, _digest, _row): each row with its id and the digest of its shingle set, null without shingles."""
    import xxhash

    def make():
        words = WordHash()

        def digest(text: str) -> tuple:
            h = shingle_hashes(text, shingle, words)
            return (xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None,)

        return digest

    packed = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return per_text(packed, "_id", "_text", make, "_digest binary", carry=("_row",))
