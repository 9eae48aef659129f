"""Removal of long repeated byte strings, wherever in the corpus they first stood.

A byte goes if it is covered by a string of ``least`` bytes that also starts earlier (a smaller document, or
earlier in the same one); strings are judged on the texts as they come.

1. Each window of ``least`` bytes is filed under the smallest ``GRAM``-byte hash in it, its anchor.  Equal windows have equal anchors.
   Neighbouring windows with one anchor form a stretch of at most 2 x least - GRAM bytes, some 3 % as many as bytes.
2. Equal stretches are one string with several places: all places but the first are covered.  They are told by 128 bits
   of XXH3 over all their bytes, independent of the anchor's hash: among n different stretches round one anchor two are taken for one
   with odds of n^2 / 2^129 (3e-21 for a billion).  That is decided within each task first, so a passage in a third of all
   documents leaves one row per task.  An anchor with more rows than a task's even share (judged by the stretches of one document in
   ``TRIED``) is dealt out by its stretches' hashes, so its different stretches are spread over all tasks.
3. Stretches that share an anchor but differ, mostly at the edges of copied passages, get their text and are laid
   out in blocks of bounded size.  In each block the common prefixes are derived on a Burrows-Wheeler transform
   by breadth-first backward extension, stopped at ``least`` (``bwt.long_repeats``).
   Anchors with more stretches than ``HOT`` are not put into one block: their windows are grouped one by one, with
   combining before the shuffle, which gives the same result.
4. Covered stretches of each document are merged and cut out.

Defined results: null and empty texts have no bytes; texts shorter than ``least`` are kept; rows that share an id (null ids
too) count as copies of that document in a fixed order, so the first keeps its bytes and the others are judged against it;
an empty table gives no rows; only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from renewcast.llm.bwt import long_repeats
from renewcast.llm.common import BROADCAST_ROWS, bounded_broadcast, partitions, written

LEAST, GRAM = 100, 32
CHUNK = 1 << 20                 # windows worked on at a time
BLOCK_BYTES = 1_000_000         # text of one block for the transform
HOT = 2_000                     # different stretches of one anchor in a block, at most
MULTIPLIER = 0x9E3779B97F4A7C15
TRIED = 64                      # hot anchors are looked for in one document of so many
#: A place packs start (up to 54 bits) and length (9), so that places of a document sort by it.
LENGTH_BITS = 9


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def stretch_hash(part: bytes) -> bytes:
    """16 bytes that tell stretches apart."""
    return xxhash.xxh3_128_digest(part)


class Anchors:
    """Anchors of one text: arrays (hash, two halves of the stretch's hash, start, length)."""

    def __init__(self, least: int, gram: int) -> None:
        self.least, self.gram = least, gram
        most = CHUNK + least
        self.up = _powers(MULTIPLIER, most)
        self.down = _powers(pow(MULTIPLIER, -1, 2 ** 64), most + 1)
        self.value = np.random.default_rng(19730601).integers(0, 2 ** 64, size=256, dtype=np.uint64)

    def _mixed(self, x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))

    def of(self, text: bytes) -> Iterator[tuple[np.ndarray, ...]]:
        whole = np.frombuffer(text, dtype=np.uint8)
        for at in range(0, len(whole) - self.least + 1, CHUNK):
            x = whole[at:at + CHUNK + self.least - 1]
            n = len(x)
            total = np.empty(n + 1, dtype=np.uint64)
            total[0] = 0
            np.cumsum(self.value[x] * self.up[:n], out=total[1:])
            h = self._mixed((total[self.gram:] - total[:-self.gram]) * self.down[:n - self.gram + 1])
            low = (h >> np.uint64(21) << np.uint64(21)) | np.arange(len(h), dtype=np.uint64)
            have, want = 1, self.least - self.gram + 1
            while have < want:
                step = min(have, want - have)
                low = np.minimum(low[:-step], low[step:])
                have += step
            anchor = (low & np.uint64((1 << 21) - 1)).astype(np.int64)
            first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
            end = np.concatenate((first[1:], [len(anchor)])) - 1 + self.least
            digests = b"".join([stretch_hash(text[a:b]) for a, b in zip((first + at).tolist(), (end + at).tolist(), strict=True)])
            halves = np.frombuffer(digests, dtype="<i8").reshape(-1, 2)
            yield h[anchor[first]].view(np.int64), halves[:, 0], halves[:, 1], first + at, end - first


def hot_anchors(docs: DataFrame, least: int, gram: int) -> DataFrame:
    """(anchor): hashes of the anchors with more stretches than an even share of a task, judged by one document in TRIED; fewer than the
    partitions of a shuffle.  It only decides where rows go, not what is found."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Anchors(least, gram)
        for b in batches:
            for x in b.column(0):
                for h, *_ in find.of((x.as_py() or "").encode("utf-8", "replace")):
                    keys, n = np.unique(h, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["anchor", "n"])

    tried = docs.where(F.pmod(F.xxhash64("doc", "copy"), F.lit(TRIED)) == 0).select("text")
    counts = written(tried.mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")), "tried_anchors")
    total = counts.agg(F.sum("n")).first()[0] or 0
    share = max(HOT // TRIED, total // partitions(docs.sparkSession))
    return written(counts.where(F.col("n") > share).select("anchor"), "hot_anchors")


def stretches(docs: DataFrame, least: int, gram: int, hot: frozenset[int] = frozenset()) -> DataFrame:
    """(route, s1, s2, sure, anchor, doc, copy, place): a row for each stretch, dealt out by its anchor's hash, or by its own
    if the anchor is ``hot``.  Where an equal stretch stands earlier in the same batch, it is ``sure`` and dealt out by its place."""
    names = ["route", "s1", "s2", "sure", "anchor", "doc", "copy", "place"]
    salted = np.array(sorted(hot), dtype=np.int64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Anchors(least, gram)
        for b in batches:
            parts, docs_, copies = [], b.column(0).to_numpy(), b.column(1).to_numpy()
            held = 0

            def out() -> pa.RecordBatch:
                h, s1, s2, doc, copy, place = (np.concatenate(c) for c in zip(*parts))
                by = np.lexsort((place, copy, doc, s2, s1, h))
                h, s1, s2, doc, copy, place = (x[by] for x in (h, s1, s2, doc, copy, place))
                sure = np.concatenate(([False], (h[1:] == h[:-1]) & (s1[1:] == s1[:-1]) & (s2[1:] == s2[:-1])))
                route = np.where(np.isin(h, salted), h ^ s1, h) if len(salted) else h
                route = np.where(sure, (place * 7919 + doc) * 1_000_003, route)
                return pa.RecordBatch.from_arrays([pa.array(c) for c in (route, s1, s2, sure, h, doc, copy, place)], names=names)

            for i in range(b.num_rows):
                text = (b.column(2)[i].as_py() or "").encode("utf-8", "replace")
                for h, s1, s2, start, length in find.of(text):
                    n = len(h)
                    parts.append((h, s1, s2, np.full(n, docs_[i], dtype=np.int64), np.full(n, copies[i], dtype=np.int64),
                                  (start << LENGTH_BITS) | length))
                    held += n
                    if held > 300_000:
                        yield out()
                        parts, held = [], 0
            if parts:
                yield out()

    return docs.mapInArrow(run, "route long, s1 long, s2 long, sure boolean, anchor long, doc long, copy long, place long")


def compare_stretches(rows: DataFrame, hot: frozenset[int] = frozenset()) -> DataFrame:
    """(open, hash, doc, copy, place): covered stretches (open false), and the first of each of several different stretches of an
    anchor (open true); stretches whose anchor stands nowhere else are left out.  The stretches of a ``hot`` anchor are all open: they meet
    in many tasks."""
    names = ["open", "hash", "doc", "copy", "place"]
    salted = np.array(sorted(hot), dtype=np.int64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[int] | None = None                      # the last distinct stretch, not yet given out
        paired = False                                     # whether its anchor had another one before
        for b in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            sure = columns.pop(3)
            known = [x[sure] for x in columns]
            rest = [x[~sure] for x in columns]
            if held is not None:
                rest = [np.concatenate((np.array([v], dtype=np.int64), x)) for v, x in zip(held, rest, strict=True)]
            opened = covered = np.empty(0, dtype=np.int64)
            if len(rest[0]):
                route, s1, s2, h = rest[:4]
                other = h[1:] != h[:-1]
                new = np.concatenate(([True], other | (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])))
                covered = np.flatnonzero(~new)
                distinct = np.flatnonzero(new)
                same = h[distinct[1:]] == h[distinct[:-1]]
                pair = np.concatenate(([paired], same)) | np.concatenate((same, [False]))
                if len(salted):
                    pair |= np.isin(h[distinct], salted)
                last = distinct[-1]
                opened = distinct[:-1][pair[:-1]]
                held, paired = [int(x[last]) for x in rest], bool(pair[-1])
            flags = np.zeros(len(opened) + len(covered) + len(known[0]), dtype=bool)
            flags[:len(opened)] = True
            out = [np.concatenate((x[opened], x[covered], k)) for x, k in zip(rest[3:], known[3:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (flags, *out)], names=names)
        if held is not None and paired:
            yield pa.RecordBatch.from_arrays([pa.array([True]), *[pa.array([x], pa.int64()) for x in held[3:]]], names=names)

    # within a partition the rows of an anchor stand together whatever their route
    dealt = rows.repartition("route").sortWithinPartitions("anchor", "s1", "s2", "doc", "copy", "place")
    return dealt.mapInArrow(run, "open boolean, hash long, doc long, copy long, place long")


def _touched(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """The documents that a list names, without a shuffle where the lists were counted to be few; else all of them."""
    if lists.count() > BROADCAST_ROWS:
        return docs
    return docs.join(F.broadcast(lists.select("doc", "copy")), ["doc", "copy"], "left_semi")


def with_texts(open_: DataFrame, docs: DataFrame) -> DataFrame:
    """(hash, doc, copy, start, part): the bytes of each open stretch."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, d, c, st, parts = [], [], [], [], []
            for i in range(b.num_rows):
                doc, copy, spots = b.column(0)[i].as_py(), b.column(1)[i].as_py(), b.column(3)[i].as_py()
                text = (b.column(2)[i].as_py() or "").encode("utf-8", "replace")
                for spot in spots:
                    start, length = spot["place"] >> LENGTH_BITS, spot["place"] & ((1 << LENGTH_BITS) - 1)
                    h.append(spot["hash"])
                    d.append(doc)
                    c.append(copy)
                    st.append(start)
                    parts.append(text[start:start + length])
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(d, pa.int64()), pa.array(c, pa.int64()),
                                              pa.array(st, pa.int64()), pa.array(parts, pa.binary())],
                                             names=["hash", "doc", "copy", "start", "part"])

    lists = written(open_.groupBy("doc", "copy").agg(F.collect_list(F.struct("hash", "place")).alias("spots")), "open_places")
    joined = _touched(docs, lists).join(lists, ["doc", "copy"]).select("doc", "copy", "text", "spots")
    return joined.mapInArrow(run, "hash long, doc long, copy long, start long, part binary")


def block_repeats(least: int):
    """The function of one block: rows (doc, copy, start, part) -> covered spans (doc, copy, start, end)."""
    def run(table: pa.Table) -> pa.Table:
        doc, copy, start = (table[c].to_numpy() for c in ("doc", "copy", "start"))
        string, offset, group = long_repeats([p.as_py() for p in table["part"]], least)
        doc, copy, at = doc[string], copy[string], start[string] + offset
        by = np.lexsort((at, copy, doc, group))
        doc, copy, at, group = doc[by], copy[by], at[by], group[by]
        later = np.concatenate(([False], group[1:] == group[:-1])) if len(group) else np.empty(0, dtype=bool)
        doc, copy, at = doc[later], copy[later], at[later]
        by = np.lexsort((at, copy, doc))                 # windows that follow each other make one span
        doc, copy, at = doc[by], copy[by], at[by]
        if len(at):
            first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (copy[1:] != copy[:-1]) | (at[1:] > at[:-1] + least))))
            last = np.concatenate((first[1:], [len(at)])) - 1
            doc, copy, start_, end = doc[first], copy[first], at[first], at[last] + least
        else:
            start_ = end = at
        return pa.table({k: pa.array(v, pa.int64()) for k, v in (("doc", doc), ("copy", copy), ("start", start_), ("end", end))})

    return run


def hot_repeats(parts: DataFrame, least: int) -> DataFrame:
    """Covered windows of stretches whose anchor has very many: each window is a key, combined before the shuffle."""
    w = parts.select("doc", "copy", "start", F.posexplode(F.transform(
        F.sequence(F.lit(1), F.octet_length("part") - (least - 1)), lambda i: F.substring("part", i, F.lit(least)))).alias("i", "window")) \
        .select("doc", "copy", (F.col("start") + F.col("i")).alias("start"), F.xxhash64("window").alias("k1"),
                F.xxhash64(F.lit(1), "window").alias("k2"))
    first = w.groupBy("k1", "k2").agg(F.min(F.struct("doc", "copy", "start")).alias("first"), F.count("*").alias("n")).where("n > 1")
    hit = w.join(first, ["k1", "k2"]).where(F.struct("doc", "copy", "start") != F.col("first"))
    return hit.select("doc", "copy", "start", (F.col("start") + least).alias("end"))


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, copy, text, _row): copy counts the rows that share an id, in the order of a hash; a null id is the
    smallest; _row has the columns but the text.  Rows are ranked within (id, block of hashes) and blocks are offset by their counts, so
    no id's rows meet in one task."""
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col])
    d = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-2 ** 63)).alias("doc"), rest.alias("_row"), F.col(text_col).alias("text"))
    twice = d.groupBy("doc").count().where("count > 1").select("doc")
    if twice.isEmpty():
        return d.withColumn("copy", F.lit(0).cast("long"))
    d = written(d.withColumn("_at", F.monotonically_increasing_id()), "documents_by_row")        # row numbers are fixed from here on
    twice = written(twice, "repeated_ids")
    keys = d.select("doc", "_at").join(twice, "doc", "left_semi").withColumn("_h", F.xxhash64("_at")).withColumn("_b", F.pmod("_h", F.lit(4096)))
    blocks = keys.groupBy("doc", "_b").count()
    blocks = blocks.select("doc", "_b", (F.sum("count").over(Window.partitionBy("doc").orderBy("_b")) - F.col("count")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("doc", "_b").orderBy("_h", "_at")) - 1
    ranked = keys.withColumn("_place", place).join(blocks, ["doc", "_b"]).select("_at", (F.col("_before") + F.col("_place")).cast("long").alias("_copy"))
    return written(d.join(ranked, "_at", "left").select("doc", "_row", "text", F.coalesce("_copy", F.lit(0).cast("long")).alias("copy")),
                   "numbered_documents")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, gram: int = GRAM,
                   whole_characters: bool = False, whole_rows: bool = False) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (the remaining bytes).

    ``whole_characters`` shrinks each removed run to whole UTF-8 characters, so that the rest is text.
    ``whole_rows`` returns the columns of ``docs`` instead, with the remaining text.
    """
    if not whole_rows:
        docs = docs.select(id_col, text_col)
    d = numbered(docs, id_col, text_col)
    texts = d.select("doc", "copy", "text")
    # fewer than the shuffle's partitions: each has more than an even share
    spread = frozenset(r["anchor"] for r in hot_anchors(texts, least, gram).collect())
    found = written(compare_stretches(stretches(texts, least, gram, spread), spread), "stretches")
    places = found.where("NOT open").select("doc", "copy", F.shiftright("place", LENGTH_BITS).alias("start"),
                                            F.col("place").bitwiseAND(F.lit(2 ** LENGTH_BITS - 1)).alias("length"))
    spans = places.select("doc", "copy", "start", (F.col("start") + F.col("length")).alias("end"))

    parts = written(with_texts(found.where("open"), texts), "open_texts")
    counts = written(parts.groupBy("hash").agg(F.count("*").alias("n"), F.sum(F.octet_length("part")).alias("bytes")), "anchor_counts")
    size = counts.where(F.col("n") <= HOT).agg(F.sum("bytes")).first()[0] or 0
    hot = written(counts.where(F.col("n") > HOT).select("hash"), "hot_anchors")
    some = not hot.isEmpty()
    usual = parts.join(bounded_broadcast(hot), "hash", "left_anti") if some else parts
    block = F.pmod(F.xxhash64("hash"), F.lit(size // BLOCK_BYTES + partitions(docs.sparkSession)))
    spans = spans.unionByName(usual.groupBy(block.alias("block")).applyInArrow(block_repeats(least), "doc long, copy long, start long, end long"))
    if some:
        spans = spans.unionByName(hot_repeats(parts.join(bounded_broadcast(hot), "hash", "left_semi"), least))

    lists = written(spans.groupBy("doc", "copy").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "removed_spans")
    kinds = f"_row {d.schema['_row'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary"
    if lists.count() <= BROADCAST_ROWS:
        # documents that keep all their bytes need neither a shuffle nor Python
        whole = d.join(F.broadcast(lists.select("doc", "copy")), ["doc", "copy"], "left_anti")
        text = F.coalesce(F.col("text"), F.lit(""))
        zero = F.lit(0).cast("long")
        whole = whole.select("_row", F.octet_length(text).cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"),
                             text.cast("binary").alias("kept"))
        cut = _touched(d, lists).join(lists, ["doc", "copy"]).select("_row", "text", "spans").mapInArrow(cut_out(whole_characters), kinds)
        done = whole.unionByName(cut)
    else:
        done = d.join(lists, ["doc", "copy"], "left").select("_row", "text", "spans").mapInArrow(cut_out(whole_characters), kinds)
    if whole_rows:
        return done.select(*[F.col("kept").cast("string").alias(c) if c == text_col else F.col(f"_row.`{c}`") for c in docs.columns])
    return done.select(F.col(f"_row.`{id_col}`"), "n_bytes", "n_removed", "n_spans", "kept")


def cut_out(whole_characters: bool):
    """The function that merges a document's spans and removes them."""
    def one(text: bytes, spans: list[dict[str, int]] | None) -> tuple[int, int, bytes]:
        if not spans:
            return 0, 0, text
        runs: list[list[int]] = []
        for start, end in sorted((s["start"], s["end"]) for s in spans):
            if runs and start <= runs[-1][1]:
                runs[-1][1] = max(end, runs[-1][1])
            else:
                runs.append([start, end])
        if whole_characters:
            for r in runs:
                while r[0] < r[1] and text[r[0]] & 0xC0 == 0x80:
                    r[0] += 1
                while r[0] < r[1] < len(text) and text[r[1]] & 0xC0 == 0x80:
                    r[1] -= 1
            runs = [r for r in runs if r[0] < r[1]]
        parts, at = [], 0
        for start, end in runs:
            parts.append(text[at:start])
            at = end
        parts.append(text[at:])
        return sum(e - s for s, e in runs), len(runs), b"".join(parts)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, removed, runs, kept = [], [], [], []
            for i in range(b.num_rows):
                text = (b.column(1)[i].as_py() or "").encode("utf-8", "replace")
                n, k, rest = one(text, b.column(2)[i].as_py())
                size.append(len(text))
                removed.append(n)
                runs.append(k)
                kept.append(rest)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in (size, removed, runs)], pa.array(kept, pa.binary())],
                                             names=["_row", "n_bytes", "n_removed", "n_spans", "kept"])

    return run
