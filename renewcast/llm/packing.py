"""Best-fit packing of tokenised documents by a grouping genetic algorithm on islands.

Documents become pieces of at most ``capacity`` tokens (only longer documents are cut).  Pieces are dealt into blocks of about
``BLOCK``; each block is packed by several islands, each a task of its own with its own population.  A solution is a set of
bins.  Crossover copies well-filled whole bins of one parent into the other, drops the other's bins that
hold a piece twice, and puts the pieces so displaced back by best fit, largest first.  After each round
an island's best solutions migrate to the next island of its block.  An island stops where the number of bins
reaches the lower bound (tokens / capacity).  Bins that stay below ``FULL`` of the capacity are taken apart, and their
pieces are dealt into new blocks and packed once more, so that the many blocks do not leave one slack bin each.

Token counts come from a public tokenizer, its path a parameter.  The ids of words are remembered per
task.  Texts with characters for which splitting here is not known to equal the
tokenizer's own go to the tokenizer whole.

Defined results: null and empty texts are one piece of the end token; rows that share an id, or repeat, are pieces
of their own; blocks are dealt by a row's place in the written table, so no id and no number of copies makes a block large; an
empty table gives no rows; only id and text are read.
"""

from __future__ import annotations

import random
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from renewcast.llm.common import written

CAPACITY = 4096
BLOCK = 2000
ISLANDS, ROUNDS, GENERATIONS, POPULATION, ELITE = 3, 2, 12, 4, 2
FULL = 0.97
END_TOKEN = 1

#: Texts of these characters alone are split here; all others go to the tokenizer whole.
SIMPLE = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*")
#: The tokenizer's own pieces of such a text in lower case (no piece crosses white space).
PIECES = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^\sa-zß-öø-ÿ0-9]+")
KNOWN = 250_000            # chunks, and pieces, whose ids a task remembers


class _Remembered(dict):
    """key -> bytes, made on first use; forgets all when it is full."""

    def __init__(self, make: Callable[[str], bytes]) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> bytes:
        if len(self) >= KNOWN:
            self.clear()
        value = self[key] = self.make(key)
        return value


class Encoder:
    """text -> ids as little-endian 32-bit bytes, without the end token.

    A simple text is cut at white space; the ids of a chunk are those of its pieces, and the ids of a piece come
    from the tokenizer's model.  Both are remembered.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        model = self.tokenizer.model
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        # the model reads a byte as a character of its own
        as_bytes = {k: level.pre_tokenize_str(chr(k))[0][0] for k in range(33, 256) if SIMPLE.fullmatch(chr(k))}

        def piece_ids(piece: str) -> bytes:
            return np.array([t.id for t in model.tokenize(piece.translate(as_bytes))], dtype="<u4").tobytes()

        pieces = _Remembered(piece_ids)
        self.chunks = _Remembered(lambda chunk: b"".join(map(pieces.__getitem__, PIECES.findall(chunk))))

    def encode(self, text: str) -> bytes:
        if SIMPLE.fullmatch(text) and "<|" not in text:
            return b"".join(map(self.chunks.__getitem__, text.lower().split()))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) for every piece."""
    names = [id_col, "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        end = np.array([END_TOKEN], dtype="<u4").tobytes()
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, text in enumerate(part.column(1)):
                    data = encoder.encode(text.as_py() or "") + end
                    for k, from_ in enumerate(range(0, len(data), 4 * capacity)):
                        cut = data[from_:from_ + 4 * capacity]
                        row.append(i)
                        piece.append(k)
                        start.append(from_ // 4)
                        length.append(len(cut) // 4)
                        crc.append(zlib.crc32(cut))
                        if with_ids:
                            ids.append(cut)
                columns = [part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                           *[pa.array(c, pa.int64()) for c in (start, length, crc)]]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.binary())] * with_ids, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(
        run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


# ------------------------------------------------------------------ the genetic algorithm, for one block

Bins = list[list[int]]


def best_fit(lengths: list[int], order: Iterable[int], bins: Bins, capacity: int) -> Bins:
    """Puts the items in the given order each into the fullest bin that takes it, else a new one; changes ``bins``."""
    free = sorted((capacity - sum(lengths[i] for i in b), k) for k, b in enumerate(bins))
    for i in order:
        size = lengths[i]
        at = bisect_left(free, (size, -1))
        if at == len(free):
            left, k = capacity, len(bins)
            bins.append([])
        else:
            left, k = free.pop(at)
        bins[k].append(i)
        if left > size:
            insort(free, (left - size, k))
    return bins


def fitness(lengths: list[int], bins: Bins, capacity: int) -> tuple[int, float]:
    """Smaller is better: bins, then minus the mean squared fill."""
    return len(bins), -sum((sum(lengths[i] for i in b) / capacity) ** 2 for b in bins) / max(1, len(bins))


def crossover(lengths: list[int], receiver: Bins, giver: Bins, capacity: int, rng: random.Random) -> Bins:
    fill = {k: sum(lengths[i] for i in b) for k, b in enumerate(giver)}
    good = sorted(fill, key=lambda k: (-fill[k], k))[:max(1, len(giver) // 2)]
    injected = [giver[k] for k in sorted(rng.sample(good, max(1, len(good) // 2)))]
    inside = {i for b in injected for i in b}
    kept: Bins = []
    displaced: list[int] = []
    for b in receiver:
        if inside.isdisjoint(b):
            kept.append(list(b))
        else:
            displaced += [i for i in b if i not in inside]
    displaced.sort(key=lambda i: (-lengths[i], i))
    return best_fit(lengths, displaced, [list(b) for b in injected] + kept, capacity)


def mutate(lengths: list[int], bins: Bins, capacity: int, rng: random.Random) -> Bins:
    """Takes the slackest bins and a few others apart and puts their items back by best fit."""
    by_fill = sorted(range(len(bins)), key=lambda k: sum(lengths[i] for i in bins[k]))
    out = set(by_fill[:2]) | set(rng.sample(range(len(bins)), min(len(bins), 1 + len(bins) // 20)))
    loose = sorted((i for k in out for i in bins[k]), key=lambda i: (-lengths[i], i))
    return best_fit(lengths, loose, [list(b) for k, b in enumerate(bins) if k not in out], capacity)


def numbers(bins: Bins, n: int) -> list[int]:
    out = [0] * n
    for k, b in enumerate(bins):
        for i in b:
            out[i] = k
    return out


def as_bins(assignment: Iterable[int]) -> Bins:
    found: dict[int, list[int]] = {}
    for i, k in enumerate(assignment):
        found.setdefault(k, []).append(i)
    return list(found.values())


def evolve(lengths: list[int], population: list[list[int]], capacity: int, seed: int, generations: int = GENERATIONS,
           size: int = POPULATION) -> list[list[int]]:
    """One round on one island: the population, best first, as bin numbers of the items."""
    rng = random.Random(seed)
    least = -(-sum(lengths) // capacity)
    falling = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    people = [as_bins(p) for p in population] or [best_fit(lengths, falling, [], capacity)]
    rank = lambda b: fitness(lengths, b, capacity)
    people.sort(key=rank)
    if len(people[0]) > least:
        while len(people) < size:
            noisy = sorted(falling, key=lambda i: -lengths[i] * rng.uniform(0.9, 1.1))
            people.append(best_fit(lengths, noisy, [], capacity))
        for _ in range(generations):
            a, b = rng.sample(range(len(people)), 2)
            young = [crossover(lengths, people[a], people[b], capacity, rng), crossover(lengths, people[b], people[a], capacity, rng),
                     mutate(lengths, people[0], capacity, rng)]
            people = sorted(people + young, key=rank)[:size]
            if len(people[0]) <= least:
                break
    return [numbers(b, len(lengths)) for b in people[:size]]


# ------------------------------------------------------------------ on Spark

def _round(rows: DataFrame, capacity: int, number: int) -> DataFrame:
    """Rows (block, island, lengths, population) after one round; bins and slack rate the best solution."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                people = evolve(r["lengths"], r["population"] or [], capacity, r["block"] * 1009 + r["island"] * 31 + number)
                bins, slack = fitness(r["lengths"], as_bins(people[0]), capacity)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["block"]], pa.int64()), pa.array([r["island"]], pa.int32()), pa.array([r["lengths"]], pa.list_(pa.int32())),
                     pa.array([people], pa.list_(pa.list_(pa.int32()))), pa.array([bins], pa.int32()), pa.array([slack], pa.float64())],
                    names=["block", "island", "lengths", "population", "bins", "slack"])

    return rows.select("block", "island", "lengths", "population").mapInArrow(
        run, "block long, island int, lengths array<int>, population array<array<int>>, bins int, slack double")


def pack(pieces: DataFrame, capacity: int = CAPACITY, level: int = 0, block: int = BLOCK) -> DataFrame:
    """The written pieces with sequence_id, offset and fill, by one level of blocks; other columns are carried along."""
    blocks = max(1, -(-pieces.count() // block))
    number = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks))
    dealt = written(pieces.withColumn("_block", number).groupBy("_block").agg(
        F.sort_array(F.collect_list(F.struct(*pieces.columns))).alias("items")), f"pack_blocks_{level}")
    # pieces that fill a sequence by themselves take no part in the search
    lengths = F.filter(F.col("items.length"), lambda x: x < capacity).cast("array<int>")
    state = dealt.select(F.col("_block").alias("block"), lengths.alias("lengths"),
                         F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island")) \
        .withColumn("population", F.lit(None).cast("array<array<int>>"))
    for r in range(ROUNDS):
        state = written(_round(state.repartition("block", "island"), capacity, r), f"pack_islands_{level}")
        if r + 1 < ROUNDS:                      # the best of each island go to the next one of its block
            guests = state.select("block", ((F.col("island") + 1) % ISLANDS).alias("island"), F.slice("population", 1, ELITE).alias("guests"))
            state = state.join(guests, ["block", "island"]).withColumn("population", F.concat("population", "guests"))
    best = state.groupBy("block").agg(F.min_by(F.col("population")[0], F.struct("bins", "slack", "island")).alias("assignment"))

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                number, assignment = b.column(0)[k].as_py(), b.column(2)[k].as_py()
                items = b.column(1)[k].values
                lengths = items.field("length").to_numpy(zero_copy_only=False)
                loose = iter(assignment)
                bins = [next(loose) if n < capacity else None for n in lengths.tolist()]
                used = 1 + max((x for x in bins if x is not None), default=-1)
                for i, x in enumerate(bins):
                    if x is None:
                        bins[i], used = used, used + 1
                fill = [0] * used
                offsets = []
                for x, n in zip(bins, lengths.tolist(), strict=True):
                    offsets.append(fill[x])
                    fill[x] += n
                ids = [(level << 60) | (number << 20) | x for x in bins]
                yield pa.RecordBatch.from_arrays(
                    [*items.flatten(), pa.array(ids, pa.int64()), pa.array(offsets, pa.int64()), pa.array([fill[x] for x in bins], pa.int64())],
                    names=[*[items.type.field(i).name for i in range(items.type.num_fields)], "sequence_id", "offset", "fill"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return dealt.select(F.col("_block").alias("block"), "items").join(best, "block").select("block", "items", "assignment") \
        .mapInArrow(place, f"{kinds}, sequence_id long, offset long, fill long")


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id and offset."""
    pieces = written(token_pieces(docs, tokenizer, id_col, text_col, capacity), "pieces")
    names = pieces.columns
    first = written(pack(pieces, capacity), "packed")
    slack = F.col("fill") < FULL * capacity
    again = pack(written(first.where(slack).select(*names), "slack_pieces"), capacity, level=1)
    return first.where(~slack).unionByName(again).select(*names, "sequence_id", "offset")


def sequences(docs: DataFrame, placed: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
              capacity: int = CAPACITY) -> DataFrame:
    """(sequence_id, ids as little-endian 32-bit bytes) of placed pieces; documents need distinct ids here."""
    ids = token_pieces(docs, tokenizer, id_col, text_col, capacity, with_ids=True).select(id_col, "piece", "ids")
    whole = placed.join(ids, [id_col, "piece"]).groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("x"))
    return whole.select("sequence_id", F.aggregate(F.col("x.ids"), F.expr("CAST('' AS binary)"), lambda a, x: F.concat(a, x)).alias("ids"))
