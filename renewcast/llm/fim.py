"""Fill-in-the-middle transformation: whole texts cut at two token boundaries and put in another order.

Tokens are runs of ASCII letters and single other characters.  Each text is coded as a sequence of character classes, held as a
wavelet matrix.  The classes tell the first letter of a run from the later ones, so the
tokens that start before a position are the characters before it less two ranks there, those of the two continuing
classes.  Bisection on that count finds the position of a cut.

Which boundaries are cut, and which form is written, follow from a hash of the id, so a text comes out alike in every run and
partition.  A text that is empty or holds a marker stays plain, which makes ``restored`` exact: no marker can arise where
two pieces meet, as no marker's end is the start of another.

Defined results: a null text is empty; a null id hashes as the text ``null``; empty texts are plain with 0 tokens; rows are
transformed one by one, so repeated rows repeat; an empty table gives no rows; only id and text are read.  A text needs about six
bytes a character while it is worked on.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type, to_arrow_type
from pyspark.sql.types import StructField, StructType

from renewcast.llm.common import key_of

PLAIN_PERCENT, SPM_PERCENT = 10, 20
#: Before the prefix, the suffix and the middle.
MARKERS = ("<P>", "<S>", "<M>")
CHUNK = 1 << 20
ROWS = 500      # texts of one batch that goes back to Spark

#: Classes; the first two continue a run of letters, all others start a token.
LOWER_ON, UPPER_ON, LOWER, UPPER, DIGIT, SPACE, SIGN, OTHER = range(8)
_CLASS = np.full(129, SIGN, dtype=np.uint8)
_CLASS[128] = OTHER
_CLASS[list(b" \t\n\r\x0b\x0c")] = SPACE
_CLASS[ord("0"):ord("9") + 1] = DIGIT
_CLASS[ord("a"):ord("z") + 1] = LOWER
_CLASS[ord("A"):ord("Z") + 1] = UPPER


def character_classes(text: str) -> np.ndarray:
    """The class of every code point of the text."""
    out = np.empty(len(text), dtype=np.uint8)
    letter_before = False
    for at in range(0, len(text), CHUNK):
        points = np.frombuffer(text[at:at + CHUNK].encode("utf-32-le", "surrogatepass"), dtype="<u4")
        x = _CLASS[np.minimum(points, 128)]
        letter = (x == LOWER) | (x == UPPER)
        x[1:][letter[1:] & letter[:-1]] -= LOWER - LOWER_ON
        if letter[0] and letter_before:
            x[0] -= LOWER - LOWER_ON
        out[at:at + len(x)] = x
        letter_before = bool(letter[-1])
    return out


class WaveletMatrix:
    """A sequence of symbols below 2 ** ``bits`` with ranks in ``bits`` steps.

    Level by level, from the highest bit, the symbols' bits are kept and the symbols dealt stably to zeros and ones.  Each level
    is 64-bit words and the ones before every word.
    """

    def __init__(self, symbols: np.ndarray, bits: int = 3) -> None:
        self.n, self.bits = len(symbols), bits
        self.words: list[np.ndarray] = []
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(bits - 1, -1, -1):
            bit = (symbols >> level & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros(len(packed) // 8 + 1, dtype="<u8")
            words.view(np.uint8)[:len(packed)] = packed
            ones = np.zeros(len(words) + 1, dtype=np.int64)
            np.cumsum(np.bitwise_count(words), out=ones[1:])
            self.words.append(words)
            self.ones.append(ones)
            self.zeros.append(self.n - int(ones[-1]))
            symbols = np.concatenate((symbols[~bit], symbols[bit]))

    def _rank1(self, level: int, i: int) -> int:
        return int(self.ones[level][i >> 6]) + (int(self.words[level][i >> 6]) & ((1 << (i & 63)) - 1)).bit_count()

    def rank(self, symbol: int, i: int, levels: int | None = None) -> int:
        """How many of the first ``i`` symbols equal ``symbol``, compared by their highest ``levels`` bits (default: all)."""
        low = 0
        for level in range(self.bits if levels is None else levels):
            a, b = self._rank1(level, low), self._rank1(level, i)
            if symbol >> (self.bits - 1 - level) & 1:
                low, i = self.zeros[level] + a, self.zeros[level] + b
            else:
                low, i = low - a, i - b
        return i - low


class Boundaries:
    """The tokens of one text, counted and found by ranks."""

    def __init__(self, text: str) -> None:
        self.matrix = WaveletMatrix(character_classes(text))
        self.n = self.before(self.matrix.n)

    def before(self, i: int) -> int:
        """Tokens that start before position ``i``: all characters but those that continue a run.  LOWER_ON and UPPER_ON share
        all bits but the last, so both ranks are one of two levels."""
        return i - self.matrix.rank(LOWER_ON, i, levels=2)

    def after_tokens(self, k: int, low: int = 0) -> int:
        """Where the first ``k`` tokens end, which is not before ``low``; bisection on the count."""
        if k >= self.n:
            return self.matrix.n
        high = self.matrix.n - 1
        while low < high:                               # the last position that k tokens start before
            mid = (low + high + 1) // 2
            if self.before(mid) <= k:
                low = mid
            else:
                high = mid - 1
        return low


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain_percent: int = PLAIN_PERCENT,
                   spm_percent: int = SPM_PERCENT, markers: Sequence[str] = MARKERS) -> DataFrame:
    """One row per document: id, n (tokens), form (plain, psm or spm), prefix_chars and middle_chars (null if plain) and output.

    psm is prefix, suffix, middle; spm is suffix, prefix, middle, each behind its marker.  ``markers`` must start with a sign that stands
    nowhere else in them and be of one length, which keeps them apart from the texts around them.
    """
    p, s, m = markers
    if len({len(x) for x in markers}) != 1 or len(set(markers)) != 3 or any(x[0] in "".join(y[1:] for y in markers) for x in markers):
        raise ValueError(f"markers that could arise across pieces: {markers}")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), key_of(F.col(id_col))), 256)
    number = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]
    keyed = docs.select(F.col(text_col).alias("_text"), F.array(*number).alias("_hash"), F.col(id_col))
    out = pa.schema([(id_col, to_arrow_type(docs.schema[id_col].dataType)), ("n", pa.int64()), ("form", pa.string()),
                     ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])

    def transform(text: str, h: Sequence[int]) -> tuple:
        tokens = Boundaries(text)
        n = tokens.n
        if not text or p in text or s in text or m in text or h[2] % 100 >= 100 - plain_percent:
            return n, "plain", None, None, text
        one, two = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        first = tokens.after_tokens(one)
        second = tokens.after_tokens(two, first)
        prefix, middle, suffix = text[:first], text[first:second], text[second:]
        if h[3] % 100 < spm_percent:
            return n, "spm", first, second - first, "".join((s, suffix, p, prefix, m, middle))
        return n, "psm", first, second - first, "".join((p, prefix, s, suffix, m, middle))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                texts, hashes = part.column(0), part.column(1)
                rows = [transform(texts[i].as_py() or "", hashes[i].as_py()) for i in range(part.num_rows)]
                columns = [pa.array(c, type=f.type) for c, f in zip(zip(*rows), list(out)[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(2), *columns], schema=out)

    schema = StructType([docs.schema[id_col], *[StructField(f.name, from_arrow_type(f.type)) for f in list(out)[1:]]])
    return keyed.mapInArrow(run, schema)


def restored(output: Column, form: Column, markers: Sequence[str] = MARKERS) -> Column:
    """The text an output was made of."""
    p, s, m = markers
    size = len(p)

    def after(mark: str, until: str | None = None) -> Column:
        start = F.locate(mark, output) + size
        rest = F.substring(output, start, F.length(output))
        return rest if until is None else F.substring(output, start, F.locate(until, output) - start)

    return F.when(form == "psm", F.concat(after(p, s), after(m), after(s, m))) \
        .when(form == "spm", F.concat(after(p, m), after(m), after(s, p))).otherwise(output)
