"""Long common prefixes on a Burrows-Wheeler transform, for one bounded block of strings."""

from __future__ import annotations

import numpy as np

END, CLOSE, FIRST_BYTE = 0, 1, 2        # symbols: end of the text, end of a string, byte 0
SYMBOL_BITS, PACKED = 9, 7              # seven symbols make one sort key


def suffix_order(text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank) of all suffixes by their first ``least`` symbols or more, by prefix doubling; ties in any order."""
    n = len(text)
    key = np.zeros(n, dtype=np.int64)
    for k in range(PACKED):
        key <<= SYMBOL_BITS
        key[:max(0, n - k)] |= text[k:]
    depth = PACKED
    while True:
        order = np.argsort(key)
        ranked = key[order]
        step = np.zeros(n, dtype=np.int64)
        np.cumsum(ranked[1:] != ranked[:-1], out=step[1:])
        rank = np.empty(n, dtype=np.int64)
        if step[-1] == n - 1 or depth >= least:
            rank[order] = np.arange(n)
            return order, rank
        rank[order] = step
        key = rank * (n + 1)
        key[:max(0, n - depth)] += rank[depth:] + 1
        depth *= 2


def long_repeats(strings: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, offset, group) of every place whose ``least`` bytes stand at some other place of the strings as
    well; places of one group start with the same bytes.

    Breadth-first backward extension: an interval of suffixes with a common prefix w is split by the symbol
    before each of them, which gives the intervals of all c + w.  An interval of length-l strings that closes at a border not
    seen before has found a place where neighbouring suffixes share just l - 1 symbols.  Lengths come in increasing
    order, and the search stops at ``least``: borders not found by then lie between suffixes that
    share at least so many symbols.  Prefixes that run past the end of a string are left out at the end.
    """
    none = np.empty(0, dtype=np.int64)
    if not strings:
        return none, none, none
    sizes = np.array([len(s) for s in strings], dtype=np.int64)
    ends = np.cumsum(sizes + 1) - 1                     # where each string's end mark stands
    n = int(ends[-1]) + 1
    text = np.full(n, CLOSE, dtype=np.int64)
    inside = np.ones(n, dtype=bool)
    inside[ends] = False
    text[inside] = np.frombuffer(b"".join(strings), dtype=np.uint8)
    text[inside] += FIRST_BYTE
    text[-1] = END
    order, rank = suffix_order(text, least)
    symbol = text[order - 1]                            # the transform; the first suffix is preceded by the end
    back = rank[order - 1]                              # where the suffix that is longer by that symbol stands

    border = np.zeros(n + 1, dtype=bool)                # whether the shared length of suffix and predecessor is found
    border[0] = border[n] = True
    low, high = np.array([0], dtype=np.int64), np.array([n], dtype=np.int64)
    for _ in range(least):
        if not len(low):
            break
        width = high - low
        total = int(width.sum())
        at = np.repeat(low - (np.cumsum(width) - width), width) + np.arange(total)
        which = np.repeat(np.arange(len(low)), width)
        # sorted by interval, symbol and position: each (interval, symbol) is an interval of longer strings
        both = np.sort(((which << SYMBOL_BITS) | symbol[at]) * n + back[at])
        key = both // n
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        last = np.concatenate((first[1:], [total])) - 1
        new_low, new_high = both[first] - key[first] * n, both[last] - key[last] * n + 1
        fresh = ~border[new_high]
        low, high = new_low[fresh], new_high[fresh]
        border[high] = True

    same = np.flatnonzero(~border[1:n]) + 1             # suffix i shares its first bytes with suffix i - 1
    member = np.zeros(n, dtype=bool)
    member[same] = True
    member[same - 1] = True
    places = order[member]
    group = np.cumsum(border[:n])[member]
    string = np.searchsorted(ends, places)
    offset = places - (ends[string] - sizes[string])
    whole = offset + least <= sizes[string]
    return string[whole], offset[whole], group[whole]
