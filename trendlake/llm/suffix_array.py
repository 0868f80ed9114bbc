"""Suffix array by induced sorting and permuted common prefixes, mostly in numpy passes.

Suffixes are classified as smaller (S) or larger (L) than their right neighbour.  The
substrings between leftmost-smaller places get names by their order; if a name occurs
twice, the text of names is sorted by the same routine.  The sorted leftmost-smaller
suffixes then induce all others.  Over a byte alphabet the passes work on whole arrays:
within one first-symbol bucket all suffixes that are known at a time induce theirs
together.  A text of names has about as many buckets as symbols, so there a pass takes
one step for each suffix.  The order is exact, whatever the text repeats.
"""

from __future__ import annotations

from array import array

import numpy as np

#: Alphabets up to this size are induced bucket by bucket.
NARROW = 512


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes of ``text``: integers from 0; the last one is 0 and occurs only there."""
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64)
    smaller = _types(text)
    lms = (np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1).astype(np.int32)
    names, different = _names(text, smaller, lms)
    order = np.argsort(names, kind="stable") if different == len(lms) else suffix_array(names)
    return (_induce if int(text.max()) < NARROW else _induce_wide)(text, smaller, lms[order])


def _types(text: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than the one after them (S), False for larger ones (L)."""
    n = len(text)
    at = np.where(text[1:] != text[:-1], np.arange(n - 1, dtype=np.int32), np.int32(n))
    np.minimum.accumulate(at[::-1], out=at[::-1])  # where the next step is (the last one is never 0)
    smaller = np.ones(n, bool)
    smaller[:-1] = (text[1:] > text[:-1])[at]
    return smaller


def _refine(rank: np.ndarray, tied: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Split the groups of equal ``rank`` (the place of the group's first item) among ``tied`` by ``key``; what is still tied."""
    held = rank[tied]
    order = np.argsort(key) if held.min() == held.max() else np.lexsort((key, held))
    items, key, old = tied[order], key[order], held[order]
    new_group = np.concatenate([[True], old[1:] != old[:-1]])
    new_key = new_group | np.concatenate([[True], key[1:] != key[:-1]])
    place = np.arange(len(items), dtype=np.int32)
    group_at = np.maximum.accumulate(np.where(new_group, place, 0))
    key_at = np.maximum.accumulate(np.where(new_key, place, 0))
    rank[items] = old + (key_at - group_at)
    alone = new_key & np.concatenate([new_key[1:], [True]])
    return items[~alone]


def _names(text: np.ndarray, smaller: np.ndarray, lms: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers of the leftmost-smaller substrings in their order (equal substrings share one), and how many there are."""
    bits = int(2 * int(text.max()) + 2).bit_length()
    at_once = 63 // bits  # (symbol, type) pairs that fit in one word
    keys = np.zeros(len(text) + at_once, np.uint32)
    keys[:len(text)] = 2 * text.astype(np.uint32) + smaller
    keys += 1
    ends = np.append(lms[1:], np.int32(len(text) - 1)) + np.int32(1)  # a substring ends with the first symbol of the next one
    rank = np.zeros(len(lms), np.int32)
    tied = np.arange(len(lms), dtype=np.int32)
    offset = np.int32(0)
    while len(tied):
        starts, stops = lms[tied] + offset, ends[tied]
        word = np.zeros(len(tied), np.uint64)
        for k in range(at_once):
            word = (word << np.uint64(bits)) | np.where(starts + k < stops, keys[np.minimum(starts + k, len(text))], np.uint64(0))
        tied = _refine(rank, tied, word)
        offset = np.int32(offset + at_once)
        tied = tied[_any_open(rank[tied], ends[tied] > lms[tied] + offset)]
    used = np.zeros(len(lms), bool)
    used[rank] = True
    return (np.cumsum(used, dtype=np.int32) - np.int32(1))[rank], int(np.count_nonzero(used))


def _any_open(group: np.ndarray, open_: np.ndarray) -> np.ndarray:
    """For items in groups (equal values lie together): whether any item of the group is open."""
    if not len(group):
        return np.zeros(0, bool)
    first = np.concatenate([[True], group[1:] != group[:-1]])
    at = np.cumsum(first) - 1
    return np.bincount(at, weights=open_)[at] > 0


def _induce(text: np.ndarray, smaller: np.ndarray, lms: np.ndarray) -> np.ndarray:
    n, symbols = len(text), int(text.max()) + 1
    sizes = np.bincount(text, minlength=symbols)
    stops = np.cumsum(sizes)
    begins = stops - sizes
    order = np.full(n, -1, np.int32)

    def put(items: np.ndarray, place: np.ndarray, step: int) -> None:
        """Append ``items`` to their buckets: upwards from ``place`` (step 1) or downwards (step -1)."""
        first = text[items]
        by = np.argsort(first, kind="stable")
        first, items = first[by], items[by]
        counts = np.bincount(first, minlength=symbols)
        nth = np.arange(len(items)) - np.repeat(np.cumsum(counts) - counts, counts)
        order[place[first] + nth if step == 1 else place[first] - 1 - nth] = items
        place += step * counts

    def before(items: np.ndarray, want_smaller: bool) -> np.ndarray:
        items = items[items > 0] - 1
        return items[smaller[items] == want_smaller]

    tails = stops.copy()
    put(lms[::-1], tails, -1)
    heads = begins.copy()
    for c in range(symbols):  # larger ones, from the least bucket upwards
        done = begins[c]
        while done < heads[c]:
            known, done = order[done:heads[c]], heads[c]
            put(before(known, False), heads, 1)
        put(before(order[tails[c]:stops[c]], False), heads, 1)
    tails = stops.copy()
    for c in range(symbols - 1, -1, -1):  # smaller ones, from the greatest bucket downwards
        done = stops[c]
        while done > tails[c]:
            known, done = order[tails[c]:done][::-1], tails[c]
            put(before(known, True), tails, -1)
        put(before(order[begins[c]:heads[c]][::-1], True), tails, -1)
    order[0] = n - 1
    return order


def _induce_wide(text: np.ndarray, smaller: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The same for alphabets of many symbols: one step for each suffix, over flat 32-bit arrays."""
    n, sizes = len(text), np.bincount(text)
    stops = np.cumsum(sizes)
    left = np.full(n + 1, -1, np.int32)  # the symbol to the left of each place; -1 where nothing is induced (and at n, an empty slot)
    left[1:n] = text[:-1]
    larger, less = left.copy(), left
    larger[1:n][smaller[:-1]] = -1
    less[1:n][~smaller[:-1]] = -1

    slots = np.full(n, n, np.int32)
    items = lms[::-1]
    by = np.argsort(text[items], kind="stable")
    first = text[items][by]
    counts = np.bincount(first, minlength=len(sizes))
    nth = np.arange(len(items)) - np.repeat(np.cumsum(counts) - counts, counts)
    slots[stops[first] - 1 - nth] = items[by]

    larger, less, order = (array("i", x.tobytes()) for x in (larger, less, slots))
    heads = (stops - sizes).tolist()
    for i in order:  # filled further on while it is read
        c = larger[i]
        if c >= 0:
            at = heads[c]
            heads[c] = at + 1
            order[at] = i - 1
    tails = stops.tolist()
    for i in reversed(order):  # filled further down
        c = less[i]
        if c >= 0:
            at = tails[c] = tails[c] - 1
            order[at] = i - 1
    order[0] = n - 1
    return np.frombuffer(order, np.int32)


def permuted_common_prefixes(text: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix: the one before it in ``order``, and how many symbols both share.

    ``text`` holds bytes; its last byte must occur only there.  Only irreducible
    values (the bytes to the left differ) are compared; the others are one less
    than the value to their left.
    """
    n = len(text)
    before = np.empty(n, np.int32)
    before[order[1:]] = order[:-1]
    before[order[0]] = -1
    has = before >= 0
    left = np.zeros(n, bool)  # the bytes to the left agree
    left[1:] = has[1:] & (before[1:] > 0) & (text[:-1] == text[np.maximum(before[1:], np.int32(1)) - np.int32(1)])
    at = np.flatnonzero(has & ~left).astype(np.int32)
    other = before[at]
    length = np.zeros(len(at), np.int32)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.ndarray((n,), "<u8", padded, strides=(1,))  # the eight bytes from each position on
    open_ = np.arange(len(at), dtype=np.int32)
    while len(open_):
        differ = words[at[open_] + length[open_]] ^ words[other[open_] + length[open_]]
        ended = differ != 0
        lowest = differ[ended]
        lowest &= ~lowest + np.uint64(1)
        length[open_[ended]] += np.log2(lowest.astype(np.float64)).astype(np.int32) >> 3
        open_ = open_[~ended]
        length[open_] += 8
    reach = np.zeros(n, np.int32)
    reach[at] = at + length
    np.maximum.accumulate(reach, out=reach)
    reach -= np.arange(n, dtype=np.int32)
    return before, reach
