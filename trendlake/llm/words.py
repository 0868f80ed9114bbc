"""Words, word hashes and shingle hashes of a whole Arrow column at once (numpy).

Texts are handled as UTF-8 bytes.  Both word rules of the operators cut at ASCII
bytes only, so no multi-byte character is ever split.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: 64-bit odd multipliers (fixed, so that hashes agree between tasks and runs).
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
STEP = np.uint64(0xD1342543DE82EF95)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: ``[^\x20\x09-\x0D]+``
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (after lower-casing): digits, a-z, everything non-ASCII
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_powers: dict[str, np.ndarray] = {}


def _power_table(base: np.uint64, size: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for i < size, kept per process and grown when needed."""
    key = str(base)
    if key not in _powers or len(_powers[key]) < size:
        table = np.full(max(size, 1 << 16), base, dtype=np.uint64)
        table[0] = 1
        _powers[key] = np.multiply.accumulate(table)
    return _powers[key][:size]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of the input reaches every bit of the output."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column end to end, and the offset of each row (one more at the end).  Null is empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    if not len(texts) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ``data[start:end]`` that depends on its bytes and length only."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power_table(BASE, n), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power_table(BASE_INVERSE, n + 1)[starts])


@dataclass
class Words:
    """The words of some rows: byte spans in ``data``, the row of each, and each row's first word."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    firsts: np.ndarray

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)

    def counts(self) -> np.ndarray:
        return np.diff(self.firsts)


def find_words(texts: pa.Array, word_byte: np.ndarray, lower: bool) -> Words:
    """Maximal runs of ``word_byte`` bytes in each row (A-Z lower-cased first if ``lower``)."""
    data, offsets = text_bytes(texts)
    if lower:
        data = LOWER[data]
    inside = word_byte[data]
    begins, stops = inside.copy(), inside.copy()
    if len(data):
        begins[1:] &= ~inside[:-1]
        stops[:-1] &= ~inside[1:]
        cuts = offsets[:-1][np.diff(offsets) > 0]
        begins[cuts] = inside[cuts]
        last = cuts[1:] - 1
        stops[last] = inside[last]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    firsts = np.searchsorted(starts, offsets)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))
    return Words(data, starts, ends, rows, firsts)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each ``k`` consecutive word hashes (windows over row borders included; drop those by row)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = words[:n].copy()
    for j in range(1, k):
        total = total * STEP + words[j:n + j]
    return mix(total + np.uint64(k))
