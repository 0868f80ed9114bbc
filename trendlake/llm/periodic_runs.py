"""Periodic runs of words by Lyndon arrays from Baier grouping.

A run is a stretch of words with a smallest period ``q`` that no neighbouring word extends.
Each run holds a Lyndon root (a word of length ``q`` less than all its proper suffixes) under
the order of the words or under the reversed order, and that root is the longest Lyndon word
that starts at its place (the runs theorem).  So:

1. Phase one of Baier's suffix sorter gives the longest Lyndon word at every place, under both
   orders, without sorting any suffix: suffixes are grouped by their first word; groups are
   taken from the highest down, and every suffix that is the nearest lower one to the left of
   ``c`` members moves to a new group behind its old one, its prefix grown by ``c`` times the
   group's.  A group's prefix is the longest Lyndon word of its members (``lyndon_lengths``).
2. A run of ``e`` periods holds roots at ``e - 1`` places in a row, one period apart; such
   places are extended to both sides by longest common extensions (``find_runs``).

All this costs a Python step for each word, so texts are first reduced, exactly: every word of
a run lies in a three-word window that the run repeats ``e - 1`` times at least, so words in
no such window belong to no run, and a run lies in one stretch of the words left
(``suspects``; it may keep too much, never too little).

Words are compared as strings (dictionary codes of a batch), not as hashes.  A text is worked
on in one task; nothing is shuffled.

Defined results: null and empty texts have no words and no runs; each row is worked on by
itself, also under a repeated or null doc_id; other columns of the input are not read,
whatever their names.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import row_slices
from .words import STEP, mix

SLICE_BYTES = 2 << 20
WINDOW = 3
ROUNDS = 8
NOT_SEEN = -2
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def lyndon_lengths(symbols: list[int]) -> list[int]:
    """Length of the longest Lyndon word that starts at each place (the end of the text counts as least)."""
    names = {s: k for k, s in enumerate(sorted(set(symbols)))}
    group = [names[s] for s in symbols]
    members: list[list[int]] = [[] for _ in names]
    for i, g in enumerate(group):
        members[g].append(i)
    size = [1] * len(members)
    lower = list(range(-1, len(members) - 1))
    higher = [*range(1, len(members)), -1]
    left = [NOT_SEEN] * len(symbols)  # nearest lower place to the left, once known
    out = [0] * len(symbols)
    g = len(members) - 1
    while g >= 0:
        met: dict[int, int] = {}
        for i in members[g]:
            if group[i] != g:
                continue  # moved on
            out[i] = size[g]
            j = i - 1
            while j >= 0 and left[j] != NOT_SEEN:
                j = left[j]
            left[i] = j
            if j >= 0:
                met[j] = met.get(j, 0) + 1
        moving = defaultdict(list)
        for j, count in met.items():
            moving[count, group[j]].append(j)
        for count, old in sorted(moving, reverse=True):  # more repeats go higher
            new = len(members)
            members.append(moving[count, old])
            size.append(size[old] + count * size[g])
            above = higher[old]
            lower.append(old)
            higher.append(above)
            higher[old] = new
            if above >= 0:
                lower[above] = new
            for j in members[new]:
                group[j] = new
        g = lower[g]
    return out


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """How many first symbols two sequences share (read in growing blocks)."""
    n, at, block = min(len(a), len(b)), 0, 64
    while at < n:
        differ = np.flatnonzero(a[at:min(n, at + block)] != b[at:min(n, at + block)])
        if len(differ):
            return at + int(differ[0])
        at, block = at + block, block * 2
    return n


def find_runs(words: np.ndarray, exponent: int, least: int) -> set[tuple[int, int, int]]:
    """(start, length, period) of the runs of at least ``exponent`` periods and ``least`` words."""
    n, out = len(words), set()
    for ordered in (words, -words):
        root = np.array(lyndon_lengths(ordered.tolist()), np.int64)
        at = np.flatnonzero(np.arange(n) + exponent * root - root <= n)
        for k in range(1, exponent - 1):  # roots of one length in a row
            at = at[root[at + k * root[at]] == root[at]]
        ends: dict[int, int] = {}  # of the last run of each period
        for i, p in zip(at.tolist(), root[at].tolist()):
            if i + p <= ends.get(p, 0):
                continue
            start = i - _agree(words[:i][::-1], words[:i + p][::-1])
            stop = i + p + _agree(words[i:], words[i + p:])
            ends[p] = stop
            if stop - start >= max(least, exponent * p):
                out.add((start, stop - start, p))
    return out


def suspects(ids: np.ndarray, piece: np.ndarray, exponent: int, least: int) -> list[tuple[int, int]]:
    """Stretches of places (within one ``piece`` each) that hold every run of the texts."""
    if least <= exponent:  # a run of one repeated word may have too few windows
        edges = np.flatnonzero(np.diff(piece, prepend=-1, append=-1))
        return [(a, b) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()) if b - a >= least]
    codes = mix(ids.astype(np.uint64) + np.uint64(1))
    keys = np.zeros(max(0, len(ids) - WINDOW + 1), np.uint64)
    for k in range(WINDOW):
        keys = keys * STEP + codes[k:len(keys) + k]
    piece = piece.copy()
    for _ in range(ROUNDS):
        at = np.flatnonzero((piece[:len(keys)] >= 0) & (piece[:len(keys)] == piece[len(piece) - len(keys):]))
        _, which, count = np.unique(mix(keys[at] ^ mix(piece[at].astype(np.uint64))), return_inverse=True, return_counts=True)
        at = at[count[which] >= exponent - 1]
        held = np.zeros(len(ids), bool)
        for k in range(WINDOW):
            held[at + k] = True
        before = np.count_nonzero(piece >= 0)
        fresh = held.copy()
        fresh[1:] &= ~held[:-1] | (piece[1:] != piece[:-1])
        piece = np.where(held, np.cumsum(fresh) - 1, -1)
        kept = np.bincount(piece[held], minlength=1)
        piece[held] = np.where(kept[piece[held]] >= least, piece[held], -1)
        if np.count_nonzero(piece >= 0) > 0.9 * before:
            break
    edges = np.flatnonzero(np.diff(piece, prepend=-1, append=-1))
    return [(a, b) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()) if piece[a] >= 0]


def _split(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Word codes of all rows end to end, the words, and each row's first place (one more at the end)."""
    parts = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
    row = np.repeat(np.arange(len(texts)), np.diff(np.asarray(parts.offsets)))
    coded = parts.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    ids = np.asarray(coded.indices).astype(np.int64)
    full = np.array([bool(w) for w in words], bool)[ids] if len(words) else np.zeros(0, bool)
    firsts = np.searchsorted(row[full], np.arange(len(texts) + 1))
    return ids[full], words, firsts


def periodic_runs(docs: DataFrame, exponent: int = 4, least: int = 6) -> DataFrame:
    """doc_id, ``runs`` (start, length, period by start and period) and ``collapsed`` (each run's first period stays) of every row.

    ``exponent``: periods that a run has at least, 2 or more; ``least``: words that it has at least.
    """
    if exponent < 2:
        raise ValueError("a run has two periods at least")

    def collapse(part):
        ids, words, firsts = _split(part.column("text"))
        piece = np.repeat(np.arange(len(part)), np.diff(firsts))
        keep = np.ones(len(ids) + 1, bool)
        found = [[] for _ in range(len(part))]
        for a, b in suspects(ids, piece, exponent, least):
            row = int(piece[a])
            for start, length, period in find_runs(ids[a:b], exponent, least):
                found[row].append((a + start - int(firsts[row]), length, period))
                keep[a + start + period:a + start + length] = False
        for k, runs in enumerate(found):
            stay = ids[firsts[k]:firsts[k + 1]][keep[firsts[k]:firsts[k + 1]]]
            yield sorted(runs, key=lambda r: (r[0], r[2])), " ".join([words[i] for i in stay.tolist()])

    def run(batches):
        for batch in batches:
            for part in row_slices(batch, "text", SLICE_BYTES):
                runs, texts = zip(*collapse(part))
                rows = pa.array([[dict(zip(("start", "length", "period"), r)) for r in some] for some in runs], pa.list_(RUN))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), rows, pa.array(texts, pa.string())], names=["doc_id", "runs", "collapsed"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(run, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
