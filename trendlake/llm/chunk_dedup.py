"""Substring dedup by content-defined chunks: a gear rolling hash cuts, digests find repeats.

A cut falls after a byte whose gear hash (over the last ``GEAR_WINDOW`` bytes) is the
least of some ``CUT_WINDOW`` neighbouring ones of its text, and only before the start of
a character.  Whether a place is a cut depends on the bytes near it alone, so an insertion
shifts no chunk but those around it, and two copies of a passage of ``2 * CUT_WINDOW +
GEAR_WINDOW`` bytes have a whole chunk in common wherever they stand (unless the passage
repeats itself within ``CUT_WINDOW`` bytes: of such cuts the first stays).  Stretches
without a cut are divided every ``MAX_CHUNK`` bytes from their last cut.

The first occurrence of a chunk (by doc_id, then place) stays.  Neighbouring chunks whose
first occurrences are neighbours in one text form a run; a run is extended byte by byte
at both ends, as far as ``REACH`` bytes, while the bytes equal those beside the first
occurrence.  What adjoining extended runs cover is removed if it has ``min_bytes`` or
more; a short chunk that happens to recur is no reason to cut a text.  Chunks meet by a
64-bit digest; before a run's bytes go, a second hash of all of them must equal that of the
first occurrence, so 128 bits decide.

Skew: chunks are counted with map-side combining, so the copies of a chunk in a third
of all documents reach the reducer as one row for each task; the join back is an
ordinary equi-join that adaptive execution splits.  The bytes beside a first occurrence
are read once for all runs that need them and joined back in the same way.

Defined results: null text is empty and keeps nothing to remove; rows equal in id and
text count as one document; further rows with the same text under another id are
removed up to the run limit; null ids come first.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut, row_slices
from .words import mix, text_bytes

SLICE_BYTES = 2 << 20
GEAR_WINDOW = 16
CUT_WINDOW = 80
MAX_CHUNK = 1024
REACH = 2 * CUT_WINDOW

GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """``h = (h << 1) + gear[byte]`` on 32 bits at every byte: a sum over the last ``GEAR_WINDOW`` bytes, built by doubling."""
    h = GEAR[data]
    reach = 1
    while reach < GEAR_WINDOW:
        h[reach:] += h[:-reach] << np.uint32(reach)
        reach *= 2
    return h


def window_minima(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places behind the least hash of every ``CUT_WINDOW`` places that lie in one text (the last of equal ones)."""
    n = len(data)
    if n < CUT_WINDOW + GEAR_WINDOW:
        return np.zeros(0, np.int64)
    key = np.append(gear_hashes(data)[:-1].astype(np.uint64), np.uint64(0))  # of a cut before byte i + 1
    key[:-1][(data[1:] & 0xC0) == 0x80] = np.uint64(0xFFFFFFFF)
    key = (key << np.uint64(32)) | np.arange(n, 0, -1).astype(np.uint64)
    least, reach = key, 1
    while 2 * reach <= CUT_WINDOW:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    size = n - CUT_WINDOW + 1
    least = np.minimum(least[:size], least[CUT_WINDOW - reach:][:size])
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.arange(size)
    # neither hash nor window may reach into another text, and no cut falls behind a text's last byte
    inside = (at - offsets[row[:size]] >= GEAR_WINDOW - 1) & (at + CUT_WINDOW < offsets[1:][row[:size]])
    found = least[inside]
    found = found[np.diff(found, prepend=np.uint64(0)) != 0]
    place, value = n - (found & np.uint64(0xFFFFFFFF)).astype(np.int64), found >> np.uint64(32)
    again = np.zeros(len(place), bool)
    again[1:] = (np.diff(place) <= CUT_WINDOW) & (value[1:] == value[:-1]) & (row[place[1:]] == row[place[:-1]])
    return place[~again & (value != np.uint64(0xFFFFFFFF))] + 1


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First bytes of all chunks of some texts that lie end to end in ``data``."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    low = window_minima(data, offsets)
    starts = np.union1d(offsets[:-1][np.diff(offsets) > 0], low)
    room = np.diff(np.append(starts, n))
    for k in np.flatnonzero(room > MAX_CHUNK).tolist():
        more = starts[k] + np.arange(MAX_CHUNK, room[k], MAX_CHUNK)
        while ((data[more] & 0xC0) == 0x80).any():
            more = more - ((data[more] & 0xC0) == 0x80)
        starts = np.append(starts, more)
    return np.sort(starts)


def _slices(batches):
    for batch in batches:
        yield from row_slices(batch, "text", SLICE_BYTES)


def _chunk_rows(batches):
    for part in _slices(batches):
        data, offsets = text_bytes(part.column("text"))
        starts = chunk_starts(data, offsets)
        if not len(starts):
            continue
        ends = np.append(starts[1:], len(data))
        view = memoryview(np.ascontiguousarray(data))
        digest = np.fromiter((xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))
        row = np.searchsorted(offsets, starts, side="right") - 1
        marks = text_marks(data, offsets)
        yield pa.RecordBatch.from_arrays([pa.array(digest.view(np.int64)), part.column("doc_id").take(pa.array(row)), pa.array(marks[row], pa.int32()), pa.array(starts - offsets[row], pa.int32()), pa.array(ends - starts, pa.int32())],
                                         names=["digest", "doc_id", "mark", "lo", "size"])


def text_marks(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A short hash of each row's text, to tell apart rows of one doc_id."""
    view = memoryview(np.ascontiguousarray(data))
    return np.array([xxhash.xxh3_64_intdigest(view[a:b]) & 0x7FFFFFFF for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], np.int32)


def removed_spans(repeats: list[tuple[int, int]], min_bytes: int) -> list[tuple[int, int]]:
    """What adjoining or overlapping repeats ``(first byte, end byte)`` cover, if that has ``min_bytes`` or more."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(set(repeats)):
        if out and out[-1][1] >= lo:
            out[-1] = out[-1][0], max(hi, out[-1][1])
        else:
            out.append((lo, hi))
    return [s for s in out if s[1] - s[0] >= min_bytes]


RUN = "doc_id long, mark int, lo int, hi int, first_id long, first_mark int, first_lo int, first_hi int"


def _runs(batches):
    """Neighbouring repeated chunks with neighbouring first occurrences in one text, as one row."""
    for batch in batches:
        out = []
        for doc, repeats in zip(batch.column("id").to_pylist(), batch.column("repeats").to_pylist()):
            last = None
            for r in sorted(repeats, key=lambda r: (r["mark"], r["lo"])):
                f = r["first"]
                if last and last[1:2] + last[3:6:2] == [r["mark"], r["lo"], f["mark"]] and last[4] == f["doc_id"] and last[7] == f["lo"]:
                    last[3] += r["size"]
                    last[7] += r["size"]
                elif not last or last[1] != r["mark"] or r["lo"] >= last[3]:  # rows equal in id and text bring a chunk twice
                    last = [doc, r["mark"], r["lo"], r["lo"] + r["size"], f["doc_id"], f["mark"], f["lo"], f["lo"] + r["size"]]
                    out.append(last)
        columns = list(zip(*out)) or [()] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k in (0, 4) else pa.int32()) for k, c in enumerate(columns)],
                                         names=["doc_id", "mark", "lo", "hi", "first_id", "first_mark", "first_lo", "first_hi"])


def _beside(batches):
    """The ``REACH`` bytes before and behind wanted spans of the texts, and a second hash of what lies in them."""
    for part in _slices(batches):
        data, offsets = text_bytes(part.column("text"))
        raw, marks = data.tobytes(), text_marks(data, offsets)
        rows = []
        for k, (doc, spans) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("spans").to_pylist())):
            first, end = int(offsets[k]), int(offsets[k + 1])
            for s in spans:
                if s["mark"] == marks[k]:
                    lo, hi = first + s["lo"], first + s["hi"]
                    rows.append((doc, s["mark"], s["lo"], s["hi"], raw[max(first, lo - REACH):lo], raw[hi:min(hi + REACH, end)], second_hash(raw[lo:hi])))
        columns = list(zip(*rows)) or [()] * 7
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["span_id", "span_mark", "span_lo", "span_hi", "before", "behind", "check"])


def second_hash(text: bytes) -> int:
    """A hash of a run's bytes that is independent of its chunks' digests."""
    return xxhash.xxh64_intdigest(text, seed=0x5EED) - (1 << 63)


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differ = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))
    return int(differ[0]) if len(differ) else n


def extended(text: bytes, lo: int, hi: int, before: bytes, behind: bytes) -> tuple[int, int]:
    """``lo, hi`` moved outwards over the bytes that equal ``before`` and ``behind``, to starts of characters."""
    end = hi + common_prefix(text[hi:hi + REACH], behind)
    begin = lo - common_prefix(text[max(0, lo - REACH):lo][::-1], before[::-1])
    while begin < lo and text[begin] & 0xC0 == 0x80:
        begin += 1
    while hi < end < len(text) and text[end] & 0xC0 == 0x80:
        end -= 1
    return begin, end


def _report(min_bytes: int):
    def run(batches):
        for part in _slices(batches):
            data, offsets = text_bytes(part.column("text"))
            raw, marks = data.tobytes(), text_marks(data, offsets)
            rows = []
            for k, repeats in enumerate(part.column("repeats").to_pylist()):
                text = raw[int(offsets[k]):int(offsets[k + 1])]
                # equal digests are not enough to delete bytes: the run must also have its first occurrence's second hash
                same = (r for r in repeats or () if r["mark"] == marks[k] and second_hash(text[r["lo"]:r["hi"]]) == r["check"])
                spans = removed_spans([extended(text, r["lo"], r["hi"], r["before"] or b"", r["behind"] or b"") for r in same], min_bytes)
                kept, at = [], 0
                for lo, hi in spans:
                    kept.append(text[at:lo])
                    at = hi
                kept = b"".join([*kept, text[at:]])
                rows.append((len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept.decode()))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string()), pa.array(columns[4], pa.string())],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
    return run


def repeated_chunks(docs: DataFrame, min_bytes: int = 128) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the ``kept`` text."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # chunked twice rather than written: what a text's chunks are depends on nothing else
    chunks = texts.mapInArrow(_chunk_rows, "digest long, doc_id long, mark int, lo int, size int")
    place = F.struct("doc_id", "mark", "lo")
    first = chunks.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    repeats = chunks.join(first, "digest").where(~place.eqNullSafe(F.col("first")))
    merged = repeats.groupBy(F.col("doc_id").alias("id")).agg(F.collect_list(F.struct("mark", "lo", "size", "first")).alias("repeats"))
    runs = cut(merged.mapInArrow(_runs, RUN), "chunk-runs")
    wanted = runs.select("first_id", F.col("first_mark").alias("mark"), F.col("first_lo").alias("lo"), F.col("first_hi").alias("hi")).distinct().groupBy(F.col("first_id").alias("id")).agg(F.collect_list(F.struct("mark", "lo", "hi")).alias("spans"))
    beside = texts.join(wanted, texts.doc_id.eqNullSafe(wanted.id)).select("doc_id", "text", "spans").mapInArrow(_beside, "span_id long, span_mark int, span_lo int, span_hi int, before binary, behind binary, check long")
    # rows equal in id and text give the same bytes
    place = ["span_id", "span_mark", "span_lo", "span_hi"]
    beside = cut(beside, "chunk-beside").groupBy(*place).agg(*[F.first(c).alias(c) for c in ("before", "behind", "check")])
    known = runs.join(beside, runs.first_id.eqNullSafe(beside.span_id) & (runs.first_mark == beside.span_mark) & (runs.first_lo == beside.span_lo) & (runs.first_hi == beside.span_hi))
    spans = known.groupBy(F.col("doc_id").alias("id")).agg(F.collect_list(F.struct("mark", "lo", "hi", "before", "behind", "check")).alias("repeats"))
    found = texts.join(spans, texts.doc_id.eqNullSafe(spans.id), "left").select("doc_id", "text", "repeats")
    return found.mapInArrow(_report(min_bytes), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string")
