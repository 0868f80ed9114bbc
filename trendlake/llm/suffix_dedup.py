"""Suffix-array dedup: every byte covered by a ``length``-byte string that also starts anywhere else.

All suffixes of a corpus cannot be sorted in one place, so equal strings are first
brought together without looking at their order:

1. Each document is cut into segments.  A window (a string of ``length`` bytes) takes
   as its key the least hash of the ``GRAM``-byte grams in it, so equal windows
   have equal keys wherever they stand.  Neighbouring windows of one key form a
   segment: the bytes from the first window's start to the last one's end.
2. A key that occurs once in the corpus, and whose gram stands once in its segment, belongs
   to no repeated window.  The other segments
   are collapsed by digest: one copy of each different segment goes on, with the number
   of its copies (a hot group of copies costs one row for each task).
3. All segments of a key meet in one shard.  A shard is a text of segments with
   separators; its suffix array is built by induced sorting (``suffix_array``), the
   permuted common prefixes tell for each suffix whether it shares ``length`` bytes
   with the one before it, and a segment with several copies is repeated as a whole.
   A window lies in one segment only, so two suffixes of a shard never are one and
   the same place of a document.
4. The repeated spans of each different segment go back to all its copies by digest and
   are merged for each document.

A key with more than ``hot`` different segments is not put in one shard: its windows
are dealt out by a 128-bit hash of all their bytes and counted there, which is exact
up to the hash.

Defined results: null text is empty; texts shorter than ``length`` keep all bytes;
every further row with the same text counts as another place, also under the same
doc_id; null ids are a document of their own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut, row_slices
from .suffix_array import permuted_common_prefixes, suffix_array
from .words import BASE, BASE_INVERSE, _power_table, mix, text_bytes

SLICE_BYTES = 2 << 20
GRAM = 32
SHARD_BYTES = 3 << 20
#: Bytes that no UTF-8 text holds.
SEPARATOR, END = 0xFF, 0xFE

SPANS = "array<struct<lo:int,hi:int>>"


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of each ``size``-byte string of ``data``."""
    n = len(data)
    if n < size:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power_table(BASE, n), out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * _power_table(BASE_INVERSE, n)[:n - size + 1])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, by running minima of blocks from both sides."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1:width - 1 + n])


def segments(data: np.ndarray, offsets: np.ndarray, length: int):
    """Key, row, first byte and end byte (in ``data``) of each segment, and whether its key's gram stands in it twice."""
    grams = gram_hashes(data, GRAM)
    least = sliding_least(grams, length - GRAM + 1)
    if not len(least):
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3, np.zeros(0, bool))
    inside = np.zeros(len(data) + 1, np.int64)
    sizes = np.diff(offsets)
    long = sizes >= length
    np.add.at(inside, offsets[:-1][long], 1)
    np.add.at(inside, offsets[1:][long] - length + 1, -1)
    valid = np.cumsum(inside)[:len(least)] > 0
    change = np.ones(len(least), bool)
    change[1:] = (least[1:] != least[:-1]) | ~valid[:-1]
    firsts = offsets[:-1][long]
    change[firsts] = True
    begin = np.flatnonzero(valid & change)
    last = np.concatenate([change[1:] | ~valid[1:], [True]])
    end = np.flatnonzero(valid & last)
    row = np.searchsorted(offsets, begin, side="right") - 1
    key, end = least[begin], end + length
    within = np.fromiter((np.count_nonzero(grams[a:b - GRAM + 1] == k) > 1 for k, a, b in zip(key, begin.tolist(), end.tolist())), bool, len(key))
    return key, row, begin, end, within


def _slices(batches):
    for batch in batches:
        yield from row_slices(batch, "text", SLICE_BYTES)


def _text_marks(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    view = memoryview(np.ascontiguousarray(data))
    return np.array([xxhash.xxh3_64_intdigest(view[a:b]) & 0x7FFFFFFF for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], np.int32)


def _segment_rows(length: int):
    def run(batches):
        for part in _slices(batches):
            data, offsets = text_bytes(part.column("text"))
            key, row, begin, end, within = segments(data, offsets, length)
            if not len(key):
                continue
            view = memoryview(np.ascontiguousarray(data))
            digest = np.fromiter((xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(begin.tolist(), end.tolist())), np.uint64, len(begin))
            marks = _text_marks(data, offsets)
            doc_ids = part.column("doc_id").take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(digest.view(np.int64)), doc_ids, pa.array(marks[row], pa.int32()),
                                              pa.array(begin - offsets[row], pa.int32()), pa.array(end - begin, pa.int32()), pa.array(within)], names=["key", "digest", "doc_id", "mark", "lo", "size", "within"])
    return run


def _cut_segments(batches):
    """The bytes of the wanted segments of each document."""
    for part in _slices(batches):
        data, offsets = text_bytes(part.column("text"))
        raw, marks = data.tobytes(), _text_marks(data, offsets)
        rows = []
        for k, wanted in enumerate(part.column("wanted").to_pylist()):
            at = int(offsets[k])
            rows += [(w["shard"], w["key"], w["digest"], w["copies"], raw[at + w["lo"]:at + w["lo"] + w["size"]]) for w in wanted if w["mark"] == marks[k]]
        for first in range(0, len(rows), 4096):
            columns = list(zip(*rows[first:first + 4096]))
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:4]], pa.array(columns[4], pa.binary())], names=["shard", "key", "digest", "copies", "bytes"])


def repeated_spans(texts: list[bytes], copies: list[int], length: int) -> list[list[tuple[int, int]]]:
    """For each text of a shard, the merged spans of its bytes that lie in a repeated ``length``-byte string."""
    raw = b"\xff".join(texts) + b"\xff\xfe"
    data = np.frombuffer(raw, np.uint8)
    symbols = data.astype(np.int16) + 2
    symbols[data == SEPARATOR] = 1
    symbols[-1] = 0
    before, common = permuted_common_prefixes(data, suffix_array(symbols))
    twice = common >= length
    twice[before[np.flatnonzero(twice)]] = True
    sizes = np.array([len(t) for t in texts])
    at = np.concatenate([[0], np.cumsum(sizes + 1)])
    for k in np.flatnonzero(np.array(copies) > 1):
        twice[at[k]:at[k] + sizes[k] - length + 1] = True
    step = np.zeros(len(data) + length + 1, np.int32)
    whole = np.zeros(len(data) + 1, np.int8)  # where a string of full length fits into its segment
    whole[at[:-1]] += 1
    whole[at[:-1] + np.maximum(sizes - length + 1, 0)] -= 1
    begins = np.flatnonzero(twice & (np.cumsum(whole[:-1], dtype=np.int8) > 0))
    step[begins] += 1
    step[begins + length] -= 1
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(step, out=step) > 0).view(np.int8), [0]])))
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    lo, hi = edges[::2], edges[1::2]
    of = np.searchsorted(at, lo, side="right") - 1
    for k, a, b in zip(of.tolist(), lo.tolist(), hi.tolist()):
        out[k].append((a - int(at[k]), b - int(at[k])))
    return out


def _search_shards(length: int):
    def solve(rows):
        found = repeated_spans([r[3] for r in rows], [r[2] for r in rows], length)
        hits = [(r[0], r[1], [{"lo": a, "hi": b} for a, b in spans]) for r, spans in zip(rows, found) if spans]
        return pa.RecordBatch.from_arrays([pa.array([h[0] for h in hits], pa.int64()), pa.array([h[1] for h in hits], pa.int64()),
                                           pa.array([h[2] for h in hits], pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))], names=["key", "digest", "spans"])

    def run(batches):
        shard, rows = None, []
        for batch in batches:
            for s, *row in zip(*(batch.column(c).to_pylist() for c in ("shard", "key", "digest", "copies", "bytes"))):
                if s != shard:
                    if rows:
                        yield solve(rows)
                    shard, rows = s, []
                rows.append(row)
        if rows:
            yield solve(rows)
    return run


def _window_rows(length: int):
    """Every window of the segments with hot keys, under a 128-bit hash of its bytes."""
    def run(batches):
        for batch in batches:
            rows = []
            for key, digest, copies, text in zip(*(batch.column(c).to_pylist() for c in ("key", "digest", "copies", "bytes"))):
                for lo in range(len(text) - length + 1):
                    rows.append((xxhash.xxh3_128_digest(text[lo:lo + length]), key, digest, lo, copies))
                if len(rows) > 20_000:
                    yield _windows(rows)
                    rows = []
            if rows:
                yield _windows(rows)
    return run


def _windows(rows):
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), *[pa.array(c, pa.int64()) for c in columns[1:]]], names=["window", "key", "digest", "lo", "copies"])


def _hot_spans(cut_hot: DataFrame, length: int) -> DataFrame:
    windows = cut(cut_hot.mapInArrow(_window_rows(length), "window binary, key long, digest long, lo long, copies long"), "hot-windows")
    repeated = windows.groupBy("window").agg(F.sum("copies").alias("n")).where("n > 1").select("window")
    spans = windows.join(repeated, "window").groupBy("key", "digest").agg(F.collect_list(F.struct(F.col("lo").cast("int").alias("lo"), (F.col("lo") + length).cast("int").alias("hi"))).alias("spans"))
    return spans


def _report(batches):
    for part in _slices(batches):
        data, offsets = text_bytes(part.column("text"))
        raw, marks = data.tobytes(), _text_marks(data, offsets)
        removed, n_spans, digests, kept_texts = [], [], [], []
        for k, spans in enumerate(part.column("spans").to_pylist()):
            text = raw[int(offsets[k]):int(offsets[k + 1])]
            kept, at, count = [], 0, 0
            for s in sorted((s["lo"], s["hi"]) for s in spans or () if s["mark"] == marks[k]):
                if s[0] > at or not count:
                    kept.append(text[at:s[0]])
                    count += 1
                at = max(at, s[1])
            kept.append(text[at:])
            kept = b"".join(kept)
            removed.append(len(text) - len(kept))
            n_spans.append(count)
            digests.append(hashlib.sha256(kept).hexdigest())
            kept_texts.append(kept)
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests), pa.array(kept_texts, pa.binary())],
                                         names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def repeated_strings(docs: DataFrame, length: int = 200, hot: int = 20_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the ``kept`` bytes."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    every = cut(texts.mapInArrow(_segment_rows(length), "key long, digest long, doc_id long, mark int, lo int, size int, within boolean"), "segments")
    twice = every.groupBy("key").agg(F.count("*").alias("n"), F.max("within").alias("within")).where("n > 1 or within").select("key")
    shared = cut(every.join(twice, "key"), "shared-segments")

    different = shared.groupBy("key", "digest").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "mark", "lo", "size")).alias("at"))
    different = cut(different.select("key", "digest", "copies", "at.*"), "different-segments")
    hot_keys = different.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("key", F.lit(-1).cast("long").alias("shard"))
    total = different.agg(F.sum(F.col("size") + 1)).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))
    placed = different.join(hot_keys, "key", "left").withColumn("shard", F.coalesce("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))).where("size > 0")
    wanted = placed.groupBy("doc_id").agg(F.collect_list(F.struct("mark", "shard", "key", "digest", "copies", "lo", "size")).alias("wanted")).withColumnRenamed("doc_id", "id")
    cut_out = texts.join(wanted, texts.doc_id.eqNullSafe(wanted.id)).select("text", "wanted").mapInArrow(_cut_segments, "shard long, key long, digest long, copies long, bytes binary")
    cut_out = cut(cut_out, "segment-bytes")  # read by both ways below; the texts are shuffled once for it
    # rows of one doc_id with the same text cut the same segment more than once
    cold = cut_out.where("shard >= 0").repartition("shard").sortWithinPartitions("shard", "key", "digest").mapInArrow(_search_shards(length), f"key long, digest long, spans {SPANS}")
    spans = cold
    if not hot_keys.isEmpty():
        spans = cold.unionByName(_hot_spans(cut_out.where("shard < 0"), length))
    spans = cut(spans.dropDuplicates(["key", "digest"]), "repeated-spans")
    back = shared.join(spans, ["key", "digest"]).select("doc_id", "mark", "lo", F.explode("spans").alias("s"))
    merged = back.groupBy(F.col("doc_id").alias("id")).agg(F.collect_list(F.struct("mark", (F.col("lo") + F.col("s.lo")).alias("lo"), (F.col("lo") + F.col("s.hi")).alias("hi"))).alias("spans"))
    found = texts.join(merged, texts.doc_id.eqNullSafe(merged.id), "left").select("doc_id", "text", "spans")
    return found.mapInArrow(_report, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
