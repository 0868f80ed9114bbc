"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over training words.

Words are maximal runs of digits, a-z and non-ASCII characters after A-Z are
lower-cased.  An item's windows are its ``n`` consecutive words; an item with
fewer words is one window of all its words, one without words has none.  Every
window of a document is hashed, looked up in the sorted hash set, and a hit is
verified word by word before it counts.

Size of what is broadcast: the windows of at most ``max_broadcast_words`` item
words (about twice as many characters) travel in one pass, some 32 bytes and the letters of
each: 80 MB for the default of two million.  A larger benchmark is split by a hash of its items
into as many passes as that bound needs: the rows are written once with a row number,
each pass is a written table (its broadcast is destroyed after it), and the passes'
hits are merged by row number, so the size of a benchmark never changes a result.

Defined results: null or empty text has no words and no hits; repeated item rows
count once by id; an item without id marks words as hit but is not listed; an
empty benchmark hits nothing.  Each row is judged by its own text, whatever its id:
rows with a null id or with the id of another row are documents of their own.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut, row_slices
from .words import ALNUM, find_words, shingle_hashes

SLICE_BYTES = 1 << 20
ROW = "decontaminate_row"
REPORT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans array<struct<first:int,end:int>>"


class WindowSet:
    """The item windows of one pass in flat arrays: sorted hashes by window length, and the words that verify a hit.

    A window takes its hash and the number of its first word (16 bytes), a word its place in
    the items' text (16 bytes), so a pass holds 32 bytes for each item word and the text.
    """

    def __init__(self, items: list[tuple[str | None, str]], n: int):
        self.ids = [i for i, _ in items]
        words = find_words(pa.array([t for _, t in items], pa.large_string()), ALNUM, lower=True)
        sizes = words.ends - words.starts
        self.begins = np.cumsum(sizes + 1) - (sizes + 1)
        self.stops = self.begins + sizes
        text = np.full(int(self.stops[-1]) if len(sizes) else 0, 0x20, np.uint8)  # one space between words
        inside = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        text[np.repeat(self.begins, sizes) + inside] = words.data[np.repeat(words.starts, sizes) + inside]
        self.text, self.firsts = text.tobytes(), words.firsts
        hashes, counts = words.hashes(), words.counts()
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in np.unique(np.minimum(counts[counts > 0], n)).tolist():
            if size == n:
                at = np.flatnonzero(words.rows[:len(sizes) - n + 1] == words.rows[n - 1:])
            else:
                at = words.firsts[:-1][counts == size]
            keys = shingle_hashes(hashes, size)[at]
            order = np.argsort(keys, kind="stable")
            self.by_length[size] = keys[order], at[order]

    def _items(self, size: int, place: int, text: bytes) -> set | None:
        """Ids of the items with a window of that hash and text; ``place``: the first window of the hash."""
        keys, at = self.by_length[size]
        found, key = None, keys[place]
        while place < len(keys) and keys[place] == key:
            first = int(at[place])
            if self.text[self.begins[first]:self.stops[first + size - 1]] == text:
                found = set() if found is None else found
                found.add(self.ids[int(np.searchsorted(self.firsts, first, side="right")) - 1])
            place += 1
        return found

    def hits(self, words, hashes: np.ndarray) -> list[tuple[int, int, set]]:
        """Verified (first word, length, item ids) of every window occurrence, over all rows at once."""
        out, known = [], {}
        raw = None
        for size, (keys, _) in self.by_length.items():
            windows = shingle_hashes(hashes, size)
            place = np.searchsorted(keys, windows)
            place[place == len(keys)] = 0
            same_row = words.rows[:len(windows)] == words.rows[size - 1:]
            for k in np.flatnonzero((keys[place] == windows) & same_row).tolist():
                raw = raw if raw is not None else words.data.tobytes()
                text = b" ".join(raw[words.starts[j]:words.ends[j]] for j in range(k, k + size))
                if text not in known:
                    known[text] = self._items(size, int(place[k]), text)
                if known[text] is not None:
                    out.append((k, size, known[text]))
        return out


def _items_digest(items) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _scan(windows: WindowSet, share: int):
    def run(batches):
        for batch in batches:
            for part in row_slices(batch, "text", SLICE_BYTES):
                words = find_words(part.column("text"), ALNUM, lower=True)
                hits = windows.hits(words, words.hashes()) if len(words.starts) else []
                marked = np.zeros(len(words.starts) + 1, np.int64)
                items: dict[int, set] = {}
                for first, size, ids in hits:
                    marked[first] += 1
                    marked[first + size] -= 1
                    items.setdefault(int(words.rows[first]), set()).update(i for i in ids if i is not None)
                hit = np.cumsum(marked[:-1]) > 0
                total = np.concatenate([[0], np.cumsum(hit)])
                n_hit = total[words.firsts[1:]] - total[words.firsts[:-1]]
                counts = words.counts()
                spans = [_runs(hit[a:b]) if n else [] for a, b, n in zip(words.firsts[:-1], words.firsts[1:], n_hit)]
                named = [sorted(items.get(r, ())) for r in range(len(part))]
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(n_hit, pa.int64()),
                    pa.array([len(x) for x in named], pa.int64()), pa.array([_items_digest(x) for x in named]),
                    pa.array((n_hit > 0) & (share * n_hit >= counts)), pa.array(named, pa.list_(pa.string())),
                    pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))),
                ], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans"])
    return run


def _runs(flags: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return [{"first": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])]


def _merge(parts: list[DataFrame], share: int) -> DataFrame:
    """One row per row number from the passes' rows: the union of the hit spans and of the items."""
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part.where("n_hit > 0"))

    def joined(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                flags = np.zeros(r["n_words"], bool)
                for s in r["spans"]:
                    flags[s["first"]:s["end"]] = True
                n_hit = int(flags.sum())
                items = sorted(set(r["items"]))
                rows.append({"doc_id": r["doc_id"], "n_words": r["n_words"], "n_hit": n_hit, "n_items": len(items), "items_sha256": _items_digest(items),
                             "contaminated": n_hit > 0 and share * n_hit >= r["n_words"], "items": items, "spans": _runs(flags)})
            yield pa.RecordBatch.from_pylist(rows, schema=_REPORT_ARROW)

    # the scans give row numbers as doc_id
    grouped = every.groupBy("doc_id").agg(
        F.max("n_words").alias("n_words"), F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))
    return grouped.mapInArrow(joined, REPORT)


_REPORT_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()),
    ("contaminated", pa.bool_()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())])))])


def _items(benchmark: DataFrame, max_broadcast_words: int) -> tuple[DataFrame, int]:
    """The items with a text, and the passes that their size takes."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null")
    total = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    return items, max(1, math.ceil(total / 2 / max_broadcast_words))  # a word and its gap take two characters at least


def _window_set(items: DataFrame, n: int):
    return items.sparkSession.sparkContext.broadcast(WindowSet([(r["item_id"], r["text"]) for r in items.collect()], n))


def _in_passes(docs: DataFrame, items: DataFrame, passes: int, n: int, share: int) -> tuple[DataFrame, DataFrame]:
    """``docs`` written with a row number, and a report whose doc_id is that row number."""
    rows = cut(docs.withColumn(ROW, F.monotonically_increasing_id()), "decontaminate-rows")
    numbered = rows.select(F.col(ROW).alias("doc_id"), "text")
    parts = []
    for k in range(passes):
        windows = _window_set(items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k), n)
        parts.append(cut(numbered.mapInArrow(lambda batches, w=windows: _scan(w.value, share)(batches), REPORT), "decontaminate-pass"))
        windows.destroy()
    return rows, _merge(parts, share)


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 13, share: int = 20, max_broadcast_words: int = 2_000_000) -> DataFrame:
    """One row per document: words, hit words, items met, hit spans (word positions), and whether ``share * n_hit >= n_words``."""
    items, passes = _items(benchmark, max_broadcast_words)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if passes > 1:
        rows, report = _in_passes(texts, items, passes, n, share)
        return rows.select(ROW, "doc_id").join(report.withColumnRenamed("doc_id", ROW), ROW).drop(ROW)
    windows = _window_set(items, n)
    return texts.mapInArrow(lambda batches: _scan(windows.value, share)(batches), REPORT)


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 13, share: int = 20, remove: str = "documents", max_broadcast_words: int = 2_000_000) -> DataFrame:
    """``docs`` without contaminated documents, or (``remove="spans"``) with the hit words cut out of every text.

    All columns are kept.  A null text stays null.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove must be 'documents' or 'spans', not {remove!r}")
    items, passes = _items(benchmark, max_broadcast_words)
    at = docs.columns.index("text")

    def cleaned(part, spans):
        texts = [_without(t, s) for t, s in zip(part.column(at).to_pylist(), spans.to_pylist())]
        return part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))

    if passes > 1:
        rows, report = _in_passes(docs, items, passes, n, share)
        report = report.withColumnRenamed("doc_id", ROW)
        if remove == "documents":
            return rows.join(report.where("contaminated").select(ROW), ROW, "left_anti").select(docs.columns)
        found = rows.join(report.where("n_hit > 0").select(ROW, F.col("spans").alias("decontaminate_spans")), ROW, "left").select(*docs.columns, "decontaminate_spans")

        def run_found(batches):
            for batch in batches:
                for part in row_slices(batch, "text", SLICE_BYTES):
                    spans = part.column(part.num_columns - 1)
                    yield cleaned(part.select(part.schema.names[:-1]), spans)

        return found.mapInArrow(run_found, docs.schema)
    windows = _window_set(items, n)

    def run(batches):
        scan = _scan(windows.value, share)
        for batch in batches:
            for part in row_slices(batch, "text", SLICE_BYTES):
                small = pa.RecordBatch.from_arrays([pa.nulls(len(part), pa.int64()), part.column(at)], names=["doc_id", "text"])
                report = next(iter(scan(iter([small]))), None)
                if remove == "documents":
                    yield part.filter(pc.invert(report.column("contaminated")))
                else:
                    yield cleaned(part, report.column("spans"))

    return docs.mapInArrow(run, docs.schema)


def _without(text: str | None, spans: list[dict]) -> str | None:
    if text is None or not spans:
        return text
    words = find_words(pa.array([text], pa.large_string()), ALNUM, lower=True)
    raw, kept, at = text.encode(), [], 0
    for s in spans:
        kept.append(raw[at:words.starts[s["first"]]])
        at = words.ends[s["end"] - 1]
    return b"".join([*kept, raw[at:]]).decode()
