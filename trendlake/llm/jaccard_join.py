"""N-gram Jaccard join by T-occurrence search (DivideSkip) inside exact candidate groups.

A document's set holds its distinct ``k``-word shingles (64-bit hashes of the words
themselves).  Two documents link when ``100 * |x & y| >= percent * |x | y|``.

1. Documents with one and the same set collapse to a class (128-bit digest of the
   sorted set); only class representatives are joined, copies follow by membership.
2. Shingles are ordered by how common their words are (counts of all words of the
   corpus, in a fixed number of buckets by word hash), then by hash, and the corpus-wide
   longest inverted lists (at most ``max_long``; a sum over all documents) last.  In this
   order two linked sets share one of their first ``n - ceil(n * percent / 100) + 1``
   shingles: these short lists are searched, the long ones are only probed.  Rare words
   first means that unrelated documents seldom share one.  Any one order gives the same links.
3. A list is cut into cells by set size (sizes in the proportion ``percent`` lie in
   the same or neighbouring size classes).  Each cell names its smallest member; the
   members of all cells with that name form one group, so each pair that shares a
   short list meets in a group, and a document is sent once for each name, not once
   for each list.  A group of more than ``block`` members is split by a hash into
   blocks, and each pair of blocks becomes a group of its own, so no task has to
   hold more than two blocks; nothing is dropped.
4. In a group, DivideSkip answers each member's query: its lists in the group are
   sorted by length, the longest are set aside, the short ones are merged by count,
   documents that may still reach the overlap are probed for by binary search in the
   long lists.  It runs twice.  First over wide prefixes (four times as many shingles, 16
   bits of each, which can only add to an overlap), where linked sets must share one shingle
   more than both hold beyond their prefixes: members without such a partner in the group leave it.  Then over the whole
   sets of those that stay.  Only links leave the task, as edges to the representative
   of what is linked already, so linked copies are not expanded into all pairs.

Defined results: null, empty and wordless texts have an empty set and link with
nothing; a text of fewer than ``k`` words is one shingle; repeated rows of one
doc_id are one node that links where any of its texts does; rows without doc_id
are in no class and get null.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .store import cut, row_slices
from .words import NOT_SPACE, find_words, shingle_hashes

SLICE_BYTES = 1 << 20
#: A list of fewer documents is never set aside as long.
LONG_LIST = 32
#: Words are counted in this many buckets (the size of the broadcast table, whatever the corpus).
WORD_BUCKETS = 1 << 16
#: Rows of 64 bits of the bitmap that tells which whole texts may be needed (2 MB).
BITMAP_WORDS = 1 << 17
#: The upper bits of a shingle that hold its place in the order; the rest is its hash.
LEVEL_BITS = 6


def _buckets(word_hashes: np.ndarray) -> np.ndarray:
    return (word_hashes & np.uint64(WORD_BUCKETS - 1)).astype(np.int64)


def _word_counts(batches):
    """The words of a task in each bucket."""
    counts = np.zeros(WORD_BUCKETS, np.int64)
    for part in _slices(batches):
        words = find_words(part.column("text"), NOT_SPACE, lower=True)
        if len(words.starts):
            counts += np.bincount(_buckets(words.hashes()), minlength=WORD_BUCKETS)
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["bucket", "n"])


def word_levels(texts: DataFrame) -> np.ndarray:
    """log2 of the words in each bucket, over all of ``texts``."""
    counts = np.ones(WORD_BUCKETS, np.int64)
    for r in texts.mapInArrow(_word_counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most WORD_BUCKETS rows
        counts[r["bucket"]] = r["n"]
    return np.log2(counts).astype(np.float32)


def shingle_sets(texts: pa.Array, k: int, levels: np.ndarray | None = None) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row; with ``levels`` (of ``word_levels``) shingles of rare words come first."""
    words = find_words(texts, NOT_SPACE, lower=True)
    if not len(words.starts):
        return [np.zeros(0, np.uint64)] * len(texts)
    hashes = words.hashes()
    windows = shingle_hashes(hashes, k)
    if levels is not None and len(windows):
        of_words = levels[_buckets(hashes)]
        total = of_words[:len(windows)].copy()
        for j in range(1, k):
            total += of_words[j:j + len(windows)]
        level = np.minimum(total * np.float32(2 / k), (1 << LEVEL_BITS) - 1).astype(np.uint64)
        windows = (windows >> np.uint64(LEVEL_BITS)) | (level << np.uint64(64 - LEVEL_BITS))
    out = []
    for first, end in zip(words.firsts[:-1].tolist(), words.firsts[1:].tolist()):
        n = end - first
        out.append(np.unique(windows[first:end - k + 1]) if n >= k else shingle_hashes(hashes[first:end], n) if n else np.zeros(0, np.uint64))
    return out


def prefix_length(n: int, percent: int) -> int:
    return n + (-percent * n // 100) + 1


def extra_length(p: int) -> int:
    """How many shingles beyond the prefix of length ``p`` the wide prefix holds (fewer where the set ends)."""
    return max(2, 3 * p)


def size_classes(percent: int, most: int = 1 << 40) -> np.ndarray:
    """Lower borders such that sizes in proportion ``percent`` are at most one class apart."""
    borders = [1]
    while borders[-1] < most:
        borders.append(max(borders[-1] + 1, -(-borders[-1] * 100 // percent)))
    return np.array(borders)


def _slices(batches):
    for batch in batches:
        yield from row_slices(batch, "text", SLICE_BYTES)


def _flat(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    values = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int64()))


def _prefix_hashes(k: int, percent: int, levels: np.ndarray):
    def run(batches):
        for part in _slices(batches):
            got = [s[:prefix_length(len(s), percent)] for s in shingle_sets(part.column("text"), k, levels) if len(s)]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(got).view(np.int64))], names=["h"])
    return run


def _set_rows(k: int, percent: int, long: np.ndarray, levels: np.ndarray):
    def run(batches):
        for part in _slices(batches):
            sets = shingle_sets(part.column("text"), k, levels)
            digests, firsts, wide = [], [], []
            for s in sets:
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                is_long = np.zeros(len(s), bool)
                if len(long) and len(s):
                    at = np.searchsorted(long, s)
                    at[at == len(long)] = 0
                    is_long = long[at] == s
                ordered = np.concatenate([s[~is_long], s[is_long]])
                p = prefix_length(len(s), percent) if len(s) else 0
                firsts.append(ordered[:p])
                wide.append((ordered[:p + extra_length(p)] >> np.uint64(20)).astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), _flat(firsts), pa.array(wide, pa.binary())],
                                             names=["doc_id", "n", "digest", "firsts", "wide"])
    return run


def t_occurrences(sets: list[np.ndarray], need: np.ndarray, allow):
    """DivideSkip: for each member ``x``, the later members ``y`` that share ``need[x]`` tokens or more, and how many.

    ``allow(x, ys)`` tells which of some members are of interest as partners of ``x``.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    tokens = np.concatenate(sets)
    owners = np.repeat(np.arange(m, dtype=np.int32), sizes)
    order = np.lexsort((owners, tokens))
    tokens, owners = tokens[order], owners[order]
    new = np.concatenate([[True], tokens[1:] != tokens[:-1]])
    begins = np.flatnonzero(new)
    lengths = np.diff(np.append(begins, len(tokens)))
    lists_of = np.empty(len(tokens), np.int64)
    lists_of[order] = np.cumsum(new) - 1
    at = np.concatenate([[0], np.cumsum(sizes)])
    for x in range(m):
        least = int(need[x])
        mine = lists_of[at[x]:at[x + 1]]
        mine = mine[lengths[mine] > 1]
        if len(mine) < least:
            continue
        mine = mine[np.argsort(lengths[mine], kind="stable")]
        longest = int(lengths[mine[-1]])
        aside = max(0, min(least - 1, int(least / (0.01 * math.log2(longest) + 1))))
        short, skipped = mine[:len(mine) - aside], mine[len(mine) - aside:]
        spans = lengths[short]
        ends = np.cumsum(spans)
        merged = owners[np.repeat(begins[short] - (ends - spans), spans) + np.arange(ends[-1])]
        counts = np.bincount(merged, minlength=m)
        ys = np.flatnonzero(counts >= max(1, least - aside))
        ys = ys[ys > x]
        ys = ys[allow(x, ys)]
        overlap = counts[ys].astype(np.int64)
        for k, of in enumerate(skipped.tolist()):
            if not len(ys):
                break
            found = owners[begins[of]:begins[of] + lengths[of]]
            place = np.searchsorted(found, ys)
            place[place == len(found)] = 0
            overlap += found[place] == ys
            if k % 16 == 15:
                alive = overlap + (len(skipped) - 1 - k) >= least
                ys, overlap = ys[alive], overlap[alive]
        enough = overlap >= least
        if enough.any():
            yield x, ys[enough], overlap[enough]


def divide_skip(sets: list[np.ndarray], percent: int, tags: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Index pairs of linked sets, as edges that connect every linked pair (not each of them).

    ``tags``: where given, only pairs of different tags are looked for.
    """
    sizes = np.array([len(s) for s in sets])
    root = np.arange(len(sets))
    edges = []

    def allow(x, ys):
        return (root[ys] != root[x]) & _near(sizes, x, ys, percent) & (True if tags is None else tags[ys] != tags[x])

    for x, ys, overlap in t_occurrences(sets, -(-percent * sizes // 100), allow):
        for y in ys[100 * overlap >= percent * (sizes[ys] + sizes[x] - overlap)].tolist():
            if root[y] != root[x]:
                edges.append((x, y))
                root[root == root[y]] = root[x]
    return edges


def _near(sizes: np.ndarray, x: int, ys: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(sizes[ys], sizes[x]) >= percent * np.maximum(sizes[ys], sizes[x])


def with_partner(wide: list[np.ndarray], sizes: np.ndarray, percent: int, tags: np.ndarray | None = None) -> np.ndarray:
    """Which members may be linked with another one, by their wide prefixes: linked sets share one shingle more than both have beyond their prefixes."""
    extra = np.array([len(w) - prefix_length(int(n), percent) for w, n in zip(wide, sizes)])
    out = np.zeros(len(wide), bool)

    def allow(x, ys):
        return ~(out[x] & out[ys]) & _near(sizes, x, ys, percent) & (True if tags is None else tags[ys] != tags[x])

    for x, ys, overlap in t_occurrences(wide, np.full(len(wide), 1 + extra.min()), allow):
        ys = ys[overlap > np.minimum(extra[ys], extra[x])]
        if len(ys):
            out[x] = out[ys] = True
    return out


def _by_group(columns: tuple[str, ...], solve, names: list[str]):
    """``solve(group, rows)`` for each run of rows with one (pivot, low, high); a group is whole before the next begins."""
    def run(batches):
        key, rows = None, []
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("pivot", "low", "high", *columns))):
                if row[:3] != key:
                    if len(rows) > 1:
                        out += solve(key, rows)
                    key, rows = row[:3], []
                rows.append(row[3:])
            yield _longs(out, names)
        if len(rows) > 1:
            yield _longs(solve(key, rows), names)
    return run


def _longs(rows, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))], names=names)


def _tags(rows) -> np.ndarray | None:
    """The blocks of a group's rows where it compares two of them."""
    blocks = np.array([r[0] for r in rows])
    return blocks if len(set(blocks.tolist())) > 1 else None


def _filter(percent: int):
    def solve(key, rows):
        if key[1] != key[2] and _tags(rows) is None:
            return []
        keep = with_partner([np.frombuffer(r[3], np.uint16) for r in rows], np.array([r[2] for r in rows]), percent, _tags(rows))
        return [(*key, r[0], r[1]) for r, k in zip(rows, keep) if k]

    return _by_group(("block", "node", "n", "wide"), solve, ["pivot", "low", "high", "block", "node"])


def _search(percent: int):
    def solve(key, rows):
        if key[1] != key[2] and _tags(rows) is None:
            return []
        return [(rows[a][1], rows[b][1]) for a, b in divide_skip([np.frombuffer(r[2], np.uint64) for r in rows], percent, _tags(rows))]

    return _by_group(("block", "node", "shingles"), solve, ["a", "b"])


def _member_sets(k: int):
    def run(batches):
        for part in _slices(batches):
            sets = shingle_sets(part.column("text"), k)
            groups = part.column("groups").to_pylist()
            rows = [(g["pivot"], g["low"], g["high"], g["block"], d, s) for d, s, gs in zip(part.column("doc_id").to_pylist(), (x.tobytes() for x in sets), groups) for g in gs]
            for at in range(0, len(rows), 512):
                some = list(zip(*rows[at:at + 512]))
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in some[:5]], pa.array(some[5], pa.binary())], names=["pivot", "low", "high", "block", "node", "shingles"])
    return run


def _perhaps_in(texts: DataFrame, kept: DataFrame) -> DataFrame:
    """``texts`` without most of those that ``kept`` has no node for, so that the join after it sends fewer whole texts.

    A bitmap of hashed nodes with ``BITMAP_WORDS`` rows at most, whatever the input, is
    broadcast.  It only ever lets too many through (more of them the fuller it is).
    """
    def place(column):
        at = F.pmod(F.xxhash64(column), F.lit(BITMAP_WORDS * 64))
        return F.shiftright(at, 6).alias("word"), F.pmod(at, F.lit(64)).cast("int")

    word, bit = place("node")
    bitmap = kept.select(word, F.expr("1L").alias("one"), bit.alias("bit")).groupBy("word").agg(F.bit_or(F.call_function("shiftleft", F.col("one"), F.col("bit"))).alias("bits"))
    word, bit = place("doc_id")
    marked = texts.select("doc_id", "text", word, bit.alias("bit")).join(F.broadcast(bitmap), "word")
    return marked.where(F.call_function("shiftright", F.col("bits"), F.col("bit")).bitwiseAND(F.lit(1)) == 1).select("doc_id", "text")


def jaccard_classes(docs: DataFrame, k: int = 5, percent: int = 80, block: int = 1024, max_long: int = 65_536) -> DataFrame:
    """``doc_id, n_shingles, class_id, component_id`` for each row of ``docs``.

    ``class_id`` is the least doc_id with the very same set, ``component_id`` the least
    doc_id reachable by links.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    levels = texts.sparkSession.sparkContext.broadcast(word_levels(texts))
    counted = texts.mapInArrow(lambda b: _prefix_hashes(k, percent, levels.value)(b), "h long").groupBy("h").count().where(F.col("count") >= LONG_LIST)
    long = np.array([r["h"] for r in counted.orderBy(F.desc("count"), "h").limit(max_long).select("h").collect()], np.int64).view(np.uint64)
    long = texts.sparkSession.sparkContext.broadcast(np.sort(long))  # at most max_long * 8 bytes
    rows = cut(texts.mapInArrow(lambda b: _set_rows(k, percent, long.value, levels.value)(b), "doc_id long, n long, digest binary, firsts array<long>, wide binary"), "sets")

    in_class = rows.where("n > 0 and doc_id is not null").groupBy("digest")
    # One struct, so that both uses of the postings have one and the same aggregate and share its shuffle.
    first = in_class.agg(F.min_by(F.struct("doc_id", "n", "firsts"), "doc_id").alias("c"))
    postings = first.select(F.col("c.doc_id").alias("node"), F.col("c.n").alias("n"), F.explode("c.firsts").alias("h"))
    shared = postings.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h")
    borders = F.array(*[F.lit(int(b)) for b in size_classes(percent, 1 << 31)])
    size_class = F.size(F.filter(borders, lambda b: b <= F.col("n")))
    cells = postings.join(shared, "h").withColumn("class", size_class).withColumn("cell", F.explode(F.array(F.col("class"), F.col("class") + 1)))
    cells = cut(cells.select("h", "cell", "node", "n"), "cells")
    pivots = cells.groupBy("h", "cell").agg(F.min(F.struct("n", "node")).alias("least"), F.count("*").alias("c")).where("c > 1").select("h", "cell", F.col("least.node").alias("pivot"))
    members = cut(cells.join(pivots, ["h", "cell"]).select("pivot", "node").distinct(), "members")

    sizes = members.groupBy("pivot").agg(F.ceil(F.count("*") / block).alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    placed = members.join(sizes, "pivot").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    placed = placed.select("pivot", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), F.col("own").alias("block"), "node")
    dealt = lambda df: df.repartition("pivot", "low", "high").sortWithinPartitions("pivot", "low", "high")
    narrow = placed.join(rows.select(F.col("doc_id").alias("node"), "n", "wide"), "node").select("pivot", "low", "high", "block", "node", "n", "wide")
    kept = cut(dealt(narrow).mapInArrow(_filter(percent), "pivot long, low long, high long, block long, node long"), "partners")
    wanted = kept.distinct().groupBy("node").agg(F.collect_list(F.struct("pivot", "low", "high", "block")).alias("groups"))
    held = _perhaps_in(texts, kept).join(wanted, F.col("doc_id") == wanted.node).select("doc_id", "text", "groups")
    sent = held.mapInArrow(_member_sets(k), "pivot long, low long, high long, block long, node long, shingles binary")
    links = dealt(sent).mapInArrow(_search(percent), "a long, b long")

    joined = components(links)
    return _with_components(rows, in_class.agg(F.min("doc_id").alias("rep")), joined)


def _with_components(rows: DataFrame, classes: DataFrame, joined: DataFrame) -> DataFrame:
    named = classes.select("digest", F.col("rep").alias("class_id")).join(joined, F.col("class_id") == joined.node, "left")
    named = named.select("digest", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    real = rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("digest")).alias("digest"))
    out = real.join(named, "digest", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with the document of least doc_id of every component, and every document that links with nothing.

    Of repeated rows with a kept doc_id the one of least text stays (then of least other
    columns); rows without doc_id all stay.
    """
    classes = jaccard_classes(docs, k, percent).where("doc_id = component_id").select("doc_id").distinct()
    columns = [F.col(f"`{c}`") for c in docs.columns]
    ordered = [F.col(f"`{f.name}`") for f in docs.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    row = F.min_by(F.struct(*columns), F.struct("text", *ordered)).alias("row")
    kept = docs.join(classes, "doc_id", "left_semi").select(docs.columns).groupBy("doc_id").agg(row)
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns]).unionByName(docs.where("doc_id is null"))
