"""Target-distribution importance resampling over hashed one- and two-word features.

A dictionary of frequent words is compiled to an Aho-Corasick automaton.  Its keys are words
between two delimiters, so each place of a text matches at most one key, and each key carries
the word's CRC-32 and length.  One scan of a text thus emits the CRC of its words; the CRC of
two neighbouring words is composed from their CRCs and lengths (a CRC over joined strings is
linear), so no pair of words is ever spelled out.  Words outside the dictionary are found as
the word starts that no match covers and get their CRC from their bytes: the dictionary
decides the speed, never a result.

The buckets of all features are counted over both tables (a row per bucket and task), the
gain of each bucket is broadcast (``buckets`` numbers), and every document gets the floored
mean of the gains of its features plus a Gumbel number made from its id: the highest sums are
a sample without replacement by importance weight.  Ranks over all documents come from a range
partitioned, sorted, written table: a row's rank is its place within its partition plus the
rows of the partitions before it, so no task ever holds all rows.

Defined results: null text has no words; a null id draws its Gumbel number as the empty text
and sorts first among ties; rows of one id are scored each (equal rows take neighbouring
ranks); an empty table of documents gives no rows, and an empty target gives every bucket the
count 0; other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import functools
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import cut, row_slices
from .words import ALNUM, LOWER, find_words, text_bytes

SLICE_BYTES = 4 << 20
BLOCK_BYTES = 4 << 20
LONGEST_KEY = 64
SPACE = 0x20
#: Word bytes lower-cased, everything else a delimiter.
PLAIN = np.where(ALNUM[LOWER], LOWER, np.uint8(SPACE))

#: CRC-32 of one byte after another, least bit first (the reflected polynomial is a fixed value).
_BYTE_STEP = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _BYTE_STEP = np.where(_BYTE_STEP & 1, np.uint32(0xEDB88320) ^ (_BYTE_STEP >> np.uint32(1)), _BYTE_STEP >> np.uint32(1))


def _apply(columns: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A linear map over 32 bits, given by what it makes of each single bit."""
    out = np.zeros_like(values)
    for bit in range(32):
        out ^= np.where((values >> np.uint32(bit)) & np.uint32(1), columns[bit], np.uint32(0))
    return out


@functools.lru_cache(maxsize=1024)
def _zeros_table(n: int) -> np.ndarray:
    """What ``n`` zero bytes make of a CRC register, as four tables for its four bytes."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    step = _BYTE_STEP[bits & np.uint32(0xFF)] ^ (bits >> np.uint32(8))
    total = bits
    while n:
        if n & 1:
            total = _apply(step, total)
        step = _apply(step, step)
        n >>= 1
    values = np.arange(256, dtype=np.uint32)
    return np.stack([_apply(total, values << np.uint32(8 * k)) for k in range(4)])


@functools.lru_cache(maxsize=1)
def _short_tables() -> np.ndarray:
    return np.stack([_zeros_table(n) for n in range(LONGEST_KEY + 1)])


def join_crcs(first: np.ndarray, second: np.ndarray, second_size: np.ndarray) -> np.ndarray:
    """CRC-32 of two joined strings from the CRC-32 of each and the second one's size."""
    tables = _short_tables()
    size = np.minimum(second_size, LONGEST_KEY)
    moved = second.copy()
    for k in range(4):
        moved ^= tables[size, k, (first >> np.uint32(8 * k)) & np.uint32(0xFF)]
    for n in np.unique(second_size[second_size > LONGEST_KEY]).tolist():
        at = np.flatnonzero(second_size == n)
        table = _zeros_table(n)
        moved[at] = second[at]
        for k in range(4):
            moved[at] ^= table[k, (first[at] >> np.uint32(8 * k)) & np.uint32(0xFF)]
    return moved


def with_space(crc: np.ndarray) -> np.ndarray:
    """CRC-32 after one more space."""
    register = ~crc
    return ~(_BYTE_STEP[(register ^ np.uint32(SPACE)) & np.uint32(0xFF)] ^ (register >> np.uint32(8)))


class WordAutomaton:
    """Emits the CRC-32 and length of each word of a text."""

    def __init__(self, words: list[bytes]):
        import ahocorasick

        self.crc = np.array([zlib.crc32(w) for w in words], np.uint32)
        self.size = np.array([len(w) for w in words], np.int64)
        self.automaton = ahocorasick.Automaton()
        for k, word in enumerate(words):  # one character for each byte
            self.automaton.add_word(f" {word.decode('latin-1')} ", k)
        if words:
            self.automaton.make_automaton()

    @classmethod
    @functools.lru_cache(maxsize=1)
    def of(cls, packed: bytes) -> "WordAutomaton":
        """One per Python worker for each dictionary (its words, joined by spaces)."""
        return cls(packed.split())

    def _matches(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte and number of each dictionary word of a block that begins and ends with a delimiter."""
        if not len(self.crc):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs = self.automaton.iter(block.tobytes().decode("latin-1"))
        found = np.fromiter(chain.from_iterable(pairs), np.int64).reshape(-1, 2)
        word = found[:, 1]
        return found[:, 0] - self.size[word], word

    def _scan(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First byte, CRC and length of every word of a block, in order."""
        at, word = self._matches(block)
        inside = block != SPACE
        begins, stops = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        stops[:-1] &= ~inside[1:]
        begins[at] = False
        stops[at + self.size[word] - 1] = False
        first, last = np.flatnonzero(begins), np.flatnonzero(stops)  # words that no match covers
        crc, size = self.crc[word], self.size[word]
        if len(first):
            raw = block.tobytes()
            other = np.fromiter((zlib.crc32(raw[a:b + 1]) for a, b in zip(first.tolist(), last.tolist())), np.uint32, len(first))
            at, crc, size = np.concatenate([at, first]), np.concatenate([crc, other]), np.concatenate([size, last + 1 - first])
            order = np.argsort(at, kind="stable")
            at, crc, size = at[order], crc[order], size[order]
        return at, crc, size

    def words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """CRC, length and row of every word of the rows."""
        data, offsets = text_bytes(texts)
        rows = len(offsets) - 1
        padded = np.full(len(data) + rows + 1, SPACE, np.uint8)  # a delimiter before, between and behind the rows
        padded[np.arange(len(data)) + np.repeat(np.arange(rows), np.diff(offsets)) + 1] = PLAIN[data]
        spaces, parts, begin = np.flatnonzero(padded == SPACE), [], 0
        while begin < len(padded) - 1:  # neighbouring blocks share a delimiter
            end = int(spaces[min(np.searchsorted(spaces, begin + BLOCK_BYTES), len(spaces) - 1)])
            at, crc, size = self._scan(padded[begin:end + 1])
            parts.append((at + begin, crc, size))
            begin = end
        if not parts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, crc, size = (np.concatenate(p) for p in zip(*parts))
        row_at = offsets[:-1] + np.arange(rows)  # the delimiter before each row
        return crc, size, np.searchsorted(row_at, at, side="right") - 1

    def features(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """CRC and row of every feature (words, then pairs of neighbours), and the words of each row."""
        crc, size, row = self.words(texts)
        pair = np.flatnonzero(row[1:] == row[:-1])
        joined = join_crcs(with_space(crc[pair]), crc[pair + 1], size[pair + 1])
        return np.concatenate([crc, joined]), np.concatenate([row, row[pair]]), np.bincount(row, minlength=len(texts))


def _slices(batches):
    for batch in batches:
        yield from row_slices(batch, "text", SLICE_BYTES)


def _word_counts(batches):
    """The distinct words of each slice with their counts."""
    for part in _slices(batches):
        words = find_words(part.column("text"), ALNUM, lower=True)
        short = words.ends - words.starts <= LONGEST_KEY
        _, first, n = np.unique(words.hashes()[short], return_index=True, return_counts=True)
        starts, ends = words.starts[short][first], words.ends[short][first]
        raw = words.data.tobytes()
        spelled = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(spelled, pa.binary()), pa.array(n, pa.int64())], names=["word", "n"])


def word_dictionary(texts: DataFrame, words: int) -> bytes:
    """At most ``words`` frequent words of at most 64 bytes, counted over all rows, joined by spaces.

    A histogram of the counts (eight levels for each doubling) gives the least level from
    which on no more than ``words`` words are left, so only those reach the driver.
    """
    counts = texts.select("text").mapInArrow(_word_counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = cut(counts.where("n > 1").select("word", F.floor(8 * F.log2("n")).cast("int").alias("level")), "importance-words")
    taken, least = 0, 1 << 30
    for r in sorted(counts.groupBy("level").count().collect(), reverse=True):
        taken += r["count"]
        if taken > words:
            break
        least = r["level"]
    return b" ".join(sorted(bytes(r["word"]) for r in counts.where(F.col("level") >= least).select("word").collect()))


def bucket_counts(texts: DataFrame, dictionary, buckets: int) -> np.ndarray:
    """How many features of all rows fall into each bucket.  ``dictionary``: a broadcast of ``word_dictionary``."""
    def run(batches):
        automaton, total = WordAutomaton.of(dictionary.value), np.zeros(buckets, np.int64)
        for part in _slices(batches):
            crc, _, _ = automaton.features(part.column("text"))
            total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the log ratio of a bucket's smoothed shares in target and source, floored."""
    s, t, buckets = source.astype(float), target.astype(float), len(source)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def gumbel(doc_id: Column, seed: str) -> Column:
    """A thousand times a Gumbel number made from the id, floored."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def importance_scores(docs: DataFrame, target: DataFrame, buckets: int = 10_000, seed: str = "7", dictionary_words: int = 65_536) -> DataFrame:
    """doc_id, text, n_words, n_features, weight and score of every row of ``docs`` (``target`` needs a text column)."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    wanted = target.select("text")
    dictionary = spark.sparkContext.broadcast(word_dictionary(texts.select("text").unionByName(wanted), dictionary_words))
    gains = spark.sparkContext.broadcast(bucket_gains(bucket_counts(texts, dictionary, buckets), bucket_counts(wanted, dictionary, buckets)))

    def run(batches):
        automaton, gain = WordAutomaton.of(dictionary.value), gains.value
        for part in _slices(batches):
            crc, row, n_words = automaton.features(part.column("text"))
            n = np.bincount(row, minlength=len(part))
            total = np.bincount(row, weights=gain[crc % np.uint32(buckets)], minlength=len(part)).astype(np.int64)
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), *(pa.array(x, pa.int64()) for x in (n_words, n, weight))], names=["doc_id", "text", "n_words", "n_features", "weight"])

    scored = texts.mapInArrow(run, "doc_id long, text string, n_words long, n_features long, weight long")
    return scored.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))


def with_rank(scored: DataFrame, percent: int = 25, min_words: int = 20) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3 ... by falling score and rising doc_id for the drawn share of the rows of at least ``min_words`` words, else null."""
    open_ = F.col("n_words") >= min_words
    order = [(~open_).asc(), F.desc("score"), F.asc("doc_id"), F.asc("weight"), F.asc("n_features")]
    placed = scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    placed = cut(placed, "importance-places")  # partition number and place in it, fixed once written
    partition, place = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(partition.alias("partition")).agg(F.count("*").alias("n"), F.count_if(open_).alias("n_open"))
    before = Window.orderBy("partition").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition, not per document
    sizes = sizes.select("partition", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n_open").over(Window.partitionBy()).alias("n_open"))
    ranked = placed.join(F.broadcast(sizes), partition == sizes.partition)
    nth = F.col("before") + place + 1
    drawn = F.floor(F.col("n_open") * percent / 100)
    return ranked.select(*scored.columns, F.when(open_ & (nth <= drawn), nth).alias("rank"))


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, **scoring) -> DataFrame:
    """The drawn documents (doc_id, text, weight, score, rank) that look most like ``target``, with Gumbel noise."""
    scored = importance_scores(docs, target, **scoring)
    return with_rank(scored, percent, min_words).where("rank is not null").select("doc_id", "text", "weight", "score", "rank")
