"""Token ids in a binary file format with one shared zstandard dictionary.

File layout (little endian):

    magic ``TKZ1`` | width of an id in bytes (1 byte: 2 or 4) | 32 bytes SHA-256 of the dictionary
    | one zstandard frame per document, compressed alone with the dictionary
    | index: per document doc_id int64, ids int64, frame offset int64, frame size int64
    | documents in the file int64 | offset of the index int64 | magic ``TKZ1``

A short document is read by its index entry alone: one seek, one frame.  The
dictionary lies beside the files as ``dictionary-<sha256>.zdict``.

Documents are range partitioned by ``doc_id`` and sorted inside each partition;
each partition writes files of about ``file_ids`` ids.  File names are unique per
task attempt and only files that the written manifest lists are ever read, so a
lost or repeated task leaves no trace in the result.

Defined results: null text is the empty text; an empty document holds the end id
only; rows with equal ids are stored each, in the order of their ids and texts; a
null id sorts first; an empty table gives an empty manifest and no files.
"""

from __future__ import annotations

import hashlib
import os
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import cut, locate, row_slices, unique_name, work_dir

MAGIC = b"TKZ1"
ENTRY = np.dtype([("doc_id", "<i8"), ("ids", "<i8"), ("offset", "<i8"), ("size", "<i8")])
MANIFEST = "path string, first_doc long, last_doc long, n_docs long, n_ids long, order_in_task long, task long"
SLICE_BYTES = 2 << 20
MAX_MEMO = 400_000

_encoders: dict[str, "WordEncoder"] = {}


class WordEncoder:
    """Encodes texts with a ``tokenizers`` file, each distinct piece once.

    The ids of a text are the ids of its words end to end if no token and no normalisation
    reaches over ASCII white space; a file for which that does not hold is refused.  Where the
    file makes ASCII letters, single digits and punctuation pieces of their own, plain words
    are cut there by their bytes.  Other words (with an apostrophe, a control character, a
    special token's beginning or beyond ASCII) stay whole but for their trailing punctuation, which is
    looked up on its own behind characters that normalise to a letter or digit at the end (some
    letters become a base and a mark, and the mark belongs to the punctuation's piece).

    New words of letters are encoded many at a time where the model ends each piece with a
    suffix that tells them apart again.  The memo is an Arrow array of pieces beside an array of
    ids; once it is full, it starts again with the pieces of the texts at hand.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.memo, self.flat, self.starts = pa.array([], pa.large_string()), np.zeros(0, "<u4"), np.zeros(1, np.int64)
        self.odd: dict[str, bytes] = {}
        self.closing: dict[str, bool] = {}
        ids = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        if any(ids(space.join(("Ab", "c,", "9"))) != ids("Ab") + ids("c,") + ids("9") for space in (" ", "\n", " \t\r\v\f ")):
            raise ValueError(f"{path}: tokens of this vocabulary depend on white space")
        self.lower = all(ids(f"{c}b{c}") == ids(f"{c}b{c}".lower()) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
        self.cuts = all(ids(f"a{x}{y}") == ids("a") + ids(x + y) for x in _PUNCTUATION for y in ("", ".", '"'))
        digits, marks = "0123456789", sorted(_PUNCTUATION - {"'"})
        borders = [pair for x in digits for y in (*digits, *marks, "ab", "Ab") for pair in ((x, y), (y, x))]
        borders += [pair for x in marks for y in ("ab", "Ab", "s", "t") for pair in ((x, y), (y, x))]
        self.plain = self.cuts and all(ids(x + y) == ids(x) + ids(y) for x, y in borders)
        vocabulary, suffix = self.tokenizer.get_vocab(), getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = None  # by id: whether it ends a piece
        if suffix and all(c in vocabulary and c + suffix in vocabulary for c in pre_tokenizers.ByteLevel.alphabet()):
            self.ends = np.zeros(1 + max(vocabulary.values()), bool)
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.model = Tokenizer(self.tokenizer.model)  # alone, for words of a to z, which nothing before it changes
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        probes = [*"abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyz", "thequickbrownfox", "jumpsoverthelazydog", "tokenization", "st", "fi"]
        self.bare = self.plain and self.ends is not None and ids(" ".join(probes)) == self.model.encode(" ".join(probes), add_special_tokens=False).ids

    @classmethod
    def of(cls, path: str) -> "WordEncoder":
        """One per Python worker, so that the memo lasts over tasks."""
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def _closes(self, character: str) -> bool:
        """Whether a word's last character is a letter or an ASCII digit, also once it is normalised."""
        if character.isascii():
            return character.isalnum()
        if character not in self.closing:
            normalizer = self.tokenizer.normalizer
            last = normalizer.normalize_str(character)[-1:] if normalizer else character
            self.closing[character] = character.isalpha() and last.isalpha()
        return self.closing[character]

    def _head(self, word: str) -> tuple[str, str]:
        """A word as it is looked up, and its trailing punctuation where that is a piece of its own."""
        if "<|" in word:  # may hold a special token, which is found before lower-casing
            return word, ""
        if self.lower and word.isascii():
            word = word.lower()
        end = len(word)
        while end and word[end - 1] in _PUNCTUATION:
            end -= 1
        if self.cuts and 0 < end < len(word) and self._closes(word[end - 1]):
            return word[:end], word[end:]
        return word, ""

    def _joined(self, tokenizer, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """All ids of words encoded as one text and each word's last position, if each is one piece."""
        ids = np.array(tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        last = np.flatnonzero(self.ends[ids])
        return (ids, last + 1) if len(last) == len(words) else None  # each has one piece at least

    def _odd(self, words: list[str]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers; such words are few."""
        if len(self.odd) > MAX_MEMO // 4:
            self.odd = {}
        parts = [self._head(w) for w in words]
        new = [w for w in dict.fromkeys(x for part in parts for x in part) if w not in self.odd]
        for at in range(0, len(new), 256):
            some = new[at:at + 256]
            letters = [w for w in some if w.isalpha()] if self.ends is not None else []
            if letters and (found := self._joined(self.tokenizer, letters)):
                self.odd.update(zip(letters, (part.tobytes() for part in np.split(found[0], found[1][:-1]))))
                some = [w for w in some if not w.isalpha()]
            if some:
                for word, code in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                    self.odd[word] = np.array(code.ids, "<u4").tobytes()
        return [self.odd[h] + self.odd[t] for h, t in parts]

    def _encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words end to end, and the number of ids of each."""
        plain = np.asarray(pc.match_substring_regex(words, "^[a-z]+$")) if self.bare else np.zeros(len(words), bool)
        values, where = words.filter(pa.array(plain)).to_pylist(), np.flatnonzero(plain)
        sizes, parts = np.zeros(len(words), np.int64), []
        for at in range(0, len(values), 256):
            some = where[at:at + 256]
            if found := self._joined(self.model, values[at:at + 256]):
                parts.append((some, found[0]))
                sizes[some] = np.diff(found[1], prepend=0)
            else:
                plain[some] = False
        where = np.flatnonzero(~plain)
        table = self._odd(words.filter(pa.array(~plain)).to_pylist())
        sizes[where] = np.fromiter(map(len, table), np.int64, len(table)) // 4
        parts.append((where, np.frombuffer(b"".join(table), "<u4")))
        flat, begins = np.empty(int(sizes.sum()), "<u4"), np.cumsum(sizes) - sizes
        for some, ids in parts:
            flat[_ranges(begins[some], sizes[some])] = ids
        return flat, sizes

    def _lookup(self, pieces: pa.Array) -> np.ndarray:
        """The place of each of some distinct pieces in the memo, which learns the new ones."""
        found = pc.index_in(pieces, value_set=self.memo)
        new = pieces.filter(found.is_null())
        places = np.asarray(found.fill_null(-1)).astype(np.int64)
        if len(new):
            words = pc.ascii_trim_whitespace(new).dictionary_encode()
            flat, sizes = self._encode_words(words.dictionary)
            word = np.asarray(words.indices)
            begins = np.cumsum(sizes) - sizes
            places[places < 0] = len(self.memo) + np.arange(len(new))
            self.memo = pa.concat_arrays([self.memo, new])
            self.flat = np.concatenate([self.flat, flat[_ranges(begins[word], sizes[word])]])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes[word])])
        if len(self.memo) > MAX_MEMO:
            begins, sizes = self.starts[places], np.diff(self.starts)[places]
            self.memo, self.flat, self.starts = pieces, self.flat[_ranges(begins, sizes)], np.concatenate([[0], np.cumsum(sizes)])
            places = np.arange(len(pieces))
        return places

    def _pieces(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Stretches that together are the texts, and each row's first one (one more at the end).

        A stretch is a piece with at most one white space before it, or white space alone.
        """
        texts = texts.cast(pa.large_string()).fill_null("")
        if not len(texts):
            return pa.array([], pa.large_string()), np.zeros(1, np.int64)
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(data or b"", np.uint8)[offsets[0]:offsets[-1]]
        rows = offsets - offsets[0]
        if not len(data):
            return pa.array([], pa.large_string()), np.zeros(len(rows), np.int64)
        kind = _KINDS[data]
        space = kind == _SPACE
        words = np.zeros(len(data), bool)
        words[1:] = space[1:] != space[:-1]
        after = words & ~space  # a word behind white space begins with the last of it
        words[rows[rows < len(data)]] = True
        after[rows[rows < len(data)]] = False
        words ^= after
        words[:-1] |= after[1:]
        firsts = np.flatnonzero(words)
        if self.plain:
            odd = kind == _OTHER
            odd[:-1] |= (data[:-1] == ord("<")) & (data[1:] == ord("|"))
            whole = np.repeat(np.logical_or.reduceat(odd, firsts), np.diff(firsts, append=len(data)))
            begins = kind == _DIGIT
            begins[1:] |= kind[1:] != kind[:-1]
            firsts = np.flatnonzero((begins & ~whole & ~after) | words)
            if self.lower:
                data = np.where(whole & ~space, data, _LOWER[data])
        ends = np.append(firsts, len(data))
        pieces = pa.LargeStringArray.from_buffers(len(firsts), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data)))
        return pieces, np.searchsorted(firsts, rows)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows end to end, and each row's first position (one more at the end)."""
        pieces, rows = self._pieces(texts)
        if not len(pieces):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        coded = pieces.dictionary_encode()
        places = self._lookup(coded.dictionary)[np.asarray(coded.indices)]
        begins = self.starts[places]
        sizes = self.starts[places + 1] - begins
        return self.flat[_ranges(begins, sizes)], np.concatenate([[0], np.cumsum(sizes)])[rows]


def _ranges(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of stretches, end to end."""
    ends = np.cumsum(sizes)
    return np.repeat(begins - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


_PUNCTUATION = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_SPACE, _LETTER, _DIGIT, _MARK, _OTHER = range(5)
_KINDS = np.full(256, _OTHER, np.uint8)
_KINDS[list(b" \t\n\v\f\r")] = _SPACE
_KINDS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = _LETTER
_KINDS[list(b"0123456789")] = _DIGIT
_KINDS[[ord(c) for c in _PUNCTUATION - {"'"}]] = _MARK
_LOWER = np.where(_KINDS == _SPACE, ord(" "), np.frombuffer(bytes(range(256)).lower(), np.uint8)).astype(np.uint8)


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, width: int, sample: int, dictionary_bytes: int) -> bytes:
    """A zstandard dictionary from the first 4,096 ids of at most ``sample`` documents, the least by a hash of their id.

    The hash is cut off where about ``sample`` documents are expected below it, so that no
    more than those leave their tasks.  It is trained in one task over the first 16,384
    characters of these; the sample decides the size of the files, never their ids.
    """
    held = docs.where("text is not null").select("doc_id", "text")
    share = min(1.0, 1.2 * sample / max(1, held.count()))
    rank = F.xxhash64("doc_id") / float(1 << 64) + 0.5
    chosen = held.where(rank <= share).select(F.substring("text", 1, 16_384).alias("text"), rank.alias("rank")).orderBy("rank", "text").limit(sample)

    def train(batches):
        samples = []
        for batch in batches:
            for part in row_slices(batch, "text", SLICE_BYTES):
                ids, firsts = WordEncoder.of(tokenizer).encode(part.column("text"))
                samples += [np.append(ids[a:b][:4096], end_id).astype(f"<u{width}").tobytes() for a, b in zip(firsts[:-1], firsts[1:])]
        try:
            found = zstandard.train_dictionary(dictionary_bytes, samples).as_bytes()
        except zstandard.ZstdError:  # too little to learn from: an own dictionary of plain content
            found = b"".join(samples)[:dictionary_bytes]
        yield pa.RecordBatch.from_arrays([pa.array([found], pa.binary())], names=["dictionary"])

    trained = chosen.select("text").repartition(1).mapInArrow(train, "dictionary binary").first()
    return bytes(trained["dictionary"]) if trained else b""


@dataclass
class TokenStore:
    """A written store: ``manifest`` has a row per file with the ids before it (``start``)."""

    spark: SparkSession
    root: str
    dictionary_hash: str
    manifest: DataFrame

    def files(self) -> DataFrame:
        order = Window.orderBy("task", "order_in_task")  # a row per file, not per document
        return self.manifest.withColumn("start", F.sum("n_ids").over(order) - F.col("n_ids"))

    def documents(self) -> DataFrame:
        """doc_id, start, n_tokens, ids_crc32 of every stored document, from the files."""
        root, digest = self.root, self.dictionary_hash

        def run(batches):
            dictionary = read_dictionary(root, digest)
            for batch in batches:
                for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                    file = TokenFile(path, dictionary)
                    entries = file.entries
                    for at in range(0, len(entries), 4096):
                        some = entries[at:at + 4096]
                        crcs = [zlib.crc32(file.ids(k).astype("<u4").tobytes()) for k in range(at, at + len(some))]
                        starts = start + np.concatenate([[0], np.cumsum(some["ids"])])
                        start = int(starts[-1])
                        yield pa.RecordBatch.from_arrays([pa.array(file.doc_ids[at:at + len(some)], pa.int64()), pa.array(starts[:-1], pa.int64()), pa.array(some["ids"], pa.int64()), pa.array(crcs, pa.int64())],
                                                         names=["doc_id", "start", "n_tokens", "ids_crc32"])

        files = self.files().select("path", "start")
        n = max(1, self.manifest.count())
        return files.repartition(n, "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


class TokenFile:
    """Random access to one file: the index is read first, then single frames."""

    NULL_ID = -(1 << 63)

    def __init__(self, path: str, dictionary: bytes):
        system, where = locate(path)
        self.file = system.open_input_file(where)
        size = self.file.size()
        self.file.seek(size - 20)
        count, index, magic = struct.unpack("<qq4s", self.file.read(20))
        self.file.seek(0)
        head, width, digest = struct.unpack("<4sB32s", self.file.read(37))
        if magic != MAGIC or head != MAGIC:
            raise ValueError(f"{path} is no token file")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{path} was written with another dictionary")
        self.width = width
        self.file.seek(index)
        self.entries = np.frombuffer(self.file.read(count * ENTRY.itemsize), ENTRY)
        self.doc_ids = [None if i == self.NULL_ID else i for i in self.entries["doc_id"].tolist()]
        self.reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))

    def ids(self, k: int) -> np.ndarray:
        """The ids of the file's k-th document."""
        entry = self.entries[k]
        self.file.seek(int(entry["offset"]))
        raw = self.reader.decompress(self.file.read(int(entry["size"])), max_output_size=int(entry["ids"]) * self.width)
        return np.frombuffer(raw, f"<u{self.width}")


class _FileWriter:
    def __init__(self, root: str, dictionary: bytes, width: int):
        self.path = f"{root}/{unique_name('ids', '.tkz')}"
        system, where = locate(self.path)
        self.out = system.open_output_stream(where)
        self.width, self.entries, self.n_ids = width, [], 0
        self.press = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary))
        self.out.write(struct.pack("<4sB32s", MAGIC, width, hashlib.sha256(dictionary).digest()))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        frame = self.press.compress(ids.astype(f"<u{self.width}").tobytes())
        self.entries.append((TokenFile.NULL_ID if doc_id is None else doc_id, len(ids), self.out.tell(), len(frame)))
        self.out.write(frame)
        self.n_ids += len(ids)

    def close(self) -> tuple:
        index = self.out.tell()
        self.out.write(np.array(self.entries, ENTRY).tobytes())
        self.out.write(struct.pack("<qq4s", len(self.entries), index, MAGIC))
        self.out.close()
        ids = [None if e[0] == TokenFile.NULL_ID else e[0] for e in (self.entries[0], self.entries[-1])]
        return self.path, *ids, len(self.entries), self.n_ids


def read_dictionary(root: str, digest: str) -> bytes:
    system, where = locate(f"{root}/dictionary-{digest}.zdict")
    with system.open_input_stream(where) as f:
        return f.read()


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 1, vocabulary: int = 49_408, root: str | None = None, file_ids: int = 16_000_000, sample: int = 1_000, dictionary_bytes: int = 112_640) -> TokenStore:
    """Encode whole texts, append ``end_id`` to each, and write them in ascending ``doc_id`` order.

    ``tokenizer`` is the path of a ``tokenizers`` file that every executor can read.
    """
    from pyspark import TaskContext

    spark = docs.sparkSession
    root = root or work_dir(spark, "tokens")
    width = 2 if vocabulary <= 1 << 16 else 4
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dictionary = train_dictionary(texts, tokenizer, end_id, width, sample, dictionary_bytes)
    digest = hashlib.sha256(dictionary).hexdigest()
    system, where = locate(root)
    system.create_dir(where)
    with system.open_output_stream(f"{where}/dictionary-{digest}.zdict") as f:
        f.write(dictionary)

    def run(batches):
        encoder, words = WordEncoder.of(tokenizer), read_dictionary(root, digest)
        task, out, done = TaskContext.get().partitionId(), None, []
        for batch in batches:
            for part in row_slices(batch, "text", SLICE_BYTES):
                ids, firsts = encoder.encode(part.column("text"))
                for doc_id, a, b in zip(part.column("doc_id").to_pylist(), firsts[:-1], firsts[1:]):
                    out = out or _FileWriter(root, words, width)
                    out.add(doc_id, np.append(ids[a:b], np.uint32(end_id)))
                    if out.n_ids >= file_ids:
                        done.append((*out.close(), len(done), task))
                        out = None
        if out:
            done.append((*out.close(), len(done), task))
        if done:
            names = ["path", "first_doc", "last_doc", "n_docs", "n_ids", "order_in_task", "task"]
            types = [pa.string(), *[pa.int64()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=names)

    ordered = texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return TokenStore(spark, root, digest, cut(ordered.mapInArrow(run, MANIFEST), "tokens-manifest"))
