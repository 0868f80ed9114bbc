"""Language identification by segmentation-marginalised unigrams.

The pieces of a fixed public vocabulary get a probability for each language.  A word
(ASCII white space cuts; each word starts with the vocabulary's word mark) may be
segmented into pieces in many ways; its probability is the sum over all of them, taken
by a forward pass.  A text's log probability is the sum over its words.

Learning: of each language about ``rows_per_language`` labelled rows are drawn by a hash of
the row (all, if there are fewer), and every word of their whole texts is counted.  Each of
``rounds`` of expectation-maximisation is a Spark job: tasks run forward-backward over their
words and emit expected counts of (language, piece), as whole numbers of ``1 / SCALE`` so that
their sum does not depend on its order; the sums, languages x pieces numbers, make the next
probabilities, smoothed towards the same floor in every language.

Words longer than ``MAX_WORD`` characters are cut into stretches of that many, in
learning and in prediction alike.

Prediction reads the text alone.  Every distinct word of a slice is scored once.
``score`` is the posterior of the predicted language, all learned ones being equally
likely beforehand.

Defined results: a text that is null or has no letter is ``und`` with score 0; so is
every text if nothing can be learned; ties go to the language first by code point;
rows without a label or text teach nothing, and a label without any word is not learned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut, row_slices

SLICE_BYTES = 2 << 20
MARK = "▁"
MAX_PIECE = 16
FLOOR = 0.01
SCALE = 1 << 20
UNKNOWN = -18.0  # log probability of a character that no piece covers
MAX_MEMO = 300_000  # words whose scores a task keeps
MAX_WORD = 64  # longer words are learned and scored in stretches of this many characters

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def load_pieces(model_file: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model file, without byte and control pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    keep = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)))
    return [p for p in map(model.id_to_piece, keep) if p and len(p) <= MAX_PIECE]


class Lattice:
    """All pieces at all places of many words at once; words of one length form a matrix of code points."""

    def __init__(self, pieces: list[str]):
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in {len(p) for p in pieces}:
            ids = np.array([i for i, p in enumerate(pieces) if len(p) == size])
            keys = self._hash(np.array([[ord(c) for c in pieces[i]] for i in ids], np.uint64))
            order = np.argsort(keys)
            self.by_length[size] = keys[order], ids[order]

    @staticmethod
    def _hash(codes: np.ndarray) -> np.ndarray:
        h = np.zeros(codes.shape[0], np.uint64)
        for k in range(codes.shape[1]):
            h = (h ^ codes[:, k]) * MULTIPLIER
            h ^= h >> np.uint64(29)
        return h

    def spans(self, codes: np.ndarray):
        """(begin, end, word numbers, piece ids) of every piece that stands in the words of a matrix."""
        n = codes.shape[1]
        for begin in range(n):
            h = np.zeros(len(codes), np.uint64)
            for end in range(begin + 1, min(n, begin + MAX_PIECE) + 1):
                h = (h ^ codes[:, end - 1]) * MULTIPLIER
                h ^= h >> np.uint64(29)
                if end - begin not in self.by_length:
                    continue
                keys, ids = self.by_length[end - begin]
                at = np.searchsorted(keys, h)
                at[at == len(keys)] = 0
                found = np.flatnonzero(keys[at] == h)
                if len(found):
                    yield begin, end, found, ids[at[found]]

    def forward(self, codes: np.ndarray, log_p: np.ndarray):
        """Log probability of each word in each language; ``log_p`` is languages x pieces."""
        n = codes.shape[1]
        alpha = np.full((n + 1, log_p.shape[0], len(codes)), -np.inf)
        alpha[0] = 0
        spans: dict[int, list] = {}
        for begin, end, words, ids in self.spans(codes):
            spans.setdefault(end, []).append((begin, words, ids))
        for end in range(1, n + 1):
            alpha[end] = alpha[end - 1] + UNKNOWN
            for begin, words, ids in spans.get(end, ()):
                alpha[end][:, words] = np.logaddexp(alpha[end][:, words], alpha[begin][:, words] + log_p[:, ids])
        return alpha, spans

    def expected(self, codes: np.ndarray, log_p: np.ndarray, weight: np.ndarray, total: np.ndarray) -> None:
        """Add each piece's expected count, ``weight`` (languages x words) being how often a word was seen."""
        n = codes.shape[1]
        alpha, spans = self.forward(codes, log_p)
        beta = np.full_like(alpha, -np.inf)
        beta[n] = 0
        for end in range(n, 0, -1):
            for begin, words, ids in spans.get(end, ()):
                inside = log_p[:, ids] + beta[end][:, words]
                share = np.exp(alpha[begin][:, words] + inside - alpha[n][:, words]) * weight[:, words]
                for k in range(len(total)):
                    total[k] += np.bincount(ids, weights=share[k], minlength=total.shape[1])
                beta[begin][:, words] = np.logaddexp(beta[begin][:, words], inside)
            beta[end - 1] = np.logaddexp(beta[end - 1], beta[end] + UNKNOWN)


def _matrices(words: list[str], most: int = 8192):
    """(word numbers, matrix of code points) for the words of each length, ``most`` at a time; the word mark comes first."""
    by_size: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_size.setdefault(len(w), []).append(i)
    for ids in by_size.values():
        for at in range(0, len(ids), most):
            some = ids[at:at + most]
            text = "".join(MARK + words[i] for i in some)
            yield np.array(some), np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(len(some), -1).astype(np.uint64)


def learning_words(labelled: DataFrame, label: str, rows_per_language: int) -> tuple[list[str], DataFrame]:
    """The languages, and the words of their drawn rows with the times that each language has them (a written table)."""
    held = labelled.where(F.col(label).isNotNull() & F.col("text").isNotNull())
    place = (F.xxhash64(*labelled.columns) / float(1 << 64) + 0.5).alias("place")
    drawn = held.select(F.col(label).cast("string").alias("lang"), "text", place)
    sizes = {r["lang"]: r["count"] for r in drawn.groupBy("lang").count().collect()}  # a row for each language
    if not sizes:
        return [], labelled.limit(0)
    shares = labelled.sparkSession.createDataFrame([(k, rows_per_language / n) for k, n in sorted(sizes.items())], "lang string, share double")
    stretches = F.regexp_extract_all(F.lower("text"), F.lit(rf"[^\x20\x09-\x0D]{{1,{MAX_WORD}}}"), F.lit(0))
    words = drawn.join(F.broadcast(shares), "lang").where("place <= share").select("lang", F.explode(stretches).alias("w"))
    counted = cut(words.groupBy("lang", "w").count(), "language-words")
    languages = sorted(r["lang"] for r in counted.select("lang").distinct().collect())
    seen = F.array(*[F.sum(F.when(F.col("lang") == k, F.col("count")).otherwise(0)) for k in languages]).alias("seen")
    return languages, cut(counted.groupBy("w").agg(seen), "language-seen")


def _expected(pieces, log_p):
    def run(batches):
        lattice, p = Lattice(pieces.value), log_p.value
        total = np.zeros_like(p)
        for batch in batches:
            seen = np.asarray(batch.column("seen").flatten(), np.float64).reshape(-1, len(p)).T
            for ids, codes in _matrices(batch.column("w").to_pylist(), max(256, 32_768 // len(p))):
                lattice.expected(codes, p, seen[:, ids], total)
        scaled = np.rint(total * SCALE).astype(np.int64)
        language, piece = np.nonzero(scaled)
        yield pa.RecordBatch.from_arrays([pa.array(language, pa.int32()), pa.array(piece, pa.int32()), pa.array(scaled[language, piece], pa.int64())], names=["language", "piece", "n"])
    return run


def learn(labelled: DataFrame, pieces: list[str], label: str = "lang", rows_per_language: int = 500, rounds: int = 3) -> tuple[list[str], np.ndarray]:
    """The languages and log probabilities (languages x pieces) from the rows' ``text`` and label; other columns only tell rows apart."""
    languages, words = learning_words(labelled, label, rows_per_language)
    if not languages:
        return [], np.zeros((0, len(pieces)))
    context = labelled.sparkSession.sparkContext
    sent = context.broadcast(pieces)
    log_p = np.full((len(languages), len(pieces)), -np.log(len(pieces)))
    for _ in range(rounds):
        model = context.broadcast(log_p)
        sums = words.mapInArrow(_expected(sent, model), "language int, piece int, n long").groupBy("language", "piece").agg(F.sum("n").alias("n")).toArrow()
        total = np.full_like(log_p, FLOOR)
        total[sums["language"].to_numpy(), sums["piece"].to_numpy()] += sums["n"].to_numpy() / SCALE
        log_p = np.log(total / total.sum(axis=1, keepdims=True))
    return languages, log_p


def _predict(languages: list[str], log_p: np.ndarray, pieces: list[str]):
    def run(batches):
        lattice = Lattice(pieces)
        memo: dict[str, int] = {}
        scores = np.zeros((0, len(languages)))
        for batch in batches:
            for part in row_slices(batch, "text", SLICE_BYTES):
                texts = pc.utf8_lower(part.column("text").cast(pa.large_string()).fill_null(""))
                split = pc.ascii_split_whitespace(texts)
                coded = split.flatten().dictionary_encode()
                words = coded.dictionary.to_pylist()
                if len(memo) > MAX_MEMO:
                    memo, scores = {}, scores[:0]
                pieces_of = {w: [w[k:k + MAX_WORD] for k in range(0, len(w), MAX_WORD)] for w in words if len(w) > MAX_WORD}
                new = [w for w in dict.fromkeys([w for w in words if 0 < len(w) <= MAX_WORD] + [s for ws in pieces_of.values() for s in ws]) if w not in memo]
                if new:
                    got = np.zeros((len(new), len(languages)))
                    for ids, codes in _matrices(new):
                        got[ids] = lattice.forward(codes, log_p)[0][-1].T
                    memo.update(zip(new, range(len(scores), len(scores) + len(new))))
                    scores = np.concatenate([scores, got])
                table = np.concatenate([scores, np.zeros((1, len(languages)))])[[memo.get(w, -1) for w in words]]  # none for the empty word
                for i, w in enumerate(words):
                    if w in pieces_of:
                        table[i] = scores[[memo[s] for s in pieces_of[w]]].sum(axis=0)
                offsets = np.asarray(split.offsets) - split.offsets[0].as_py()
                index = np.asarray(coded.indices)
                sums = np.zeros((len(index) + 1, len(languages)))
                np.cumsum(table[index], axis=0, out=sums[1:])
                total = sums[offsets[1:]] - sums[offsets[:-1]]
                letters = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
                best = total.argmax(axis=1)
                posterior = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([languages[b] if ok else "und" for b, ok in zip(best, letters)], pa.string()), pa.array(np.where(letters, posterior, 0.0))],
                                                 names=["doc_id", "lang_pred", "score"])
    return run


def identify(docs: DataFrame, languages: list[str], log_p: np.ndarray, pieces: list[str]) -> DataFrame:
    """doc_id, lang_pred and score of each row's whole text."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if not languages:
        return texts.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    model = docs.sparkSession.sparkContext.broadcast((languages, log_p, pieces))  # languages x 32,000 numbers
    return texts.mapInArrow(lambda batches: _predict(*model.value)(batches), "doc_id long, lang_pred string, score double")
