"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its distinct words, pairs of neighbours, and pairs with one and with two
words between them, each under a 32-bit hash.  Learning follows the per-coordinate schedule:
every feature has a sum of gradients ``z`` and of their squares ``n``, its own rate
``alpha / (beta + sqrt(n))``, and its weight is 0 unless ``|z|`` exceeds ``l1``.  So only the
few features that tell the labels apart get a weight; they are broadcast as a sorted table.

The fit is bounded by parameters: at most ``rows`` labelled rows of each label (the least by a
hash of their id and text) and ``fit_words`` words in all, taken in the same order.  These rows
are learned one after the other in one task, ``epochs`` times; features seen in fewer than
``least_docs`` of them are left out.  Scoring covers every row and its whole text.

The default rate and threshold are high: rows come in a few thousands, nearly every feature of
prose is seen too seldom to pass ``l1``, and those that do should reach their weight in a few
passes.  Labels are sampled alike where there are enough of both, so a score takes them as
equally likely beforehand.

Defined results: null and empty texts score by the intercept alone; repeated features count
once; a labelled row without text teaches the intercept; several labels of one doc_id are a
row each; labels other than 0 and 1 and rows without an id are not learned from; without both
labels every score is that of the only one (0 without any); other columns of the input are
not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import cut, row_slices
from .words import ALNUM, STEP, find_words, mix

SLICE_BYTES = 4 << 20
#: Places of the second word of a pair, counted from the first.
GAPS = (1, 2, 3)
FIT = "kind long, feature long, weight double"


def hashed_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """32-bit feature hashes of the rows and the row of each (repeats included)."""
    words = find_words(texts, ALNUM, lower=True)
    codes = words.hashes()
    features, rows = [codes >> np.uint64(32)], [words.rows]
    for gap in GAPS:
        at = np.flatnonzero(words.rows[gap:] == words.rows[:-gap])
        pair = mix(codes[at] * STEP + codes[at + gap] + np.uint64(gap))
        features.append(pair >> np.uint64(32))
        rows.append(words.rows[at])
    return np.concatenate(features).astype(np.uint32), np.concatenate(rows)


@dataclass(frozen=True)
class Ftrl:
    """Parameters of the learner."""

    alpha: float = 4.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 0.0
    epochs: int = 10

    def weights(self, z: np.ndarray, n: np.ndarray, l1: float) -> np.ndarray:
        w = -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) > l1, w, 0.0)

    def fit(self, rows: list[np.ndarray], labels: list[int], size: int) -> tuple[float, np.ndarray]:
        """The intercept and the weight of each of ``size`` features; ``rows`` hold distinct feature numbers."""
        z, n = np.zeros(size + 1), np.zeros(size + 1)  # the last one is the intercept, free of l1
        for _ in range(self.epochs):
            for features, label in zip(rows, labels):
                at = np.append(features, size)
                w = self.weights(z[at], n[at], self.l1)
                w[-1] = self.weights(z[size], n[size], 0.0)
                gradient = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
                grown = n[at] + gradient * gradient
                z[at] += gradient - (np.sqrt(grown) - np.sqrt(n[at])) / self.alpha * w
                n[at] = grown
        return float(self.weights(z[size], n[size], 0.0)), self.weights(z[:size], n[:size], self.l1)


def _fit_task(learner: Ftrl, least_docs: int):
    def run(batches):
        texts, labels = [], []
        for batch in batches:
            labels += batch.column("label").to_pylist()
            for part in row_slices(batch, "text", SLICE_BYTES):
                features, rows = hashed_features(part.column("text"))
                both = np.unique(rows.astype(np.uint64) << np.uint64(32) | features)
                ends = np.searchsorted(both >> np.uint64(32), np.arange(1, len(part)))
                texts += np.split(both.astype(np.uint32), ends)
        if not texts:
            return
        known, docs = np.unique(np.concatenate(texts), return_counts=True)
        known = known[docs >= least_docs]
        rows = []
        for k, features in enumerate(texts):
            at = np.minimum(np.searchsorted(known, features), max(len(known) - 1, 0))
            rows.append(at[known[at] == features] if len(known) else np.zeros(0, np.int64))
            texts[k] = None
        intercept, weights = learner.fit(rows, labels, len(known))
        used = np.flatnonzero(weights)
        kind = np.concatenate([[0], np.ones(len(used), np.int64)])
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int64()), pa.array(np.concatenate([[0], known[used].astype(np.int64)]), pa.int64()), pa.array(np.concatenate([[intercept], weights[used]]), pa.float64())], names=["kind", "feature", "weight"])
    return run


@dataclass
class ToxicityModel:
    intercept: float
    features: np.ndarray
    weights: np.ndarray


def fit_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, fit_words: int) -> DataFrame:
    """``text, label, nth`` of the rows to learn from: the least by hash, as many of each label, up to the bounds.

    Of each label ``2 * rows`` ids are chosen (not every one need have a document) and
    broadcast, so no other text leaves its task.
    """
    marked = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    hashed = marked.withColumn("place", F.xxhash64("id", F.lit(12)))
    least = lambda df, n, *by: df.where("label = 0").orderBy(*by).limit(n).unionByName(df.where("label = 1").orderBy(*by).limit(n))
    chosen = least(hashed, 2 * rows, "place")
    met = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(chosen), "id")
    some = least(cut(met, "toxicity-labelled"), rows, "place", "text")  # 2 * rows rows at most, also in what follows
    some = some.withColumn("nth", F.row_number().over(Window.partitionBy("label").orderBy("place", "text")))
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    return some.withColumn("words", F.sum(size).over(Window.orderBy("nth", "label"))).where(F.col("words") <= fit_words).select("text", "label", "nth")


def learn_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = 4_096, fit_words: int = 16_000_000, least_docs: int = 2, learner: Ftrl = Ftrl()) -> ToxicityModel:
    """Fit on ``labels`` (doc_id and ``label``), joined with the texts of ``docs``."""
    valid = labels.where(F.col("doc_id").isNotNull()).select(F.col(label).cast("int").alias("label")).where("label in (0, 1)")
    there = {r["label"] for r in valid.distinct().collect()}
    if len(there) < 2:
        return ToxicityModel(30.0 if 1 in there else -30.0, np.zeros(0, np.uint32), np.zeros(0))
    sample = cut(fit_sample(docs, labels, label, rows, fit_words), "toxicity-sample")
    ordered = sample.repartition(1).sortWithinPartitions("nth", "label")
    found = ordered.select("text", "label").mapInArrow(_fit_task(learner, least_docs), FIT).collect()
    intercept = next((r["weight"] for r in found if r["kind"] == 0), 0.0)
    kept = sorted((r["feature"], r["weight"]) for r in found if r["kind"] == 1)
    return ToxicityModel(intercept, np.array([f for f, _ in kept], np.uint32), np.array([w for _, w in kept]))


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, text and score (0 to 1) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast((model.intercept, model.features, model.weights))

    def run(batches):
        intercept, known, weights = sent.value
        marked = np.zeros(1 << 20, bool)  # by the hash's first bits: most features need no search
        marked[known >> np.uint32(12)] = True
        for batch in batches:
            for part in row_slices(batch, "text", SLICE_BYTES):
                total = np.zeros(len(part))
                if len(known):
                    features, rows = hashed_features(part.column("text"))
                    some = np.flatnonzero(marked[features >> np.uint32(12)])
                    features, rows = features[some], rows[some]
                    at = np.minimum(np.searchsorted(known, features), len(known) - 1)
                    hit = known[at] == features
                    both = np.unique(rows[hit].astype(np.uint64) << np.uint64(32) | at[hit].astype(np.uint64))
                    total = np.bincount((both >> np.uint64(32)).astype(np.int64), weights=weights[(both & np.uint64(0xFFFFFFFF)).astype(np.int64)], minlength=len(part))
                score = 1 / (1 + np.exp(-np.clip(total + intercept, -30, 30)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), pa.array(score, pa.float64())], names=["doc_id", "text", "score"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(run, "doc_id long, text string, score double")


def predicted(score: Column) -> Column:
    return (score >= 0.5).cast("int")
