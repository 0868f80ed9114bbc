"""Language identification on scripts that put no spaces between words."""

from __future__ import annotations

import random

import pytest

pytest.importorskip("trendlake.llm")

from trendlake.llm.language_id import MAX_WORD, identify, learn
from trendlake.llm.store import ship_package

ALPHABETS = {"ja": "のはをにがとでもしたいる", "zh": "的是不了在人有我他这中大", "en": "abcdefghij"}


def text(lang: str, size: int, seed: int) -> str:
    draw = random.Random(f"{lang}-{seed}")
    word = "".join(draw.choices(ALPHABETS[lang], k=size))
    return word if lang != "en" else " ".join(word[k:k + 5] for k in range(0, size, 5))


def test_text_without_spaces_is_learned_and_predicted(spark):
    ship_package(spark)
    pieces = sorted(set("".join(ALPHABETS.values())))
    labelled = spark.createDataFrame([(text(lang, 300, seed), lang) for lang in ALPHABETS for seed in range(20)] + [(None, "xx"), ("abc", None)], "text string, lang string")
    languages, log_p = learn(labelled, pieces)
    assert languages == sorted(ALPHABETS)
    docs = [(k, text(lang, 200, 100 + k), lang) for k, lang in enumerate([*ALPHABETS] * 4)]
    got = {r.doc_id: r.lang_pred for r in identify(spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string"), languages, log_p, pieces).collect()}
    assert got == {k: lang for k, _, lang in docs}


def test_a_language_over_the_row_limit_is_sampled_evenly(spark):
    """Words seen once each: not only those that come first by code point are learned."""
    pieces = list("abcdefghijklmnopqrst")
    labelled = spark.createDataFrame([(p * size, "en") for p in pieces for size in range(1, 21)], "text string, lang string")
    _, log_p = learn(labelled, pieces, rows_per_language=40)
    assert (log_p[0] > log_p[0].min() + 2).sum() > 10


def test_expected_counts_equal_an_enumeration_of_all_segmentations():
    """The forward pass sums over every way to cut a word; the backward pass shares it out."""
    import itertools

    import numpy as np

    from trendlake.llm.language_id import MARK, UNKNOWN, Lattice, _matrices

    pieces = [MARK, MARK + "a", "a", "b", "ab", "ba", "aba", MARK + "ab", "bb"]
    draw = np.random.default_rng(1)
    log_p = np.log(draw.dirichlet(np.ones(len(pieces)), 2))
    words = ["".join(w) for n in range(1, 6) for w in itertools.product("abc", repeat=n)]
    weight = draw.integers(0, 4, (2, len(words))).astype(float)

    def cuts(text):
        if not text:
            yield ()
        for k in range(1, len(text) + 1):
            if text[:k] in pieces or k == 1:  # a character may also stand for itself, as unknown
                ways = ([pieces.index(text[:k])] if text[:k] in pieces else []) + ([None] if k == 1 else [])
                for rest in cuts(text[k:]):
                    yield from ((w, *rest) for w in ways)

    lattice = Lattice(pieces)
    total, got = np.zeros_like(log_p), np.zeros((len(words), 2))
    for ids, codes in _matrices(words, 50):
        got[ids] = lattice.forward(codes, log_p)[0][-1].T
        lattice.expected(codes, log_p, weight[:, ids], total)
    want = np.zeros_like(log_p)
    for i, word in enumerate(words):
        for k in range(2):
            ways = [(w, np.exp(sum(UNKNOWN if p is None else log_p[k, p] for p in w))) for w in cuts(MARK + word)]
            every = sum(x for _, x in ways)
            assert np.isclose(got[i, k], np.log(every))
            for w, x in ways:
                for p in w:
                    if p is not None:
                        want[k, p] += weight[k, i] * x / every
    assert np.allclose(total, want)


def test_language_edges(spark):
    ship_package(spark)
    pieces = list("abcdefghij") + ["▁"]
    labelled = spark.createDataFrame([(1, "aaa abab", "x", 1), (1, "aaa abab", "x", 1), (2, "cdc dcd", "y", 1), (3, " ", "z", 1), (None, None, "x", 1), (4, "zzz", None, 1)], "doc_id long, text string, lang string, seen int")
    languages, log_p = learn(labelled, pieces)
    assert languages == ["x", "y"]
    docs = spark.createDataFrame([(1, "aba", "q", 1), (1, "aba", "q", 1), (None, "dcd", "q", 1), (2, None, "q", 1), (3, "", "q", 1), (4, "123 --", "q", 1), (5, "cd " * 60_000, "q", 1), (6, "d" * 30_000, "q", 1)], "doc_id long, text string, lang_pred string, score int")
    got = sorted((r.doc_id or 0, r.lang_pred) for r in identify(docs, languages, log_p, pieces).collect())
    assert got == [(0, "y"), (1, "x"), (1, "x"), (2, "und"), (3, "und"), (4, "und"), (5, "y"), (6, "y")]
    assert all(0 <= r.score <= 1 for r in identify(docs, languages, log_p, pieces).collect())
    assert learn(labelled.limit(0), pieces)[0] == [] and identify(docs, [], log_p[:0], pieces).count() == 8
    assert learn(labelled, pieces)[1].tolist() == log_p.tolist()
