"""Passages just over 50 words, at shifted places, leave all texts but the first."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("trendlake.llm")

from trendlake.llm.chunk_dedup import chunk_starts, repeated_chunks
from trendlake.llm.store import ship_package
from trendlake.llm.words import text_bytes


def words(seed, n: int) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choices("abcdefghijklmnopqrstuvwxyzéü", k=draw.randint(2, 9))) for _ in range(n))


def test_passages_of_51_words_leave_whole(spark):
    ship_package(spark)
    passages = [words(f"p{k}", 51) for k in range(150)]
    rows = [(2 * k + c, f"{words(f'a{k}-{c}', 20 + 7 * c)} {p} {words(f'b{k}-{c}', 30)}") for k, p in enumerate(passages) for c in range(2)]
    got = {r.doc_id: r for r in repeated_chunks(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, p in enumerate(passages):
        size = len(p.encode())
        assert got[2 * k].n_removed == 0
        assert size <= got[2 * k + 1].n_removed <= size + 8  # neighbouring bytes may be equal by chance
        assert p not in got[2 * k + 1].kept


def test_equal_neighbouring_bytes_and_repeated_or_null_ids(spark):
    ship_package(spark)
    p = words("p", 60)
    rows = [(1, "x" + p), (2, "x " * 300), (2, "y" + p), (2, "y" + p), (None, p + "é"), (3, p + "è"), (4, "x " * 300)]
    got = sorted((r.doc_id or 0, r.kept) for r in repeated_chunks(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(0, p + "é"), (1, "x"), (2, "x " * 300), (2, "y"), (2, "y"), (3, "è"), (4, "")])


def test_cuts_do_not_depend_on_the_texts_beside():
    texts = [words("c", 40), "", "x " * 120, "x " * 120, "same words here " * 9, "same words here " * 9, "é" * 500, words("d", 300), "short"]
    data, offsets = text_bytes(pa.array(texts))
    starts = chunk_starts(data, offsets)
    for k, t in enumerate(texts):
        alone = chunk_starts(*text_bytes(pa.array([t])))
        assert np.array_equal(starts[(starts >= offsets[k]) & (starts < offsets[k + 1])] - offsets[k], alone)
