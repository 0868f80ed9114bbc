"""The in-task search of the Jaccard join against plain set arithmetic."""

from __future__ import annotations

import random

import numpy as np
import pytest

pytest.importorskip("trendlake.llm")

from trendlake.llm.jaccard_join import _perhaps_in, divide_skip, extra_length, prefix_length, size_classes, with_partner


def _sets(rng, n):
    core = [rng.getrandbits(64) for _ in range(60)]
    out = []
    for _ in range(n):
        own = rng.sample(core, rng.randint(1, 60)) + [rng.getrandbits(64) for _ in range(rng.randint(0, 12))]
        out.append(np.unique(np.array(own, np.uint64)))
    return out


def _linked(a, b, percent):
    n = len(np.intersect1d(a, b))
    return 100 * n >= percent * (len(a) + len(b) - n)


@pytest.mark.parametrize("percent", [80, 85])
def test_links_connect_every_linked_pair_and_the_filter_loses_none(percent):
    rng = random.Random(percent)
    for _ in range(60):
        sets = _sets(rng, rng.randint(2, 14))
        edges = divide_skip(sets, percent)
        root = list(range(len(sets)))
        for a, b in edges:
            assert _linked(sets[a], sets[b], percent)
            root = [root[a] if r == root[b] else r for r in root]
        wide = [(s[:(p := prefix_length(len(s), percent)) + extra_length(p)] >> np.uint64(20)).astype(np.uint16) for s in sets]
        kept = with_partner(wide, np.array([len(s) for s in sets]), percent)
        for a in range(len(sets)):
            for b in range(a):
                if _linked(sets[a], sets[b], percent):
                    assert root[a] == root[b] and kept[a] and kept[b]


def test_size_classes_keep_linkable_sizes_together():
    borders = size_classes(85, 1 << 16)
    for n in range(1, 2000):
        most = n * 100 // 85
        assert np.searchsorted(borders, most, "right") - np.searchsorted(borders, n, "right") <= 1


def test_the_bitmap_lets_every_needed_text_through_and_few_others(spark):
    texts = spark.range(-500, 20_000).selectExpr("id as doc_id", "cast(id as string) as text")
    kept = spark.range(-500, 20_000, 7).selectExpr("id as node")
    got = {r.doc_id for r in _perhaps_in(texts, kept).collect()}
    needed = set(range(-500, 20_000, 7))
    assert needed <= got and len(got - needed) < 100
    assert _perhaps_in(texts, kept.limit(0)).count() == 0
