"""Quality rules are learned from labels and reject unlabelled documents like the bad ones."""

from __future__ import annotations

import random

import pytest

pytest.importorskip("trendlake.llm")

from trendlake.llm.quality_rules import judge, keep_good, learn_rules, with_counts, with_measures
from trendlake.llm.store import cut

from . import brute


def rows(n):
    rng = random.Random(8)
    for k in range(n):
        bad = k % 5 == 0
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 200))]
        if bad:  # marks inside the words: the share of symbols tells, at any length
            words = [w + rng.choice("#$%") if rng.random() < 0.4 else w for w in words]
        elif k % 3 == 0:
            words[5] += "#"  # a mark alone is no sign
        yield k, " ".join(words), bad


def test_rules_reject_held_out_bad_documents(spark):
    data = list(rows(1200))
    docs = spark.createDataFrame([r[:2] for r in data], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(not bad)) for k, _, bad in data if k % 2 == 0], "doc_id long, quality int")
    measured = cut(with_measures(with_counts(docs, "doc_id")), "measures")
    rules = learn_rules(measured, labels)
    assert rules and all(rule for rule in rules)
    got = {r.doc_id: r for r in judge(docs, labels).collect()}
    held_out = [(got[k], bad) for k, _, bad in data if k % 2]
    assert sum(not r.kept for r, bad in held_out if bad) >= 0.95 * sum(bad for _, bad in held_out)
    assert sum(r.kept for r, bad in held_out if not bad) >= 0.98 * sum(not bad for _, bad in held_out)
    assert all((r.rule is None) == r.kept for r, _ in held_out if not r.base_failed)
    assert {r.doc_id for r in keep_good(docs, labels).collect()} == {k for k, r in got.items() if r.kept}


def test_rules_are_learned_from_the_given_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    quality = {r.doc_id: r.quality for r in labels.collect()}
    got = judge(docs, labels).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    bad = [r for r in got if quality.get(r.doc_id) == 0 and not brute.base_counts(texts[r.doc_id])["base_failed"]]
    good = [r for r in got if quality.get(r.doc_id) == 1 and not r.base_failed]
    assert sum(not r.kept for r in bad) >= 0.5 * len(bad) and any(r.rule for r in got)
    assert sum(r.kept for r in good) >= 0.97 * len(good)
