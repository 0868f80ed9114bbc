"""Periodic runs, toxicity and importance resampling: brute force, held-out accuracy and edges."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("trendlake.llm")

from pyspark.sql import functions as F  # noqa: E402

from trendlake.llm import queries  # noqa: E402
from trendlake.llm.importance import WordAutomaton, importance_resample, importance_scores, join_crcs, with_rank, with_space  # noqa: E402
from trendlake.llm.periodic_runs import find_runs, lyndon_lengths, periodic_runs  # noqa: E402
from trendlake.llm.toxicity import learn_toxicity, score_toxicity  # noqa: E402

from . import brute  # noqa: E402

SF = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"
EXTRA = "doc_id long, text string, runs string, score string, rank string, weight string, label string, id long"


def sequences():
    """Random, periodic and nested periodic sequences over small alphabets."""
    rng = random.Random(5)
    for _ in range(600):
        text = []
        while len(text) < rng.randint(0, 60):
            root = [rng.randrange(rng.choice([1, 2, 3, 6])) for _ in range(rng.randint(1, 7))]
            text += root * rng.choice([1, 1, 2, 4, 5, 9])
            text = text[:-rng.randint(0, 3)] if rng.random() < 0.4 else text
        yield text[:90]


def test_lyndon_lengths_equal_their_definition():
    for text in sequences():
        n = len(text)
        want = []
        for i in range(n):
            ends = [j for j in range(i + 1, n + 1) if all(text[i:j] < text[k:j] for k in range(i + 1, j))]
            want.append(max(ends) - i)
        assert lyndon_lengths(text) == want


def test_runs_equal_brute_force():
    for text in sequences():
        for exponent, least in ((4, 6), (2, 2), (3, 5)):
            assert sorted(find_runs(np.array(text, np.int64), exponent, least)) == brute.word_runs(text, exponent, least)


def test_periodic_runs_query(spark):
    for sf in (SF, SF_MID):
        docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if sf == SF or len(r.text or "") < 6000]
        got = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op11_periodic_runs"](spark, sf).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()}
        for d, t in docs:
            assert got[d] == brute.periodic_row(brute.planted_words(d, t)), d
        assert sum(v[0] > 0 for v in got.values()) > 5


def test_periodic_runs_edges(spark):
    long = "x y " * 20_000 + "z " + "ab " * 5
    rows = [(1, "a a a a a a b"), (1, "a a a a a a b"), (2, None), (3, ""), (4, " \n"), (None, "a\tb\nA B " + "a b " * 4), (5, long), (6, "w " * 5), (7, "é é é é é é")]
    docs = spark.createDataFrame([(*r, *["7"] * 5, 1) for r in rows], EXTRA)
    got = sorted((r.doc_id is None, r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(docs).collect())
    want = sorted((d is None, d, brute.word_runs(brute.WORD.findall(t or "")) if t is not long else [(0, 40_000, 2)], None) for d, t in rows)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    texts = {g[1]: g[3] for g in got}
    assert texts[1] == "a b" and texts[2] == "" and texts[5] == "x y z ab ab ab ab ab" and texts[None] == "a b A B a b"
    assert periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(docs, exponent=1)


def test_crc_of_joined_strings():
    rng = random.Random(3)
    pairs = [(rng.randbytes(rng.randint(0, 90)), rng.randbytes(rng.choice([0, 1, 5, 64, 65, 300, 5000]))) for _ in range(300)]
    first, second = (np.array([zlib.crc32(p[k]) for p in pairs], np.uint32) for k in (0, 1))
    got = join_crcs(with_space(first), second, np.array([len(b) for _, b in pairs]))
    assert got.tolist() == [zlib.crc32(a + b" " + b) for a, b in pairs]


@pytest.mark.parametrize("known", [[], ["the", "été", "x"], ["the", "quick", "été", "x", "longword" * 8, "42"]])
def test_automaton_with_any_dictionary(known, monkeypatch):
    monkeypatch.setattr("trendlake.llm.importance.BLOCK_BYTES", 64)
    texts = ["The quick,THE", None, "", "été x" + "longword" * 8 + " " + "longword" * 8, "--", "x", "x 42 x\x00y " * 30, "日本 the" + "z" * 500]
    automaton = WordAutomaton([k.encode() for k in known])
    crc, row, n_words = automaton.features(pa.array(texts))
    got = sorted(zip(row.tolist(), crc.tolist()))
    want = []
    for k, t in enumerate(texts):
        w = brute.ALNUM_WORD.findall((t or "").translate(brute.ASCII_LOWER))
        assert n_words[k] == len(w)
        want += [(k, zlib.crc32(x.encode())) for x in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]
    assert got == sorted(want)


def test_importance_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_MID}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF_MID}/benchmark.parquet").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op13_importance"](spark, SF_MID).select("doc_id", "n_features", "weight", "score", "rank").collect()}
    assert got == brute.importance_rows(docs, target)


def test_importance_edges(spark):
    texts = [(1, "a b " * 12), (1, "a b " * 12), (None, "c " * 20), (2, None), (3, ""), (4, "a " * 19), (5, "x y z " * 30_000), *[(k, "q w e r " * 5) for k in range(10, 30)]]
    docs = spark.createDataFrame([(*t, *["7"] * 5, 1) for t in texts], EXTRA)
    target = spark.createDataFrame([("q w e",), (None,), ("",)], "text string")
    scored = importance_scores(docs, target, buckets=64)
    rows = with_rank(scored, percent=100).collect()
    assert len(rows) == len(texts) and sorted(r.rank for r in rows if r.rank) == list(range(1, 25))
    assert all((r.rank is None) == (r.n_words < 20) for r in rows)
    ranked = sorted((r for r in rows if r.rank), key=lambda r: r.rank)
    assert ranked == sorted(ranked, key=lambda r: (-r.score, r.doc_id is not None, r.doc_id or 0, r.rank))
    assert {r.weight for r in rows if r.n_words == 0} == {0}
    same = [r for r in rows if r.doc_id == 1]
    assert same[0].score == same[1].score and abs(same[0].rank - same[1].rank) == 1
    drawn = importance_resample(docs, target, percent=25, buckets=64).collect()
    assert sorted(r.rank for r in drawn) == list(range(1, 7))
    assert with_rank(importance_scores(docs.limit(0), target)).count() == 0
    assert importance_scores(docs, target.limit(0)).count() == len(texts)


def test_ranks_over_many_partitions(spark):
    scored = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 7).alias("score"), F.lit(30).alias("n_words"), F.lit(1).alias("weight"), F.lit(1).alias("n_features"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = with_rank(scored.repartition(5), percent=50).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = sorted(range(5000), key=lambda d: (-(d % 7), d))[:2500]
    assert [r.doc_id for r in sorted((r for r in rows if r.rank), key=lambda r: r.rank)] == want


def test_toxicity_query(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF_MID}/labels.parquet").collect()}
    n = spark.read.parquet(f"{SF_MID}/documents.parquet").count()
    got = queries.QUERIES["op12_toxicity"](spark, SF_MID).collect()
    assert len(got) == n and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    learned = [(r.predicted, labels[r.doc_id]) for r in got if r.doc_id in labels and not r.held_out]
    held = [(r.predicted, labels[r.doc_id]) for r in got if r.doc_id in labels and r.held_out]
    assert sum(p == y for p, y in learned) >= 0.95 * len(learned)
    assert sum(p == y for p, y in held) >= 0.85 * len(held)
    again = queries.QUERIES["op12_toxicity"](spark, SF_MID).collect()
    assert sorted(got) == sorted(again)


def toxic_rows(n, seed):
    rng = random.Random(seed)
    for k in range(n):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randint(5, 120))]
        y = int(rng.random() < 0.3)
        if y:  # a pair with any word between is the only sign; its parts alone are not
            words[2:2] = ["black", f"w{rng.randrange(300)}", "heart"]
        else:
            words[1:1], words[4:4] = ["heart"], ["black"]
        yield k, " ".join(words), y


def test_toxicity_learns_skip_grams(spark):
    train, test = list(toxic_rows(600, 1)), list(toxic_rows(300, 2))
    docs = spark.createDataFrame([r[:2] for r in train], "doc_id long, text string")
    labels = spark.createDataFrame([(d, y) for d, _, y in train], "doc_id long, toxic int")
    model = learn_toxicity(docs, labels)
    assert 0 < len(model.features) < 400
    got = {r.doc_id: r.score >= 0.5 for r in score_toxicity(spark.createDataFrame([r[:2] for r in test], "doc_id long, text string"), model).collect()}
    assert sum(got[d] == bool(y) for d, _, y in test) >= 0.97 * len(test)
    small = learn_toxicity(docs, labels, rows=40, fit_words=1_000)  # the bounds hold and the fit still runs
    assert len(small.features) <= len(model.features) and small.intercept != model.intercept


def test_toxicity_edges(spark):
    rows = [(1, "bad bad"), (1, "bad bad"), (2, None), (3, ""), (None, "fine"), (4, "bad " * 50_000), (5, "fine words")]
    docs = spark.createDataFrame([(*r, *["7"] * 5, 1) for r in rows], EXTRA)
    labels = spark.createDataFrame([(1, 1, "x"), (2, 0, "x"), (3, 0, "x"), (4, 1, "x"), (5, 0, "x"), (None, 1, "x"), (9, 1, "x"), (5, None, "x"), (5, 7, "x")], "doc_id long, toxic int, text string")
    model = learn_toxicity(docs, labels, least_docs=1)
    scored = score_toxicity(docs, model).collect()
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 for r in scored)
    assert len({r.score for r in scored if not r.text}) == 1
    assert score_toxicity(docs.limit(0), model).count() == 0
    assert {r.score > 0.5 for r in score_toxicity(docs, learn_toxicity(docs, labels.limit(0))).collect()} == {False}
    assert {r.score > 0.5 for r in score_toxicity(docs, learn_toxicity(docs, labels.where("toxic = 1"))).collect()} == {True}
    assert learn_toxicity(docs.limit(0), labels).intercept == 0.0
