"""Nulls, empty and long texts, repeated rows, empty tables and extra columns, for every operator on documents."""

from __future__ import annotations

import pytest

pytest.importorskip("trendlake.llm")

from trendlake.llm.chunk_dedup import repeated_chunks
from trendlake.llm.decontaminate import contamination, decontaminate
from trendlake.llm.jaccard_join import jaccard_classes, keep_one_each
from trendlake.llm.mixing import mix, with_copies
from trendlake.llm.quality_rules import judge, keep_good
from trendlake.llm.secret_scan import scan_secrets
from trendlake.llm.store import ship_package
from trendlake.llm.suffix_dedup import repeated_strings

LONG = " ".join(f"word{i}" for i in range(3000))
ROWS = [(1, None, "a", 1), (2, "", "a", 2), (None, "one two three", None, 3), (3, LONG, "b", 4), (4, LONG, "b", 5), (4, LONG, "b", 5), (5, "x " * 400, None, 6), (6, "é ü\n\n\t", "c", 7)]
SCHEMA = "doc_id long, text string, source string, key long"


@pytest.fixture(scope="module")
def frames(spark):
    ship_package(spark)
    docs = spark.createDataFrame(ROWS, SCHEMA)
    labels = spark.createDataFrame([(3, 1), (5, 0), (9, None), (None, 0)], "doc_id long, quality int")
    items = spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(20))), (2, None), (None, "one two"), (3, "")], "item_id long, text string")
    return docs, labels, items, docs.limit(0)


OPERATORS = {
    "quality": lambda d, l, i: judge(d, l),
    "mixing": lambda d, l, i: with_copies(d).select("doc_id", "mix.*"),
    "chunks": lambda d, l, i: repeated_chunks(d),
    "strings": lambda d, l, i: repeated_strings(d),
    "jaccard": lambda d, l, i: jaccard_classes(d),
    "contamination": lambda d, l, i: contamination(d, i),
    "secrets": lambda d, l, i: scan_secrets(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row_and_none_for_an_empty_table(frames, name):
    docs, labels, items, empty = frames
    assert len(OPERATORS[name](docs, labels, items).collect()) == len(ROWS)
    assert OPERATORS[name](empty, labels, items).collect() == []


def test_filters_keep_the_columns(frames):
    docs, labels, items, empty = frames
    for out in (keep_good(docs, labels), keep_one_each(docs), decontaminate(docs, items), mix(docs)):
        assert out.columns == docs.columns
        out.collect()
    assert sorted(r.doc_id for r in keep_one_each(docs).collect() if r.doc_id) == [1, 2, 3, 5, 6]
    hit = {r.doc_id: r.n_hit for r in contamination(docs, items).collect()}
    assert hit[3] == 20 and hit[1] == 0 and hit[None] == 2


def test_passes_over_a_split_benchmark_agree(frames):
    docs, _, items, _ = frames
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    whole = contamination(docs.where("doc_id <> 4"), items).select(columns).collect()
    split = contamination(docs.where("doc_id <> 4"), items, max_broadcast_words=20).select(columns).collect()
    assert sorted(whole) == sorted(split)


@pytest.mark.parametrize("bound", [20, 5])
def test_every_row_is_judged_by_its_own_text_whatever_the_passes(spark, frames, bound):
    hit = " ".join(f"word{i}" for i in range(20))
    rows = [(7, hit, "hit"), (7, "clean text here", "same id"), (7, hit + " tail", "third"), (None, hit, "null hit"), (None, "clean words only", "null clean"), (None, None, "null text"), (8, LONG, "part")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, name string")
    items = spark.createDataFrame([(1, hit), (2, " ".join(f"word{i}" for i in range(10, 40))), (3, "one two"), (4, "third tail")], "item_id long, text string")
    split = {"max_broadcast_words": bound}
    for run in (lambda **k: contamination(docs, items, **k), lambda **k: decontaminate(docs, items, **k), lambda **k: decontaminate(docs, items, remove="spans", **k)):
        assert sorted(map(repr, run(**split).collect())) == sorted(map(repr, run().collect()))
    assert contamination(docs, items, **split).count() == len(rows)
    assert {r.name for r in decontaminate(docs, items, **split).collect()} == {"same id", "null clean", "null text", "part"}
    assert {r.name: r.text for r in decontaminate(docs, items, remove="spans", **split).collect()}["third"] == " tail"


@pytest.mark.parametrize("symbols", [0, 1, 3, 40])
def test_keys_of_any_quality_spread_over_the_buckets(spark, symbols):
    from trendlake.llm.mixing import with_keys

    docs = spark.range(20_000).selectExpr("id as doc_id", f"concat(repeat('word ', 10), repeat('#', {symbols})) as text")
    sizes = sorted(r["count"] for r in with_keys(docs, "mix", 4_096).groupBy("mix.bucket").count().collect())
    assert sizes[-1] < 0.01 * 20_000
    firsts = with_keys(docs, "mix", 4_096).groupBy("mix.bucket").agg({"mix.key": "min"}).orderBy("bucket").collect()
    assert [r[1] for r in firsts] == sorted(r[1] for r in firsts)


def test_the_drawn_documents_are_those_of_least_keys(spark):
    """Taken documents of each source: whole epochs, then by key until the next would go beyond the middle of its size."""
    docs = spark.createDataFrame([(k, "w " * (1 + k % 7) + "#" * (k % 4), f"s{k % 3}") for k in range(900)], "doc_id long, text string, source string")
    from trendlake.llm.mixing import with_keys

    keys = {r.doc_id: (r.mix.key, r.doc_id, r.mix.size) for r in with_keys(docs, "mix", 4_096).collect()}
    rows = with_copies(docs).select("doc_id", "source", "mix.*").collect()
    for source in ("s0", "s1", "s2"):
        mine = [r for r in rows if r.source == source]
        epochs = int(mine[0].target // mine[0].source_size)
        budget, until, more = mine[0].target - epochs * mine[0].source_size, 0, set()
        for r in sorted(mine, key=lambda r: keys[r.doc_id]):
            until += r.size
            if until - r.size / 2 > budget:
                break
            more.add(r.doc_id)
        assert {r.doc_id: r.copies for r in mine} == {r.doc_id: epochs + (r.doc_id in more) for r in mine}
