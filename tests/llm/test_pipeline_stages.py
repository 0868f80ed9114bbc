"""The pipeline's near-duplicate and contamination stages keep the rows that brute force keeps."""

from __future__ import annotations

import pytest

pytest.importorskip("trendlake.llm")

import corpus_pipeline

from . import brute

SF = "/root/testdata/sf0.001"


def test_near_duplicates_and_contaminated_documents_leave(spark):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    components = brute.jaccard_components(texts, 5, 80)
    one_each = {d for d, (_, c) in components.items() if d == c}
    assert len(one_each) < len(texts)
    got = stages["ngram_jaccard"](spark, docs, SF).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted(t for t in texts if t[0] in one_each)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = brute.contamination(texts, items)
    clean = {d for d, x in found.items() if not x[-1]}
    assert len(clean) < len(texts)
    got = stages["benchmark_decontamination"](spark, docs, SF).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted(t for t in texts if t[0] in clean)


def test_the_whole_run(spark):
    """``run`` equals its stages one after the other, and the last one what the library encodes of the mix."""
    tokenizers = pytest.importorskip("tokenizers")
    from trendlake.llm import queries
    from trendlake.llm.mixing import with_copies
    from trendlake.llm.quality_rules import judge
    from trendlake.llm.store import cut

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = cut(stages["quality_rules"](spark, docs, SF), "run-1")
    judged = {r.doc_id: r for r in judge(docs, labels).collect()}
    base = {r.doc_id: brute.base_counts(r.text)["base_failed"] for r in docs.collect()}
    assert {r.doc_id for r in kept.collect()} == {d for d, r in judged.items() if r.kept} and all(judged[d].base_failed == b for d, b in base.items())

    texts = [(r.doc_id, r.text) for r in kept.collect()]
    one_each = {d for d, (_, c) in brute.jaccard_components(texts, 5, 80).items() if d == c}
    single = cut(stages["ngram_jaccard"](spark, kept, SF), "run-2")
    assert {r.doc_id for r in single.collect()} == one_each
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {d for d, x in brute.contamination([t for t in texts if t[0] in one_each], items).items() if not x[-1]}
    cleaned = cut(stages["benchmark_decontamination"](spark, single, SF), "run-3")
    assert {r.doc_id for r in cleaned.collect()} == clean

    copies = {r.doc_id: r.mix.copies for r in with_copies(cleaned).collect()}
    mixed = sorted((d, t) for d, t in texts if d in clean for _ in range(copies[d]))
    assert sorted((r.doc_id, r.text) for r in stages["source_mix"](spark, cleaned, SF).collect()) == mixed
    tokenizer = tokenizers.Tokenizer.from_file(queries.tokenizer_file("word_bpe_49k.json"))
    want = brute.token_rows(mixed, lambda t: tokenizer.encode(t, add_special_tokens=False).ids)
    got = corpus_pipeline.run(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == sorted(want)
