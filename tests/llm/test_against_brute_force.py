"""Each query over a whole small table equals a plain-Python statement of its contract."""

from __future__ import annotations

import hashlib
import zlib

import pytest

pytest.importorskip("trendlake.llm")

from trendlake.llm import queries

from . import brute

SF = "/root/testdata/sf0.001"


def rows(spark, name, columns):
    return sorted(tuple(r) for r in queries.QUERIES[name](spark, SF).select(*columns).collect())


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def texts(docs):
    return [(d, t) for d, t, _ in docs]


def test_quality_rules(spark, texts):
    got = queries.QUERIES["op1_quality_rules"](spark, SF).collect()
    assert len(got) == len(texts)
    want = {d: brute.base_counts(t) for d, t in texts}
    for r in got:
        assert {k: r[k] for k in want[r.doc_id]} == want[r.doc_id]
        assert not (r.base_failed and r.kept)
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    judged = [(r.kept, quality[r.doc_id]) for r in got if r.doc_id in quality and not r.base_failed]
    assert all(kept for kept, good in judged if good)


def test_mixing(spark, docs):
    got = {r.doc_id: r for r in queries.QUERIES["op2_mixing"](spark, SF).collect()}
    again = {r.doc_id: r for r in queries.QUERIES["op2_mixing"](spark, SF).collect()}
    assert got == again and set(got) == {d for d, _, _ in docs}
    sizes, of = {}, {}
    for d, t, s in docs:
        n = len(brute.WORD.findall(t or ""))
        assert got[d].size == n and got[d].taken in (0, n, 2 * n, 3 * n)
        sizes[s] = sizes.get(s, 0) + n
        of.setdefault(s, []).append(d)
    want = brute.targets(sizes, sorted(sizes, key=lambda s: (s is None, s)))
    for s, ids in of.items():
        assert got[ids[0]].target == pytest.approx(want[s]) and got[ids[0]].source_size == sizes[s]
        largest = max(got[d].size for d in ids)
        assert abs(sum(got[d].taken for d in ids) - want[s]) <= largest / 2 + 1
        copies = {got[d].taken // got[d].size for d in ids if got[d].size}
        assert max(copies) - min(copies) <= 1  # complete epochs come first


def test_token_store(spark, texts):
    tokenizers = pytest.importorskip("tokenizers")
    tokenizer = tokenizers.Tokenizer.from_file(queries.tokenizer_file("word_bpe_49k.json"))
    assert rows(spark, "op3_token_store", ["doc_id", "start", "n_tokens", "ids_crc32"]) == brute.token_rows(texts, lambda t: tokenizer.encode(t, add_special_tokens=False).ids)


def test_suffix_dedup(spark, texts):
    want = sorted((d, *x) for (d, _), x in zip(texts, brute.repeated_bytes([t for _, t in texts])))
    assert rows(spark, "op5_suffix_dedup", ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]) == want


def test_chunk_dedup_catches_whole_copies_and_keeps_first(spark, texts):
    got = {r.doc_id: r for r in queries.QUERIES["op4_chunk_dedup"](spark, SF).collect()}
    first = {}
    for d, t in sorted(texts):
        n = len((t or "").encode())
        assert got[d].n_bytes == n
        if n >= 128:
            if t in first:
                assert got[d].n_removed == n
            first.setdefault(t, d)


def test_warc(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    payload = {p.page_id: (p.html or "").encode() for p in pages}
    last = {}
    for p, b in sorted(payload.items()):
        last[b] = p
    want = sorted((p, len(b), hashlib.sha1(b).hexdigest(), *(("revisit", last[b]) if len(b) >= 1000 and last[b] != p else ("response", None))) for p, b in payload.items())
    assert rows(spark, "op6_warc", ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]) == want


def test_jaccard_join(spark, texts):
    want = sorted((d, n, c) for d, (n, c) in brute.jaccard_components(texts, 4, 85).items())
    assert rows(spark, "op7_jaccard_join", ["doc_id", "n_shingles", "component_id"]) == want


def test_language_id_held_out_accuracy(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.QUERIES["op8_language_id"](spark, SF).collect()
    assert len(got) == len(lang)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    known = [r for r in held if lang[r.doc_id] is not None and r.lang_pred != "und"]
    assert sum(r.lang_pred == lang[r.doc_id] for r in known) >= 0.95 * len(known)


def test_decontamination(spark, texts):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = sorted((d, *x) for d, x in brute.contamination(texts, items).items())
    assert rows(spark, "op9_decontaminate", ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]) == want


def test_secret_scan(spark):
    sf = "/root/testdata/sf0.01"
    want = sorted((r.doc_id, *brute.secrets(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = queries.QUERIES["op10_secret_scan"](spark, sf).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256").collect()
    assert sorted(tuple(r) for r in got) == want
    assert any(x[1] + x[2] + x[3] for x in want)
