"""Exact suffix order on periodic texts, token ids of every letter, archives of other tools and of many splits."""

from __future__ import annotations

import hashlib
import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("trendlake.llm")

from pyspark.sql import functions as F  # noqa: E402

from trendlake.llm import queries  # noqa: E402
from trendlake.llm.store import cut, locate, ship_package, work_dir  # noqa: E402
from trendlake.llm.suffix_array import suffix_array  # noqa: E402
from trendlake.llm.suffix_dedup import repeated_spans, repeated_strings  # noqa: E402
from trendlake.llm.token_store import WordEncoder, write_tokens  # noqa: E402
from trendlake.llm.warc import broken_files, read_archives, reachable_entries, write_archives  # noqa: E402

from . import brute  # noqa: E402


def repetitive(rng, most, alphabet):
    out = []
    while len(out) < rng.randint(0, most):
        out += [rng.choice(alphabet) for _ in range(rng.randint(1, 6))] * rng.choice([1, 1, 2, 7, 30])
    return out[:most]


def test_suffix_array_is_exact():
    rng = random.Random(1)
    for _ in range(800):
        text = [*repetitive(rng, 60, range(1, rng.choice([2, 3, 5, 900]))), 0]
        assert suffix_array(np.array(text)).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def test_spans_of_periodic_shards():
    rng = random.Random(2)
    for _ in range(400):
        texts = [bytes(repetitive(rng, 80, b"abcd")) for _ in range(rng.randint(1, 4))]
        texts = [t for t in texts if len(t) >= 12]
        if not texts:
            continue
        found = repeated_spans(texts, [1] * len(texts), 12)
        want = brute.repeated_bytes([t.decode() for t in texts], 12)
        assert [sum(b - a for a, b in spans) for spans in found] == [w[1] for w in want]


@pytest.mark.parametrize("hot", [20_000, 0])
def test_periodic_documents_by_either_path(spark, hot):
    ship_package(spark)
    rng = random.Random(3)
    texts = ["".join(map(str, repetitive(rng, 500, "abé"))) for _ in range(40)]
    texts += ["a" * 355, "ab" * 150, "é" * 240, ("row | " * 60) + "end", "a" * 199, "a" * 200, "=" * 300 + "x" + "=" * 210]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeated_strings(docs, hot=hot).collect()}
    assert [got[k] for k in range(len(texts))] == brute.repeated_bytes(texts)


@pytest.fixture(scope="module")
def encoder():
    return WordEncoder(queries.tokenizer_file("word_bpe_49k.json"))


def test_ids_of_every_letter_before_punctuation(encoder):
    rng = random.Random(4)
    marks = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c))[0] in "LNM"]
    texts = [f"ab{c}{rng.choice(marks)} {c}{rng.choice(marks)}{rng.choice(marks)}" for c in letters if ord(c) < 0x3000 or rng.random() < 0.05]
    texts += [f"{c}{m}" for c in "İक़य़ড়ঢ়য়ਲ਼ଡ଼གྷéßÀ" for m in marks]
    texts += ["".join(rng.choice([rng.choice(letters), rng.choice(marks), " ", "\n", "a", "́"]) for _ in range(9)) for _ in range(5000)]
    ids, firsts = encoder.encode(pa.array(texts))
    want = encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    assert all(ids[a:b].tolist() == w.ids for a, b, w in zip(firsts[:-1], firsts[1:], want))


def test_a_vocabulary_that_joins_words_is_refused():
    with pytest.raises(ValueError, match="white space"):
        WordEncoder(queries.tokenizer_file("byte_bpe_50k.json"))


def test_token_store_edges(spark, encoder):
    ship_package(spark)
    rows = [(3, None, 1), (1, "", 2), (None, "a b", 3), (2, "Hello, क़.", 4), (2, "Hello, क़.", 4), (5, "x " * 50_000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long")
    tokenizer = queries.tokenizer_file("word_bpe_49k.json")
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) for r in write_tokens(docs, tokenizer, file_ids=5).documents().collect()))
    want = brute.token_rows([(-1 if d is None else d, t or "") for d, t, _ in rows], lambda t: encoder.tokenizer.encode(t, add_special_tokens=False).ids)
    assert [g[2:] for g in got] == [w[1:] for w in want] and got[0][0] is False
    assert write_tokens(docs.limit(0), tokenizer).documents().count() == 0


def archive(spark, data: bytes):
    root = work_dir(spark, "foreign")
    system, where = locate(root)
    system.create_dir(where)
    with system.open_output_stream(f"{where}/a.warc") as f:
        f.write(data)
    return spark.createDataFrame([(f"{root}/a.warc", len(data), 0)], "path string, size long, records long")


def test_archive_of_another_tool(spark):
    ship_package(spark)
    info = b"software: x\r\nformat: WARC\r\n"
    page = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n<html>\r\n\r\nWARC/1.0\r\nContent-Length: 3\r\n\r\n</html>"
    raw = b"plain block"
    parts = [
        b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Type: application/warc-fields\r\ncontent-length: %d\r\n\r\n%s\r\n\r\n" % (len(info), info),
        b"WARC/1.1\r\nwarc-type: response\r\nWARC-Record-ID:\r\n <urn:uuid:2>\r\nWARC-Target-URI: http://x/:y\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(page), page),
        b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:x>\r\nContent-Length:%d\r\n\r\n%s\r\n\r\n" % (len(raw), raw),
        b"WARC/1.0\r\nWARC-Type: revisit\r\nWARC-Record-ID: <urn:uuid:3>\r\nWARC-Payload-Digest: sha1:ABC\r\nWARC-Refers-To: <urn:uuid:2>\r\nContent-Length: 0\r\n\r\n\r\n\r\n",
    ]
    manifest = archive(spark, b"".join(parts))
    for split in (64, 1 << 20):
        got = {r.record_id: (r.page_id, r.record_type, r.url, r.payload_bytes, r.payload_digest, r.refers_to) for r in read_archives(manifest, split).collect()}
        html = page.partition(b"\r\n\r\n")[2]
        assert got == {
            "<urn:uuid:1>": (None, "warcinfo", None, len(info), hashlib.sha1(info).hexdigest(), None),
            "<urn:uuid:2>": (None, "response", "http://x/:y", len(html), hashlib.sha1(html).hexdigest(), None),
            "<urn:page:x>": (None, "resource", None, len(raw), hashlib.sha1(raw).hexdigest(), None),
            "<urn:uuid:3>": (None, "revisit", None, None, "ABC", None),
        }
        assert broken_files(manifest, split).count() == 0
    assert broken_files(archive(spark, b"".join(parts)[:-7])).count() == 1


def test_many_splits_keep_a_small_plan(spark):
    edges = spark.range(64).select(F.lit("f").alias("path"), (F.col("id") * 10).alias("lo"), (F.col("id") * 10).alias("at"), (F.col("id") * 10 + 10).alias("successor"), (F.col("id") * 10 + 10).alias("leaves"))
    found = reachable_entries(cut(edges, "edges"))
    assert found.count() == 64
    assert found._jdf.queryExecution().optimizedPlan().toString().count("\n") < 5


def test_warc_edges(spark):
    ship_package(spark)
    long = "<p>" + "x" * 3_000_000
    rows = [(1, "u\r\nv", "WARC/1.0\r\n\r\n" * 200, 9), (2, None, long, 9), (3, "u", long, 9), (3, "u", long, 9), (4, "", "", 9), (5, "u", None, 9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, response long")
    got = sorted((r.page_id, r.record_type, r.payload_bytes, r.refers_to) for r in read_archives(write_archives(pages), 4096).collect())
    assert got == [(1, "response", 2400, None), (2, "revisit", len(long), 3), (3, "response", len(long), None), (3, "response", len(long), None), (4, "response", 0, None), (5, "response", 0, None)]
    assert write_archives(pages.limit(0)).count() == 0 and read_archives(write_archives(pages.limit(0))).count() == 0

