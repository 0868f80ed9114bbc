"""Pages without a page_id are archived and read back like any other."""

from __future__ import annotations

import pytest

pytest.importorskip("trendlake.llm")

from trendlake.llm.store import ship_package
from trendlake.llm.warc import broken_files, read_archives, write_archives


def test_pages_without_an_id_come_back(spark):
    ship_package(spark)
    shared, alone = "s" * 2000, "n" * 2000
    rows = [(1, "u1", shared), (2, "u2", shared), (None, "u3", shared), (None, "u4", alone), (None, "u5", alone), (None, None, None), (3, "u6", "short")]
    manifest = write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = sorted(((r.page_id, r.url, r.payload_bytes, r.record_type, r.refers_to, r.payload and r.payload[:1]) for r in read_archives(manifest).collect()), key=repr)
    assert got == sorted([
        (1, "u1", 2000, "revisit", 2, None), (2, "u2", 2000, "response", None, b"s"), (None, "u3", 2000, "revisit", 2, None),
        (None, "u4", 2000, "response", None, b"n"), (None, "u5", 2000, "response", None, b"n"), (None, None, 0, "response", None, b""), (3, "u6", 5, "response", None, b"s"),
    ], key=repr)
    assert broken_files(manifest).count() == 0
