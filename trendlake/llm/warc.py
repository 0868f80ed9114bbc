"""WARC archives: writing records, and reading them back by boundary-chain verification.

Writing: each page becomes a record; of the pages with one payload of at least
``min_revisit`` bytes the one with the largest page_id is the response and the others are
revisits without a payload of their own.  Tasks write files of about ``file_bytes`` under
names of their own; a written manifest lists the files of committed tasks, so a lost or
repeated task leaves nothing that is read.

Reading: a file is divided into splits, and a split cannot know which ``WARC/1.0`` in it
starts a record and which lies in a payload.  Each task therefore emits every candidate
with its successor (its end by its own Content-Length) and, following successors that lie
in the split, the first one behind it (``leaves``).  Pointer jumping over these edges from
the start of the file, with edges of doubled reach each round, finds the entry of each
split; the chain from the entries is what is kept, and magic inside payloads never is.  A file
whose chain does not end at the end of the file is reported by ``broken_files``.

Archives of other tools read back as well (versions 1.0 and 1.1): header names in any case,
folded header lines, record types of any kind.  An id that is no ``<urn:page:N>`` gives a null
page_id and stays in ``record_id``; a block of another type than ``application/http`` is the
payload as it is; a revisit has the digest that its header states (null without one), and its
size only if this module wrote it.  Each file must be uncompressed.

Defined results: null html is the empty payload; null urls are written without a target;
line breaks in a url are percent-encoded; pages without a page_id are archived each as
``<urn:page:>`` and read back with a null one, null being less than any id; repeated
page_ids are archived each and equal payloads among them refer to the largest id; an empty
table writes no file.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitmap import with_perhaps
from .store import cut, locate, row_slices, unique_name, work_dir

MAGIC = b"WARC/1.0\r\n"
MAGICS = re.compile(rb"WARC/1\.[01]\r\n")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
MAX_HEADER = 64 << 10
LENGTH = re.compile(rb"\r\nContent-Length: *(\d+)\r\n", re.I)
RECORD = "record_id string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def plan_records(pages: DataFrame, min_revisit: int = 1000) -> DataFrame:
    """Pages with payload_bytes, payload_digest (SHA-1), record_type and refers_to.

    Only pages whose digest may be among the repeated ones (a bounded bitmap tells) go
    through the join's shuffle; the others are responses where they are read.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    held = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload).alias("payload_digest"))
    # pre-aggregated, so copies cost a row for each task
    several = held.where(F.col("payload_bytes") >= min_revisit).groupBy("payload_digest").agg(F.max("page_id").alias("response"), F.count("*").alias("c")).where("c > 1").select("payload_digest", "response")
    several = cut(several, "warc-repeated")
    marked = with_perhaps(held, "payload_digest", several.select("payload_digest"), "perhaps")
    joined = marked.where("perhaps").join(several, "payload_digest", "left").select(*held.columns, "response")
    every = joined.unionByName(marked.where("not perhaps").select(*held.columns, F.lit(None).cast("long").alias("response")))
    revisit = F.col("response").isNotNull() & ~F.col("response").eqNullSafe(F.col("page_id")) & (F.col("payload_bytes") >= min_revisit)
    return every.select("page_id", "url", F.when(~revisit, F.col("html")).alias("html"), "payload_bytes", "payload_digest",
                        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("response")).alias("refers_to"))


def record_bytes(page_id: int | None, url: str | None, html: bytes, payload_bytes: int, digest: str, kind: str, refers_to: int | None) -> bytes:
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{"" if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {payload_bytes}"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        block = http
    else:
        block = http + html
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return MAGIC + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, root: str | None = None, min_revisit: int = 1000, file_bytes: int = 64 << 20) -> DataFrame:
    """Write the archives; the manifest ``path, size, records`` of the committed files."""
    spark = pages.sparkSession
    root = root or work_dir(spark, "warc")
    system, where = locate(root)
    system.create_dir(where)

    def run(batches):
        out, path, count, done = None, "", 0, []

        def close():
            done.append((path, out.tell(), count))
            out.close()

        for batch in batches:
            for part in row_slices(batch, "html", 8 << 20):
                for row in part.to_pylist():
                    if out is None:
                        path, count = f"{root}/{unique_name('pages', '.warc')}", 0
                        fs, at = locate(path)
                        out = fs.open_output_stream(at)
                    out.write(record_bytes(row["page_id"], row["url"], (row["html"] or "").encode(), row["payload_bytes"], row["payload_digest"], row["record_type"], row["refers_to"]))
                    count += 1
                    if out.tell() >= file_bytes:
                        close()
                        out = None
        if out is not None:
            close()
        if done:
            paths, sizes, counts = zip(*done)
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], names=["path", "size", "records"])

    return cut(plan_records(pages, min_revisit).mapInArrow(run, "path string, size long, records long"), "warc-manifest")


def _read(file, at: int, size: int) -> bytes:
    file.seek(at)
    return file.read(size)


def _record_end(system, where: str, data: bytes, at: int, offset: int, size: int) -> int | None:
    """Where the record at ``offset`` (``data[at:]``) ends by its header, if that lies in the file."""
    more = MAX_HEADER
    while (end := data.find(b"\r\n\r\n", at)) < 0 and offset + len(data) - at < size:
        more *= 2  # a header that reaches beyond what was read
        with system.open_input_file(where) as file:
            data, at = _read(file, offset, min(more, size - offset)), 0
    length = LENGTH.search(data, at, end + 2) if end >= 0 else None
    after = offset + end - at + 4 + int(length[1]) + 4 if length else size + 1
    return after if after <= size else None


def _scan_split(path: str, size: int, lo: int, hi: int) -> list[tuple[int, int, int]]:
    """Candidates ``(offset, successor, leaves)`` that start in ``[lo, hi)``."""
    system, where = locate(path)
    with system.open_input_file(where) as file:
        begin = max(0, lo - 4)
        data = _read(file, begin, min(size, hi + MAX_HEADER) - begin)
    found = []
    for match in MAGICS.finditer(data, lo - begin):
        at = match.start()
        if at >= hi - begin:
            break
        offset = begin + at
        if offset == 0 or data[at - 4:at] == b"\r\n\r\n":
            end = _record_end(system, where, data, at, offset, size)
            if end is not None:
                found.append((offset, end))
    leaves: dict[int, int] = {}
    for offset, successor in reversed(found):  # successors lie behind, so they are known
        leaves[offset] = leaves.get(successor, successor)
    return [(o, s, leaves[o]) for o, s in found]


def _candidates(batches):
    for batch in batches:
        for path, size, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("path", "size", "lo", "hi"))):
            found = _scan_split(path, size, lo, hi)
            n = len(found)
            yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array([lo] * n, pa.int64()), *[pa.array([f[k] for f in found], pa.int64()) for k in range(3)]],
                                             names=["path", "lo", "at", "successor", "leaves"])


def candidate_edges(manifest: DataFrame, split_bytes: int = 8 << 20) -> DataFrame:
    """path, lo (the split), at, successor and leaves of every candidate record, written."""
    n = F.greatest(F.ceil(F.col("size") / split_bytes), F.lit(1))
    splits = manifest.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("k")).select("path", "size", (F.col("k") * split_bytes).alias("lo"), F.least(F.col("size"), (F.col("k") + 1) * split_bytes).alias("hi"))
    total = manifest.agg(F.sum(F.ceil(F.col("size") / split_bytes))).first()[0] or 1
    return cut(splits.repartition(int(total), "path", "lo").mapInArrow(_candidates, "path string, lo long, at long, successor long, leaves long"), "warc-candidates")


def reachable_entries(edges: DataFrame) -> DataFrame:
    """``path, at`` of the first record of each split that the chain from the file's start reaches.

    Each round the reached set grows by the edges' reach and the edges' reach doubles, so
    the rounds are the logarithm of the splits of the longest file.
    """
    jump = edges.select("path", "at", F.col("leaves").alias("to"))
    reached = cut(edges.where("at = 0").select("path", "at"), "warc-reached")
    while True:
        grown = cut(reached.unionByName(reached.join(jump, ["path", "at"]).select("path", F.col("to").alias("at")).join(jump.select("path", "at"), ["path", "at"], "left_semi")).distinct(), "warc-reached")
        if grown.count() == reached.count():
            return grown
        reached = grown
        far = jump.select("path", F.col("at").alias("to"), F.col("to").alias("next"))
        # one left join, written whole: each round reads a table and its plan stays as small as the first one's
        jump = cut(jump.join(far, ["path", "to"], "left").select("path", "at", F.coalesce("next", "to").alias("to")), "warc-jump")


def verified_records(manifest: DataFrame, split_bytes: int = 8 << 20) -> DataFrame:
    """``path, lo, entry, at, successor`` candidates together with the entry of their split."""
    edges = candidate_edges(manifest, split_bytes)
    entries = reachable_entries(edges).select("path", F.col("at").alias("entry"))
    entry = entries.withColumn("lo", F.col("entry") - F.pmod("entry", F.lit(split_bytes)))
    return edges.join(entry, ["path", "lo"])


def broken_files(manifest: DataFrame, split_bytes: int = 8 << 20) -> DataFrame:
    """Files whose chain does not end at their last byte, or which have no record at their start."""
    edges = candidate_edges(manifest, split_bytes)
    ends = edges.join(reachable_entries(edges), ["path", "at"], "left_semi").select("path", F.col("leaves").alias("size")).distinct()
    return manifest.where("size > 0").join(ends, ["path", "size"], "left_anti").select("path", "size", "records")


def read_archives(manifest: DataFrame, split_bytes: int = 8 << 20) -> DataFrame:
    """The records of the archives with their payloads (null for revisits)."""
    chains = verified_records(manifest, split_bytes).groupBy("path", "lo", "entry").agg(F.sort_array(F.collect_list(F.struct("at", "successor"))).alias("found"))

    def run(batches):
        for batch in batches:
            for path, entry, found in zip(*(batch.column(c).to_pylist() for c in ("path", "entry", "found"))):
                system, where = locate(path)
                with system.open_input_file(where) as file:
                    rows = []
                    successor = {f["at"]: f["successor"] for f in found}
                    at = entry
                    while at in successor:
                        rows.append(parse_record(_read(file, at, successor[at] - at)))
                        at = successor[at]
                        if len(rows) >= 256:
                            yield _record_batch(rows)
                            rows = []
                    if rows:
                        yield _record_batch(rows)

    return chains.mapInArrow(run, RECORD)


PAGE = re.compile(r"<urn:page:(\d*)>")


def header_fields(head: bytes) -> dict[str, str]:
    """The named fields of a header block (after its version line), names in lower case; of repeated names the first counts."""
    lines: list[str] = []
    for line in head.decode(errors="replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and lines:
            lines[-1] += " " + line.strip()
        else:
            lines.append(line)
    fields: dict[str, str] = {}
    for name, colon, value in (line.partition(":") for line in lines):
        if colon:
            fields.setdefault(name.strip().lower(), value.strip())
    return fields


def page_number(record_id: str | None) -> int | None:
    found = PAGE.fullmatch(record_id or "")
    return int(found[1]) if found and found[1] else None


def parse_record(raw: bytes) -> dict:
    """A record's fields; the payload's size and digest are taken from the payload itself where there is one."""
    head, _, block = raw.partition(b"\r\n\r\n")
    fields, block = header_fields(head), block[:-4]
    kind = fields.get("warc-type")
    out = {"record_id": fields.get("warc-record-id"), "page_id": page_number(fields.get("warc-record-id")), "record_type": kind, "url": fields.get("warc-target-uri"), "refers_to": None}
    if kind == "revisit":
        size, digest = fields.get("x-payload-length"), fields.get("warc-payload-digest")
        return out | {"payload_bytes": int(size) if size else None, "payload_digest": digest.removeprefix("sha1:") if digest else None, "refers_to": page_number(fields.get("warc-refers-to")), "payload": None}
    http = fields.get("content-type", "").replace(" ", "").lower().startswith("application/http")
    payload = block.partition(b"\r\n\r\n")[2] if http else block
    return out | {"payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest(), "payload": payload}


_RECORD_ARROW = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])


def _record_batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_RECORD_ARROW)
