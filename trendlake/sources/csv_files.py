"""S2 / S6 for many files: CSV read in splits though quoted fields hold newlines, each file by its own header.

Spark reads a CSV file with quoted newlines in one task, because a split cannot know whether
it begins inside quotes.  Whether it does is the parity of the quotes before it, so:

1. One pass over the lines (split at ``\\n`` in parallel by the text source) gives for each
   split its bytes, whether its quotes are odd in number, its first line, and the two texts that
   may belong to records over its borders: its lines to the first one with an odd number of
   quotes, and those from the last such line on.  That table, a row for each split, is written.
   Running sums over a file's splits then give the parity and the byte offset at which each
   split begins, and with them the fragments of the records that cross borders.
2. A second pass walks the lines of each split with that parity and joins them to the records
   that lie in it.  The fragments are put together by file.
3. Each record is parsed once, with the number of fields of its own file's header, and its fields
   are matched to columns by name.  Records that do not fit their header, are longer than
   ``max_record_bytes`` or end within quotes are set aside with file, byte offset and reason.

Quotes must stand only around fields (RFC 4180, which Spark's writer follows).  A quote that is
never closed makes the rest of its file one record, as for any reader; it is set aside.
Blank lines are skipped.  A file without a line has no header and no rows.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trendlake.session import scratch_dir, ship_code, shuffles_dropped
from trendlake.sources.snapshots import CSV_OPTIONS

MAX_HEADERS = 1_000
MAX_RECORD_BYTES = 16 << 20
SURVEY = "file string, split long, size long, odd boolean, any_odd boolean, first struct<value:string,odd:boolean>, lead string, lead_size long, tail string, tail_size long"
WHOLE = "file string, offset long, text string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line with its file and split."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, cut where a split ends."""
    for batch in batches:
        n = batch.num_rows
        if n:
            file, split = batch.column("file"), batch.column("split").to_numpy()
            ends = (split[1:] != split[:-1]) | pc.not_equal(file[1:], file[:-1]).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(ends) + 1).tolist(), n]
            for a, b in zip(edges, edges[1:]):
                yield batch.slice(a, b - a)


def _split_of(run: pa.RecordBatch) -> tuple[str, int]:
    return run.column("file")[0].as_py(), run.column("split")[0].as_py()


def _measured(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of each line and whether its quotes are odd in number."""
    return pc.binary_length(values).to_numpy().astype(np.int64) + 1, pc.count_substring(values, '"').to_numpy() % 2 == 1


class _Text:
    """Consecutive lines; beyond ``max_bytes`` only their size is kept."""

    def __init__(self, max_bytes: int):
        self.max_bytes, self.size, self.parts = max_bytes, 0, []

    def add(self, values: pa.Array, sizes: np.ndarray) -> None:
        self.size += int(sizes.sum())
        self.parts = [*self.parts, values] if self.size <= self.max_bytes else []

    def joined(self) -> pa.Array:
        """One text, null if it is too long."""
        if not self.parts:
            return pa.nulls(1, pa.string())
        lines = pa.concat_arrays(self.parts)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), lines), "\n")


class _Split:
    """What the first pass keeps of a split."""

    def __init__(self, of: tuple[str, int], max_bytes: int):
        self.of, self.max_bytes = of, max_bytes
        self.size, self.n_odd, self.first = 0, 0, None
        self.lead, self.tail = _Text(max_bytes), _Text(max_bytes)

    def add(self, values: pa.Array) -> None:
        sizes, is_odd = _measured(values)
        odd = np.flatnonzero(is_odd)
        if self.first is None:
            k = pc.index(pc.not_equal(pc.ascii_trim(values, " "), ""), True).as_py()
            if k >= 0:
                self.first = {"value": values[k].as_py(), "odd": bool(is_odd[k])}
        if not self.n_odd and self.of[1]:  # a file begins outside of quotes
            upto = int(odd[0]) + 1 if len(odd) else len(values)
            self.lead.add(values[:upto], sizes[:upto])
        if len(odd):
            self.tail = _Text(self.max_bytes)
            self.tail.add(values[int(odd[-1]):], sizes[odd[-1]:])
        elif self.n_odd:
            self.tail.add(values, sizes)
        self.size, self.n_odd = self.size + int(sizes.sum()), self.n_odd + len(odd)

    def row(self) -> pa.RecordBatch:
        closed = not self.of[1] and self.n_odd % 2 == 0
        columns = {
            "file": pa.array([self.of[0]]), "split": pa.array([self.of[1]], pa.int64()), "size": pa.array([self.size], pa.int64()),
            "odd": pa.array([self.n_odd % 2 == 1]), "any_odd": pa.array([self.n_odd > 0]), "first": pa.array([self.first], pa.struct({"value": pa.string(), "odd": pa.bool_()})),
            "lead": self.lead.joined(), "lead_size": pa.array([self.lead.size], pa.int64()),
            "tail": pa.nulls(1, pa.string()) if closed else self.tail.joined(), "tail_size": pa.array([self.tail.size], pa.int64())}
        return pa.RecordBatch.from_pydict(columns)


def _survey(max_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = None
        for lines in _runs(batches):
            of = _split_of(lines)
            if seen is None or of != seen.of:
                if seen is not None:
                    yield seen.row()
                seen = _Split(of, max_bytes)
            seen.add(lines.column("value"))
        if seen is not None:
            yield seen.row()
    return run


def _places(survey: DataFrame) -> DataFrame:
    """file, split, the byte offset at which it begins, and whether it begins and ends inside quotes."""
    upto = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    odd, mine = F.sum(F.col("odd").cast("long")).over(upto), F.col("odd").cast("long")
    return survey.select("file", "split", (F.sum("size").over(upto) - F.col("size")).alias("begins"), ((odd - mine) % 2 == 1).alias("inside"), (odd % 2 == 1).alias("ends_inside"))


def _assemble(max_bytes: int):
    """The records that begin and end in one split."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, pending = None, None
        for lines in _runs(batches):
            values, n = lines.column("value"), lines.num_rows
            if _split_of(lines) != split:  # what was pending goes on in another split
                split, pending = _split_of(lines), None
                at, inside = lines.column("begins")[0].as_py(), lines.column("inside")[0].as_py()
            sizes, odd = _measured(values)
            states = np.logical_xor.accumulate(np.concatenate([[inside], odd]))
            offsets = at + np.concatenate([[0], np.cumsum(sizes)])
            inside, at = bool(states[-1]), int(offsets[-1])
            starts = np.flatnonzero(~states[:-1])
            before = int(starts[0]) if len(starts) else n
            if pending is not None:
                pending.add(values[:before], sizes[:before])
                if before < n or not inside:
                    yield _whole(split, [pending_at], pending.joined())
                    pending = None
            end = n
            if inside and len(starts):
                end, starts = int(starts[-1]), starts[:-1]
                pending, pending_at = _Text(max_bytes), int(offsets[end])
                pending.add(values[end:], sizes[end:])
            if len(starts):
                text = values[before:end]
                if len(starts) < end - before:
                    edges = np.concatenate([starts, [end]]) - before
                    text = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), text), "\n")
                fits = np.add.reduceat(sizes[:end], starts) <= max_bytes
                yield _whole(split, offsets[starts], text if fits.all() else pc.if_else(pa.array(fits), text, None))
    return run


def _whole(split: tuple[str, int], offsets: Sequence[int], text: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"file": pa.repeat(split[0], len(text)), "offset": pa.array(offsets, pa.int64()), "text": text})


def _records(whole: DataFrame, survey: DataFrame, places: DataFrame, max_bytes: int) -> DataFrame:
    """file, offset, text (null if too long) and whether the record is closed; fragments are put together by file."""
    at_borders = survey.join(places, ["file", "split"])
    goes_on = at_borders.where("inside").select("file", F.col("begins").alias("offset"), F.lit(False).alias("opens"), F.col("lead_size").alias("size"), F.col("lead").alias("text"))
    opens = at_borders.where("ends_inside and any_odd").select("file", (F.col("begins") + F.col("size") - F.col("tail_size")).alias("offset"), F.lit(True).alias("opens"), F.col("tail_size").alias("size"), F.col("tail").alias("text"))
    in_file = Window.partitionBy("file").orderBy("offset")
    opened = F.last(F.when(F.col("opens"), F.col("offset")), ignorenulls=True).over(in_file)
    pieces = goes_on.unionByName(opens).withColumn("opened", opened)
    rows = F.sort_array(F.collect_list(F.struct("offset", "text")))
    joined = pieces.groupBy("file", "opened").agg(rows.alias("rows"), F.count_if(F.col("text").isNull()).alias("missing"), F.sum("size").alias("size"), F.max("offset").alias("last"))
    text = F.when((F.col("missing") == 0) & (F.col("size") <= max_bytes), F.array_join("rows.text", "\n"))
    quotes = F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))
    closed = F.coalesce(quotes % 2 == 0, F.lit(True))
    return whole.withColumn("closed", F.lit(True)).unionByName(joined.select("file", F.col("opened").alias("offset"), text.alias("text"), closed.alias("closed")))


def header_names(line: str) -> list[str]:
    """The column names of a header record (a byte order mark does not count)."""
    return next(csv.reader([line.removeprefix("﻿").removesuffix("\r")]), [])


@dataclass(frozen=True)
class CsvFiles:
    """Parsed records of some CSV files: ``parsed`` has file, offset, record, fields by header, and ``reason`` (null for good ones)."""

    parsed: DataFrame
    headers: tuple[tuple[str, ...], ...]

    def _value(self, name: str) -> Column:
        places = [names.index(name) if name in names else -1 for names in self.headers]
        if max(places, default=-1) < 0:
            return F.lit(None).cast("string")
        # A list to look up: a branch for each header and column makes long code, which was measured to be slow.
        return F.get(F.col("fields"), F.get(F.lit(places), F.col("header")))

    def names(self) -> list[str]:
        """All column names, in the order of the headers."""
        return list(dict.fromkeys(n for names in self.headers for n in names))

    def rows(self, columns: Sequence[str] | None = None, position: bool = False) -> DataFrame:
        """The good records as text columns, matched by name (null where a file lacks the column).

        ``position`` adds ``file`` and ``offset`` (bytes from the start of the file), which
        give the input order.
        """
        good = self.parsed.where("reason is null")
        place = ["file", "offset"] if position else []
        return good.select(*place, *[self._value(c).alias(c) for c in (columns or self.names())])

    def bad(self) -> DataFrame:
        """file, offset, reason and record of the records set aside."""
        return self.parsed.where("reason is not null").select("file", "offset", "reason", "record")


def read_csv_files(spark: SparkSession, path: str, short_rows: str = "bad", max_record_bytes: int = MAX_RECORD_BYTES) -> CsvFiles:
    """Read the CSV files below ``path``; a record has as many fields as its file's header.

    ``short_rows="pad"`` accepts records with fewer fields and fills them with nulls, as the
    result loader does.  At most ``MAX_HEADERS`` different headers are accepted.
    """
    if short_rows not in ("bad", "pad"):
        raise ValueError("short_rows must be 'bad' or 'pad'")
    ship_code(spark)
    lines = _lines(spark, path)
    kept = scratch_dir(spark, "csv-splits")
    with shuffles_dropped(spark):
        lines.mapInArrow(_survey(max_record_bytes), SURVEY).repartition("file").write.parquet(kept)
    survey = spark.read.parquet(kept)
    # A row for each split, as the driver's own list of splits has; joining it keeps the lines in order.
    places = _places(survey)
    placed = lines.join(F.broadcast(places.drop("ends_inside")), ["file", "split"])
    records = _records(placed.mapInArrow(_assemble(max_record_bytes), WHOLE), survey, places, max_record_bytes)

    first = survey.where("first is not null").groupBy("file").agg(F.min_by("first", "split").alias("first")).select("file", "first.value", "first.odd")
    if first.where("odd").isEmpty():
        first = first.select("file", F.regexp_replace("value", "\r$", "").alias("header_text"))
    else:  # a name with a newline in it: the header is a record of several lines
        first = records.where(F.trim("text") != "").groupBy("file").agg(F.min_by("text", "offset").alias("header_text")).withColumn("header_text", F.regexp_replace("header_text", "\r$", ""))
    texts = [r["header_text"] for r in first.select("header_text").distinct().orderBy("header_text").limit(MAX_HEADERS + 1).collect()]
    if len(texts) > MAX_HEADERS:
        raise ValueError(f"more than {MAX_HEADERS} different headers")
    headers = [header_names(t) for t in texts]
    number = spark.createDataFrame(list(zip(texts, range(len(texts)))), "header_text string, header int")
    of_file = first.join(F.broadcast(number), "header_text").select("file", "header", "header_text")

    record = F.when(F.contains("text", F.lit("\r")), F.regexp_replace("text", "\r$", "")).otherwise(F.col("text"))
    body = records.join(F.broadcast(of_file), "file").withColumn("record", record).where("record is null or (trim(record) <> '' and record <> header_text)")
    return CsvFiles(_parsed(body, headers, short_rows), tuple(map(tuple, headers)))


def _parsed(body: DataFrame, headers: list[list[str]], short_rows: str) -> DataFrame:
    """``body`` with ``fields`` (an array of text) and ``reason``; each record is parsed once."""
    options = {"quote": CSV_OPTIONS["quote"], "escape": CSV_OPTIONS["escape"], "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "misfit", "maxCharsPerColumn": "-1", "maxColumns": str(20_480 + 2 * max(map(len, headers), default=0))}
    spare = 1 if short_rows == "pad" else 0  # one more column shows whether there are too many fields

    def split(width: int) -> Column:
        of = [f"f{i}" for i in range(width)]
        schema = ", ".join(f"{f} string" for f in [*of, *["spare"] * spare, "misfit"])

        def parts(row: Column) -> Column:
            misfit = row.getField("spare" if spare else "misfit").isNotNull()
            return F.struct(F.array(*[row.getField(f) for f in of]).alias("fields"), misfit.alias("misfit"))

        return F.element_at(F.transform(F.array(F.from_csv("record", schema, options)), parts), 1)

    found = F.lit(None).cast("struct<fields:array<string>,misfit:boolean>")
    for width in sorted({len(names) for names in headers}):
        found = F.when(F.col("header").isin([k for k, names in enumerate(headers) if len(names) == width]), split(width)).otherwise(found)
    reason = F.when(F.col("record").isNull(), "the record is too long").when(~F.col("closed"), "a quote is not closed").when(F.col("found.misfit"), "the fields do not fit the header")
    # The optimizer copies a column into each filter on it, but not one that is exploded.
    return body.withColumn("found", F.explode(F.array(found))).select("file", "offset", "header", "record", F.col("found.fields").alias("fields"), reason.alias("reason"))
