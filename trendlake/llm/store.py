"""Shared-folder helpers: written tables that cut lineage, and files by URI.

Everything goes below ``spark.checkpoint.dir`` (see ``trendlake.session``), so a
lost executor loses nothing that a later stage reads.  Files that Spark has no
writer for are opened through ``pyarrow.fs``, which takes the same URIs.
"""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from trendlake.session import scratch_dir


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return the written table."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give this package's code to the executors' Python, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    path = Path(tempfile.mkdtemp(prefix="trendlake-code-")) / f"{package.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)


def shipped(function):
    """``function(spark, ...)`` after the executors have this package's code."""
    @functools.wraps(function)
    def run(spark, *args):
        ship_package(spark)
        return function(spark, *args)
    return run


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared location for files of our own formats."""
    return scratch_dir(spark, name)


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path on it of a URI or a plain path."""
    if re.match(r"file:/(?!/)", uri):
        uri = uri[len("file:"):]
    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def unique_name(stem: str, suffix: str) -> str:
    """A name no other task attempt uses; only names that a committed manifest lists are read."""
    return f"{stem}-{uuid.uuid4().hex}{suffix}"


def row_slices(batch: pa.RecordBatch, column: str, max_bytes: int):
    """Slices of a batch whose ``column`` holds about ``max_bytes`` (one longer value stands alone)."""
    values = batch.column(column)
    sizes = pc.fill_null(pc.binary_length(values), 0).to_pylist()
    first, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > max_bytes:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += size
    if first < len(sizes):
        yield batch.slice(first)
