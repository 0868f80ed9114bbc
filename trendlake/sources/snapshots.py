"""Raw or cleaned snapshot tables from Parquet or CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendlake.schema import RAW_COLUMNS

# RFC-4180 CSV dialect (double quote, doubled-quote escape).
CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"'}


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet snapshot table (raw or cleaned), schema from the files."""
    return spark.read.parquet(path)


def read_csv_by_header(spark: SparkSession, path: str, multi_line: bool = True, **options: str) -> DataFrame:
    """All columns as text.  The first header is the schema; a file with another header (names
    or order) fails the read instead of giving its values to the wrong columns.  Without
    ``multi_line`` a file is split between tasks; with it, quoted fields may hold newlines."""
    options = {**CSV_OPTIONS, "multiLine": str(multi_line).lower(), **options}
    names = spark.read.options(**options).csv(path).schema
    return spark.read.options(**options, enforceSchema="false").schema(names).csv(path)


def read_snapshots_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Raw snapshot CSV with a header row; quoted fields may hold commas,
    doubled quotes and newlines.  Columns are matched by header name (no
    schema inference pass) and every raw column is returned as text; a raw
    column missing from the file is NULL."""
    df = read_csv_by_header(spark, path, multi_line)
    present = set(df.columns)
    return df.select(
        *[F.col(c) if c in present else F.lit(None).cast("string").alias(c) for c in RAW_COLUMNS]
    )
