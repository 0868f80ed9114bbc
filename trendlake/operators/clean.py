"""R0 cleaning (P1-P5) and P6 month columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendlake.functions.dates import parse_trending_date
from trendlake.schema import (
    CATEGORY,
    COUNT_COLUMNS,
    MONTH,
    RAW_COLUMNS,
    RAW_DATE_COLUMN,
    TRENDING_DATE,
    YEAR,
)

# Category texts that are really booleans and get dropped.
BOOLEAN_CATEGORY_TEXT = ("true", "false")
REQUIRED_COLUMNS = ("video_id", "video_published_at", "video_view_count")


def clean_snapshots(raw: DataFrame) -> DataFrame:
    """Keep the 18 snapshot columns, rename the trending date, drop rows without
    id / publish time / views or with a NULL or boolean-text category, and type
    the counters as bigint (``try_cast``: bad text becomes NULL, never an error).

    The NOT NULL filters are on the raw values, so they reach the Parquet scan
    as pushed filters.
    """
    df = raw.select(*RAW_COLUMNS).withColumnRenamed(RAW_DATE_COLUMN, TRENDING_DATE)
    keep = F.lit(True)
    for c in REQUIRED_COLUMNS:
        keep = keep & F.col(c).isNotNull()
    # NOT IN is NULL for a NULL category, so those rows are dropped as well.
    keep = keep & ~F.lower(F.col(CATEGORY)).isin(*BOOLEAN_CATEGORY_TEXT)
    return df.filter(keep).withColumns({c: F.col(c).try_cast("bigint") for c in COUNT_COLUMNS})


def drop_null_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Drop rows with a NULL in any of ``keys``: the rows an inner join on those
    keys would lose.  Written as ``isNotNull`` so it reaches the Parquet scan."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return df.filter(cond)


def with_trending_month(snap: DataFrame) -> DataFrame:
    """Add ``trending_date`` (strictly parsed, NULL when invalid), year and month."""
    d = parse_trending_date(TRENDING_DATE)
    return snap.withColumn("trending_date", d).withColumns(
        {YEAR: F.year("trending_date"), MONTH: F.month("trending_date")}
    )
