"""Result tables back from CSV (header, quotes, empty -> NULL)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendlake.sources.csv_files import read_csv_files
from trendlake.sources.snapshots import read_csv_by_header


def read_results_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    columns: Mapping[str, str] | None = None,
    in_splits: bool = False,
) -> DataFrame:
    """Read a result CSV.  Blank lines are skipped, short rows are padded with
    NULL, and empty cells -- quoted or not -- become NULL.  ``columns`` renames
    header names to column names; ``schema`` then types the columns by name
    (``try_cast``: a bad cell becomes NULL instead of failing the load).

    ``in_splits`` reads large files by many tasks and each file by its own header
    (``csv_files``); records with too many fields are then left out, see ``CsvFiles.bad``."""
    df = read_csv_files(spark, path, short_rows="pad").rows() if in_splits else read_csv_by_header(spark, path, mode="PERMISSIVE")
    if columns:
        df = df.withColumnsRenamed(dict(columns))
    df = df.select(*[F.nullif(F.col(c), F.lit("")).alias(c) for c in df.columns])
    if schema is None:
        return df
    present = set(df.columns)
    return df.select(
        *[
            (F.col(f.name).try_cast(f.dataType) if f.name in present else F.lit(None).cast(f.dataType)).alias(
                f.name
            )
            for f in schema.fields
        ]
    )
