"""Parquet / CSV sinks and publishing of result tables.

Published tables are multi-file Parquet, partitioned by country and sorted
inside each file by the lookup keys, so a country lookup prunes to one folder
and Parquet min/max statistics skip row groups.  ``export_csv`` writes one
part file only when asked to, because that funnels the table through one
task; it is meant for the small top-k tables.
"""

from __future__ import annotations

import os
import re
import time
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendlake.schema import COUNTRY, RESULT_TABLES, TableSpec
from trendlake.session import shuffles_dropped
from trendlake.sources.snapshots import CSV_OPTIONS

# Fixed value: separator of list cells in exported / published text.
LIST_SEPARATOR = "|"
# Fixed value: publication order of the five result tables.
PUBLISH_ORDER = (
    "top10_channels_per_country",
    "top10_categories_per_country",
    "top10_videos_per_country",
    "category_trends_over_time",
    "video_trends_over_time",
)


def write_snapshots(df: DataFrame, path: str) -> None:
    """S3: overwrite a Parquet snapshot table."""
    with shuffles_dropped(df.sparkSession):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_by_key(df: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """A Parquet table in buckets of ``keys``, opened: whatever groups by these keys and others
    reads it without a shuffle.

    ``df`` should be dealt out by ``repartition(buckets(spark), *keys)``, so that each task writes
    one file.  The name in the catalog is only needed to open the table, and goes again.
    """
    spark, name = df.sparkSession, f"by_key_{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite").bucketBy(buckets(spark), *keys).option("path", path).option("compression", "zstd")
    with shuffles_dropped(spark):
        writer.saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay: the table has a path of its own
    return table


def buckets(spark: SparkSession) -> int:
    """As many as a shuffle has partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def publishable(df: DataFrame) -> DataFrame:
    """Array columns -> ``a|b|c`` text; an empty or missing list -> NULL."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.ArrayType):
            text = F.concat_ws(LIST_SEPARATOR, F.col(f.name))
            cols.append(F.nullif(text, F.lit("")).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def export_csv(df: DataFrame, path: str, single_file: bool = False, sort_by: Sequence[str] = (), compression: str = "none") -> None:
    """Header, overwrite, RFC-4180 quoting; lists as pipe text.

    ``sort_by`` (L1) orders the rows over all files in name order, by a range sort.  ``compression``
    (``gzip``) makes tables of many files several times smaller; each file is then read by one task.
    """
    out = publishable(df)
    if sort_by:
        out = out.orderBy(*sort_by)
    if single_file:
        out = out.coalesce(1)
    options = {k: v for k, v in CSV_OPTIONS.items() if k != "multiLine"}
    # Spark's writer trims values unless told otherwise.
    keep_spaces = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    with shuffles_dropped(df.sparkSession):
        out.write.mode("overwrite").options(**options, **keep_spaces, compression=compression).csv(path)


def conform(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Columns of ``spec`` in order and type; engagement becomes decimal(10,4)
    (``try_cast``: a value that does not fit is NULL; operators.quality.Q5
    reports those rows before publishing)."""
    out = publishable(df)
    cols = []
    for f in spec.schema.fields:
        c = F.col(f.name)
        if f.name in spec.decimal_10_4:
            cols.append(c.try_cast(T.DecimalType(10, 4)).alias(f.name))
        else:
            cols.append(c.cast(f.dataType).alias(f.name))
    return out.select(*cols)


def publish(
    df: DataFrame,
    table: str,
    path: str | None = None,
    partition_by: Sequence[str] | None = (COUNTRY,),
    sort_by: Sequence[str] | None = None,
) -> None:
    """S8 + S10: full refresh of one result table.

    With ``path`` the table is written as Parquet there; without, it is saved
    to the session catalog under ``table`` (a view of its latest version).  Rows are
    partitioned by country and sorted by the table's lookup keys within each file.
    Several tables are replaced together by ``sources.releases``.
    """
    spec = RESULT_TABLES.get(table)
    out = conform(df, spec) if spec else publishable(df)
    # Spark's folder names have no form of an empty text other than NULL's.
    for c in partition_by or ():
        if c in out.columns and isinstance(out.schema[c].dataType, T.StringType):
            out = out.withColumn(c, F.when(F.col(c) == "", F.raise_error(F.lit(f"{table}: empty {c}"))).otherwise(F.col(c)))
    keys = list(sort_by if sort_by is not None else (spec.sort_by if spec else ()))
    parts = [p for p in (partition_by or ()) if p in out.columns]
    order = parts + [k for k in keys if k not in parts]
    if parts and spec is not None:
        # Result tables are bounded (top-k lists, months x categories per
        # country), so one file per country folder is cheap to produce and a
        # lookup then opens a single file.
        out = out.repartition(*parts)
    if order:
        out = out.sortWithinPartitions(*order)
    writer = out.write.mode("overwrite")
    if parts:
        writer = writer.partitionBy(*parts)
    if path is not None:
        with shuffles_dropped(df.sparkSession):
            writer.parquet(path)
        return
    _publish_to_catalog(out, writer, parts, table)


#: Ends the name of a version table: milliseconds since 1970, then a random part.
VERSION_SUFFIX = re.compile(r"__v(\d{13})_[0-9a-f]{8}$")
KEPT_VERSIONS = 2


def _publish_to_catalog(out: DataFrame, writer, parts: Sequence[str], table: str) -> None:
    """Write a version table of its own and then point the view ``table`` at it, in one catalog step.

    Readers see the old version until that step and the new one after it, never none; a run
    that fails before it changes nothing.  The last ``KEPT_VERSIONS`` versions stay.
    """
    spark = out.sparkSession
    root = _version_root(spark)
    database, _, name = table.rpartition(".")
    prefix = f"{database}." if database else ""
    version = f"{name}__v{int(time.time() * 1000):013d}_{uuid.uuid4().hex[:8]}"
    location = f"{root}/{database or 'default'}/{version}"
    with shuffles_dropped(spark):
        writer.parquet(location)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields)
    by = f" PARTITIONED BY ({', '.join(f'`{p}`' for p in parts)})" if parts else ""
    spark.sql(f"CREATE TABLE {prefix}`{version}` ({columns}) USING parquet{by} LOCATION '{location}'")
    if parts:
        spark.catalog.recoverPartitions(f"{prefix}{version}")
    if spark.catalog.tableExists(table) and spark.catalog.getTable(table).tableType != "VIEW":
        spark.sql(f"DROP TABLE {table}")  # a plain table from before there were versions
    spark.sql(f"CREATE OR REPLACE VIEW {prefix}`{name}` AS SELECT {', '.join(f'`{c}`' for c in out.columns)} FROM {prefix}`{version}`")

    found = [t.name for t in spark.catalog.listTables(database or None) if VERSION_SUFFIX.search(t.name) and VERSION_SUFFIX.sub("", t.name) == name]
    for old in sorted(found)[:-KEPT_VERSIONS]:
        spark.sql(f"DROP TABLE {prefix}`{old}`")
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{database or 'default'}/{old}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _version_root(spark: SparkSession) -> str:
    """Where version tables lie: the warehouse, or a folder of the shared checkpoint location
    where the warehouse is still the default one, which executors may not see."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    try:
        root = _shared_warehouse(spark)
    except RuntimeError:
        if not shared:
            raise
        return f"{shared.rstrip('/')}/warehouse"
    own_processes = spark.sparkContext.master.startswith("local-cluster")
    return f"{shared.rstrip('/')}/warehouse" if own_processes and shared and _is_default(root) else root


def _is_default(root: str) -> bool:
    return bool(re.fullmatch(r"(file:/*)?.*/spark-warehouse", root)) and re.sub(r"^file:/*", "/", root) == f"{os.getcwd()}/spark-warehouse"


def _shared_warehouse(spark: SparkSession) -> str:
    """The warehouse folder; on a cluster it must have been set, as the default is a folder of the driver's machine."""
    root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if _is_default(root) and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.sql.warehouse.dir to a folder shared by all executors")
    return root


def read_published(spark: SparkSession, table: str, path: str) -> DataFrame:
    """A published result table with its declared types: a country stays the text it
    was (``'01'``), which Spark would otherwise infer as a number from the folder name."""
    spec = RESULT_TABLES[table]
    fields = [
        T.StructField(f.name, T.DecimalType(10, 4) if f.name in spec.decimal_10_4 else f.dataType, True)
        for f in spec.schema.fields
    ]
    return spark.read.schema(T.StructType(fields)).parquet(path).select(*spec.columns)


# The result store's load batch size.
JDBC_BATCH_SIZE = 500


def publish_jdbc(df: DataFrame, table: str, url: str, properties: Mapping[str, str] | None = None) -> None:
    """S8 for a relational store: full refresh through JDBC.

    ``truncate`` keeps the table and its declared constraints and indexes;
    rows go in batches of 500 inside each task's transaction.  Needs the
    store's JDBC driver on the classpath.
    """
    spec = RESULT_TABLES.get(table)
    out = conform(df, spec) if spec else publishable(df)
    (
        out.write.mode("overwrite")
        .option("truncate", "true")
        .option("batchsize", str(JDBC_BATCH_SIZE))
        .option("isolationLevel", "READ_COMMITTED")
        .jdbc(url, table, properties=dict(properties or {}))
    )


def publish_all(tables: Mapping[str, DataFrame], base_path: str | None = None) -> list[str]:
    """Refresh the result tables in the fixed order; the first failure stops
    the run (later tables keep their previous content).  Returns the names
    published."""
    done = []
    names = [n for n in PUBLISH_ORDER if n in tables] + [n for n in tables if n not in PUBLISH_ORDER]
    for name in names:
        publish(tables[name], name, None if base_path is None else f"{base_path.rstrip('/')}/{name}")
        done.append(name)
    return done
