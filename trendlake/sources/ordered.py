"""Result tables as files in order, with an index that is read before them.

``write_ordered`` range-partitions a table by its order and sorts each partition, so its files
in number order hold the rows in order, whatever their number.  Next to the files it writes an
index, one row for each file: the rows before it and in it, the least and the greatest value
of chosen columns (a zone map), a Bloom filter of others, and the greatest few values of a
metric.  From that:

* ``with_position`` numbers all rows without sorting (rows before the file + row in the file);
* ``page`` reads only the files that a page overlaps, however deep it lies;
* ``lookup`` reads only files that can hold a value or a range, over all countries;
* ``top`` reads only files that can hold one of the ``k`` greatest values.

The index has as many rows as the table has files, like the list of files that Spark itself
keeps in the driver; the names of the files to read are taken from it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendlake.plans.ordering import Order
from trendlake.session import shuffles_dropped

BLOOM_WORDS = 1024  # of 64 bits for each file and column
BLOOM_HASHES = 3
TOP_VALUES = 10
POSITION = "position"


def _bloom_places(value: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(value.cast("string"), F.lit(seed)), F.lit(BLOOM_WORDS * 64)) for seed in range(BLOOM_HASHES)]


def _file_number() -> dict[str, Column]:
    """The numbers in the name of a file that Spark wrote: the partition, then the piece of it."""
    return {"part": F.regexp_extract("file", r"^part-(\d+)-", 1).cast("long"), "piece": F.regexp_extract("file", r"-c(\d+)\D", 1).cast("long")}


def write_ordered(
    df: DataFrame,
    path: str,
    order: Sequence[Order],
    zones: Sequence[str] = (),
    blooms: Sequence[str] = (),
    tops: Sequence[str] = (),
    files: int | None = None,
) -> "OrderedTable":
    """Write ``df`` in order with its index below ``path``, and open it.

    ``order`` should decide between all rows; rows that it does not tell apart keep any
    order.  ``files`` fixes the number of ranges; by default Spark chooses by size.
    """
    spark, columns = df.sparkSession, [o.as_sort_column() for o in order]
    ranged = df.repartitionByRange(*([files] if files else []), *columns).sortWithinPartitions(*columns)
    with shuffles_dropped(spark):
        ranged.write.parquet(f"{path}/data")
    rows = spark.read.schema(df.schema).parquet(f"{path}/data").withColumn("file", F.col("_metadata.file_name"))
    sums = [F.count("*").alias("n_rows")]
    for c in zones:
        sums += [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"), F.count_if(F.col(c).isNull()).alias(f"nulls_{c}")]
    index = rows.groupBy("file").agg(*sums)
    for c in blooms:
        places = rows.select("file", F.explode(F.array(*_bloom_places(F.col(c)))).alias("at")).where(F.col(c).isNotNull())
        bit = F.call_function("shiftleft", F.expr("1L"), F.pmod("at", F.lit(64)).cast("int"))
        words = places.select("file", F.shiftright("at", 6).cast("int").alias("word"), bit.alias("bit")).groupBy("file", "word").agg(F.bit_or("bit").alias("bits"))
        filters = words.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias(f"bloom_{c}"))
        index = index.join(filters, "file", "left")
    for c in tops:
        greatest = rows.where(F.col(c).isNotNull()).select("file", c).withColumn("nth", F.row_number().over(Window.partitionBy("file").orderBy(F.desc(c)))).where(F.col("nth") <= TOP_VALUES)
        index = index.join(greatest.groupBy("file").agg(F.sort_array(F.collect_list(c), asc=False).alias(f"top_{c}")), "file", "left")
    before = Window.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    index = index.withColumns(_file_number()).withColumn("start", F.coalesce(F.sum("n_rows").over(before), F.lit(0)))
    with shuffles_dropped(spark):
        index.coalesce(1).write.parquet(f"{path}/index")
    return open_ordered(spark, path)


def open_ordered(spark: SparkSession, path: str) -> "OrderedTable":
    return OrderedTable(spark, path, spark.read.parquet(f"{path}/index"))


@dataclass(frozen=True)
class OrderedTable:
    """A written table in order; ``index`` has a row for each file."""

    spark: SparkSession
    path: str
    index: DataFrame
    schema: T.StructType = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "schema", self.spark.read.parquet(f"{self.path}/data").schema)

    @property
    def columns(self) -> list[str]:
        return self.schema.names

    def rows(self) -> DataFrame:
        """All rows (in no order once Spark has dealt them out; see ``with_position``)."""
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/data")

    def _read(self, files: DataFrame, keep_file: bool = False) -> DataFrame:
        """The rows of some files of the index, with their position."""
        some = files.select("file", "start")
        names = [r["file"] for r in some.collect()]
        rows = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{n}" for n in names]) if names else self.rows().where("false")
        return self._numbered(rows, some, keep_file)

    def _numbered(self, rows: DataFrame, files: DataFrame, keep_file: bool = False) -> DataFrame:
        names = rows.columns
        placed = rows.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
        joined = placed.join(F.broadcast(files.select("file", "start")), "file")  # a row for each file
        return joined.select(*names, *(["file"] if keep_file else []), (F.col("start") + F.col("row") + 1).alias(POSITION))

    def with_position(self) -> DataFrame:
        """All rows with their place (1, 2, 3 ...) in the table's order."""
        return self._numbered(self.rows(), self.index)

    # ------------------------------------------------------------ which files
    def _can_equal(self, column: str, value: object) -> Column:
        """On the index: whether a file can hold ``value`` in ``column`` (``None``: a null)."""
        test = F.lit(True)
        kind = self.schema[column].dataType
        if f"min_{column}" in self.index.columns:
            if value is None:
                test &= F.col(f"nulls_{column}") > 0
            else:
                test &= F.lit(value).cast(kind).between(F.col(f"min_{column}"), F.col(f"max_{column}"))
        if value is not None and f"bloom_{column}" in self.index.columns:
            for at in _bloom_places(F.lit(value).cast(kind)):
                word = F.coalesce(F.try_element_at(f"bloom_{column}", F.shiftright(at, 6).cast("int")), F.lit(0).cast("long"))
                test &= F.call_function("shiftright", word, F.pmod(at, F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1
        return F.coalesce(test, F.lit(False))

    def _can_lie_between(self, column: str, low: object, high: object) -> Column:
        if f"min_{column}" not in self.index.columns:
            return F.lit(True)
        kind = self.schema[column].dataType
        above = F.lit(True) if low is None else F.col(f"max_{column}") >= F.lit(low).cast(kind)
        below = F.lit(True) if high is None else F.col(f"min_{column}") <= F.lit(high).cast(kind)
        return F.coalesce(above & below, F.lit(False))

    def files_for(self, equal: Mapping[str, object] | None = None, between: Mapping[str, tuple] | None = None) -> DataFrame:
        """The rows of the index whose files a lookup has to read."""
        tests = [self._can_equal(c, v) for c, v in (equal or {}).items()] + [self._can_lie_between(c, *v) for c, v in (between or {}).items()]
        return self.index.where(reduce(Column.__and__, tests, F.lit(True)))

    def _holds(self, equal: Mapping[str, object], between: Mapping[str, tuple]) -> Column:
        kind = {f.name: f.dataType for f in self.schema.fields}
        tests = [F.col(c).eqNullSafe(F.lit(v).cast(kind[c])) for c, v in equal.items()]
        for c, (low, high) in between.items():
            tests += [] if low is None else [F.col(c) >= F.lit(low).cast(kind[c])]
            tests += [] if high is None else [F.col(c) <= F.lit(high).cast(kind[c])]
        return reduce(Column.__and__, tests, F.lit(True))

    def _known(self, names: Sequence[str]) -> None:
        unknown = sorted(n for n in names if n not in self.columns)
        if unknown:
            raise KeyError(f"unknown column(s): {', '.join(unknown)}")

    # ------------------------------------------------------------ what is read
    def lookup(self, equal: Mapping[str, object] | None = None, between: Mapping[str, tuple] | None = None) -> DataFrame:
        """The rows with the given values and ranges (``(low, high)``, either may be ``None``), with their position.

        ``None`` as a value finds nulls; a range finds none.
        """
        equal, between = dict(equal or {}), dict(between or {})
        self._known([*equal, *between])
        return self._read(self.files_for(equal, between)).where(self._holds(equal, between))

    def top_files(self, column: str, k: int) -> DataFrame:
        """The rows of the index whose files can hold one of the ``k`` greatest values of ``column``.

        The k-th greatest of the listed values of all files is a lower bound of the k-th
        greatest value of all; a file whose greatest value is less holds none of them.
        """
        listed = self.index.select(F.explode(f"top_{column}").alias("v")).orderBy(F.desc("v")).limit(k)
        bound = listed.agg(F.min("v").alias("v"), F.count("*").alias("n")).first()
        if bound["n"] < k:  # too few listed values to tell
            return self.index.where(F.size(f"top_{column}") > 0)
        return self.index.where(F.get(F.col(f"top_{column}"), F.lit(0)) >= F.lit(bound["v"]))

    def top(self, column: str, k: int, then: Sequence[Order] = ()) -> DataFrame:
        """The ``k`` rows with the greatest values of ``column`` (nulls are none), ties by ``then`` and the table's order."""
        self._known([column])
        rows = self._read(self.top_files(column, k)).where(F.col(column).isNotNull())
        return rows.orderBy(F.desc(column), *[o.as_sort_column() for o in then], POSITION).limit(k)

    def page(self, limit: int, offset: int = 0, equal: Mapping[str, object] | None = None) -> DataFrame:
        """Rows ``offset + 1`` to ``offset + limit`` of those with the given values, in the table's order, with their position.

        Without values, the index alone tells which files the page overlaps.  With values, the
        matching rows of the files that can hold them are counted first (only those columns are
        read); then only the files that the page overlaps are read.
        """
        if limit < 0 or offset < 0:
            raise ValueError("limit and offset must not be negative")
        equal = dict(equal or {})
        self._known(list(equal))
        if not limit:
            return self._read(self.index.where("false"))
        if not equal:
            files = self.index.where((F.col("start") < offset + limit) & (F.col("start") + F.col("n_rows") > offset))
            first = F.col(POSITION) > offset
            return self._read(files).where(first & (F.col(POSITION) <= offset + limit)).orderBy(POSITION)
        holds, able = self._holds(equal, {}), self.files_for(equal)
        named = self._read(able, keep_file=True).where(holds)
        counted = named.groupBy("file").agg(F.count("*").alias("found"), F.min(POSITION).alias("start"))
        before = Window.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
        placed = counted.withColumn("before", F.coalesce(F.sum("found").over(before), F.lit(0)))
        needed = placed.where((F.col("before") < offset + limit) & (F.col("before") + F.col("found") > offset)).collect()
        if not needed:
            return self._read(self.index.where("false"))
        skip = offset - min(r["before"] for r in needed)
        files = self.index.where(F.col("file").isin([r["file"] for r in needed]))
        return self._read(files).where(holds).orderBy(POSITION).offset(max(0, skip)).limit(limit)
