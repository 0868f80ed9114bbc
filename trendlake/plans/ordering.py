"""Total orders and per-group selection.

Two physical shapes are offered:

``top_k_per_group``  ``row_number() <= k`` over a window.  Catalyst turns the
filter into a partial ``WindowGroupLimit`` before the shuffle, so each map task
sends at most ``k`` rows per group even when one group holds most rows.

``first_per_group``  the first row of each group under a total order, written
as ``min(struct(order key, payload))``.  This is an ordinary aggregate, so it is
combined map-side: a group with a third of all rows is reduced inside every
map task and the shuffle carries one row per group per task.  A window would
instead shuffle and sort every row of that group in one task.

``rank_by_range``    exact ranks of any length: the rows are range partitioned by group and
order, and a row's rank is its place in its partition plus the group's rows in the partitions
before it.  A group with a third of all rows is spread over a third of the partitions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendlake.session import scratch_dir, shuffles_dropped


@dataclass(frozen=True)
class Order:
    """One sort key: column name, direction; NULLs always sort last."""

    column: str
    ascending: bool = True

    def as_sort_column(self) -> Column:
        c = F.col(self.column)
        return c.asc_nulls_last() if self.ascending else c.desc_nulls_last()


def asc(column: str) -> Order:
    return Order(column, True)


def desc(column: str) -> Order:
    return Order(column, False)


def top_k_per_group(
    df: DataFrame,
    partition_by: Sequence[str],
    order: Sequence[Order],
    k: int,
    rank_col: str = "rank",
) -> DataFrame:
    """Keep the first ``k`` rows of every partition and number them 1..k.

    The partial WindowGroupLimit is planned for ``k`` up to
    ``spark.sql.optimizer.windowGroupLimitThreshold`` (1000 by default).  Longer lists go by
    ``rank_by_range``, which writes a table; a session may raise that setting instead.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    threshold = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if 0 <= threshold < k:
        return rank_by_range(df, partition_by, order, rank_col).filter(F.col(rank_col) <= k)
    w = Window.partitionBy(*partition_by).orderBy(*[o.as_sort_column() for o in order])
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


def rank_by_range(df: DataFrame, partition_by: Sequence[str], order: Sequence[Order], rank_col: str = "rank") -> DataFrame:
    """``df`` with the row number of each row within its group, without a task that holds a group.

    The ranges are sampled from the data and cut groups anywhere, so every partition holds
    about as many rows.  The sorted rows are written once, with their place (partition number
    and row in it), which makes the places a fact that any later task reads alike.  ``order``
    should decide between all rows of a group; NULL keys form a group.
    """
    groups = [F.col(c).asc_nulls_first() for c in partition_by]
    sort = [*groups, *[o.as_sort_column() for o in order]]
    path = scratch_dir(df.sparkSession, "ranked")
    with shuffles_dropped(df.sparkSession):
        df.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_place", F.monotonically_increasing_id()).write.parquet(path)
    placed = df.sparkSession.read.parquet(path).withColumn("_range", F.shiftright("_place", 33))
    names = [f"_group_{i}" for i in range(len(partition_by))]
    pieces = placed.groupBy(*[F.col(c).alias(n) for c, n in zip(partition_by, names)], F.col("_range").alias("_of")).agg(
        F.min("_place").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*names).orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    shifts = pieces.select(*names, "_of", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    same = F.col("_range") == F.col("_of")
    for c, n in zip(partition_by, names):
        same = same & F.col(c).eqNullSafe(F.col(n))
    return placed.join(shifts, same).select(*df.columns, (F.col("_place") + F.col("_shift")).cast("int").alias(rank_col))


_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)


def _descending_value(c: Column, dtype: T.DataType) -> Column:
    """An order-reversing image of ``c`` that cannot overflow."""
    if isinstance(dtype, _INTEGRAL):
        return F.bitwise_not(c)  # ~x = -x - 1, total and overflow free
    if isinstance(dtype, _FRACTIONAL):
        return -c
    raise TypeError(f"descending order on {dtype.simpleString()} is not supported in first_per_group")


@dataclass(frozen=True)
class ArgMin:
    """A total order packed into one struct that ``min`` reduces.

    Fields per order column: a NULL flag (so NULLs sort last) and the value,
    order-reversed for descending columns; then the payload columns.  Because
    ``min`` is associative, the struct can be reduced in steps -- per map task,
    per shuffle partition, or from a pre-aggregated table.
    """

    order: tuple[Order, ...]
    payload: tuple[str, ...]
    dtypes: tuple[tuple[str, T.DataType], ...]

    @classmethod
    def of(cls, dtypes: dict[str, T.DataType], order: Sequence[Order], payload: Sequence[str] = ()) -> "ArgMin":
        ordered = {o.column for o in order}
        extra = tuple(p for p in payload if p not in ordered)
        needed = [o.column for o in order] + list(extra)
        return cls(tuple(order), extra, tuple((c, dtypes[c]) for c in needed))

    def key(self) -> Column:
        types = dict(self.dtypes)
        fields: list[Column] = []
        for i, o in enumerate(self.order):
            c = F.col(o.column)
            fields.append(c.isNull().alias(f"n{i}"))
            v = c if o.ascending else _descending_value(c, types[o.column])
            fields.append(v.alias(f"v{i}"))
        fields += [F.col(p).alias(f"p{j}") for j, p in enumerate(self.payload)]
        return F.struct(*fields)

    def without(self, constant: Sequence[str]) -> "ArgMin":
        """The same order with ``constant`` columns left out.  Inside a group
        where those columns are constant both orders agree, so the slimmer key
        can be reduced first and widened again with ``widen``."""
        order = tuple(o for o in self.order if o.column not in constant)
        return ArgMin(order, self.payload, tuple((c, t) for c, t in self.dtypes if c not in constant))

    def widen(self, slim: "ArgMin", struct_col: str) -> Column:
        """The full key from a reduced ``slim`` key (``self.without(...)``) plus
        the current values of the left-out columns, which must be constant in
        the rows that were reduced."""
        types = dict(self.dtypes)
        slim_index = {o.column: j for j, o in enumerate(slim.order)}
        fields: list[Column] = []
        for i, o in enumerate(self.order):
            if o.column in slim_index:
                j = slim_index[o.column]
                fields.append(F.col(f"{struct_col}.n{j}").alias(f"n{i}"))
                fields.append(F.col(f"{struct_col}.v{j}").alias(f"v{i}"))
            else:
                c = F.col(o.column)
                fields.append(c.isNull().alias(f"n{i}"))
                v = c if o.ascending else _descending_value(c, types[o.column])
                fields.append(v.alias(f"v{i}"))
        fields += [F.col(f"{struct_col}.p{j}").alias(f"p{j}") for j, _ in enumerate(self.payload)]
        return F.struct(*fields)

    def restore(self, struct_col: str, skip: Sequence[str] = ()) -> list[Column]:
        """The original columns (names and types) from a reduced struct."""
        types = dict(self.dtypes)
        out: list[Column] = []
        for i, o in enumerate(self.order):
            if o.column in skip:
                continue
            v = F.col(f"{struct_col}.v{i}")
            if not o.ascending:
                v = _descending_value(v, types[o.column]).cast(types[o.column])
            out.append(v.alias(o.column))
        out += [F.col(f"{struct_col}.p{j}").alias(p) for j, p in enumerate(self.payload) if p not in skip]
        return out


def first_per_group(
    df: DataFrame,
    group_by: Sequence[str],
    order: Sequence[Order],
    payload: Sequence[str] = (),
    count_as: str | None = None,
) -> DataFrame:
    """One row per ``group_by`` key: the row that sorts first under ``order``.

    ``order`` columns and ``payload`` columns are returned with their original
    values.  ``count_as`` additionally returns the number of rows in the group.
    """
    dtypes = {f.name: f.dataType for f in df.schema.fields}
    am = ArgMin.of(dtypes, order, [p for p in payload if p not in group_by])
    aggs = [F.min(am.key()).alias("_first")]
    if count_as:
        aggs.append(F.count(F.lit(1)).alias(count_as))
    out = df.groupBy(*group_by).agg(*aggs)
    cols = [F.col(g) for g in group_by] + am.restore("_first", skip=group_by)
    if count_as:
        cols.append(F.col(count_as))
    return out.select(*cols)
