"""The result store's declared constraints as queries.

Parquet tables do not enforce PRIMARY KEY, CHECK or NOT NULL, so each
constraint becomes a condition or a grouped count.  ``check_constraints`` lists
violations; ``constraint_summary`` gives one row per declared check with its
violation count (zero included).  Each reads its table once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendlake.schema import RESULT_TABLES, TableSpec

MAX_VARCHAR = 255



def _spec(table: str | TableSpec) -> TableSpec:
    return table if isinstance(table, TableSpec) else RESULT_TABLES[table]


def _row_checks(spec: TableSpec, columns: list[str]) -> list[tuple[str, str, Column]]:
    checks: list[tuple[str, str, Column]] = []
    for c in dict.fromkeys([*spec.not_null, *spec.primary_key]):
        if c in columns:
            checks.append(("not_null", c, F.col(c).isNull()))
    for c in spec.month_columns:
        if c in columns:
            checks.append(("month_range", c, F.col(c).isNotNull() & ~F.col(c).between(1, 12)))
    for c in spec.varchar255:
        if c in columns:
            checks.append(("varchar_255", c, F.char_length(F.col(c).cast("string")) > MAX_VARCHAR))
    for c in spec.decimal_10_4:
        if c in columns:
            fits = F.col(c).try_cast(T.DecimalType(10, 4)).isNotNull()
            checks.append(("decimal_10_4", c, F.col(c).isNotNull() & ~fits))
    return checks


def _key_text(spec: TableSpec) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("NULL")) for k in spec.primary_key])


def check_constraints(df: DataFrame, table: str | TableSpec) -> DataFrame:
    """Violations: (table, check, column, primary-key text, offending value, rows).

    One scan: every row becomes the list of its failed checks plus one entry
    for its key, and equal entries of a key are counted (combined map-side).
    ``rows`` tells how many rows of that key carry the same violation; for
    the key check, ``value`` is that number too.
    """
    spec = _spec(table)
    entry = "struct<check_name:string,column_name:string,value:string>"
    failed = [
        F.when(bad, F.struct(F.lit(check).alias("check_name"), F.lit(col).alias("column_name"), F.col(col).cast("string").alias("value")))
        for check, col, bad in _row_checks(spec, df.columns)
    ]
    key = F.struct(
        F.lit("primary_key").alias("check_name"), F.lit(",".join(spec.primary_key)).alias("column_name"),
        F.lit(None).cast("string").alias("value"),
    )
    entries = F.filter(F.array(*[c.cast(entry) for c in [*failed, key]]), lambda v: v.isNotNull())
    counted = (
        df.select(*spec.primary_key, F.explode(entries).alias("_v"))
        .groupBy(*spec.primary_key, "_v").agg(F.count(F.lit(1)).alias("rows"))
    )
    is_key = F.col("_v.check_name") == "primary_key"
    return counted.filter(~is_key | (F.col("rows") > 1)).select(
        F.lit(spec.name).alias("table_name"), "_v.check_name", "_v.column_name", _key_text(spec).alias("row_key"),
        F.when(is_key, F.col("rows").cast("string")).otherwise(F.col("_v.value")).alias("value"), "rows",
    )


def constraint_summary(df: DataFrame, table: str | TableSpec) -> DataFrame:
    """One row per declared check: (table, check, column, violations).

    One scan: bad rows are counted per primary key, then over all keys.
    """
    spec = _spec(table)
    checks = _row_checks(spec, df.columns)
    per_key = df.groupBy(*spec.primary_key).agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(bad).alias(f"_c{i}") for i, (_, _, bad) in enumerate(checks)]
    )
    counts = per_key.agg(
        F.count_if(F.col("_n") > 1).alias("_dup"), *[F.sum(f"_c{i}").alias(f"_c{i}") for i in range(len(checks))]
    )
    names = [(check, col, f"_c{i}") for i, (check, col, _) in enumerate(checks)]
    names.append(("primary_key", ",".join(spec.primary_key), "_dup"))
    entries = [
        F.struct(
            F.lit(check).alias("check_name"), F.lit(col).alias("column_name"),
            F.coalesce(F.col(c), F.lit(0)).cast("long").alias("violations"),
        )
        for check, col, c in names
    ]
    rows = counts.select(F.explode(F.array(*entries)).alias("r"))
    return rows.select(F.lit(spec.name).alias("table_name"), "r.*")
