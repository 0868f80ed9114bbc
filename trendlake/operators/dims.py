"""A country dimension next to the result tables.

The dimension is passed in as a DataFrame (it is a small reference list).
Joins are plain: Spark broadcasts the dimension if its bytes allow it.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendlake.functions.text import contains_ci, highlight_parts
from trendlake.schema import COUNTRY

SEARCH_RESULTS = 8


def enrich_country(df: DataFrame, dim: DataFrame, dim_key: str = "name", df_key: str = COUNTRY) -> DataFrame:
    """Attach dimension columns by name, ISO code or numeric code (left join)."""
    cond = F.col(f"_l.{df_key}") == F.col(f"_d.{dim_key}")
    extra = [F.col(f"_d.{c}") for c in dim.columns if c != dim_key and c not in df.columns]
    return df.alias("_l").join(dim.alias("_d"), cond, "left").select("_l.*", *extra)


def country_coverage(
    dim: DataFrame, lists: Mapping[str, DataFrame], dim_key: str = "name", list_key: str = COUNTRY
) -> DataFrame:
    """For every dimension row, whether each named list has rows for it,
    and whether any has."""
    out = dim
    flags = []
    for name, lst in lists.items():
        flag = f"has_{name}"
        present = lst.select(F.col(list_key).alias("_k")).distinct().withColumn(flag, F.lit(True))
        out = out.join(present, out[dim_key] == present["_k"], "left").drop("_k")
        out = out.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))
        flags.append(F.col(flag))
    any_flag = flags[0] if len(flags) == 1 else F.greatest(*flags)
    return out.withColumn("has_data", any_flag if flags else F.lit(False))


def countries_without_data(
    dim: DataFrame, data: DataFrame, dim_key: str = "name", data_key: str = COUNTRY
) -> DataFrame:
    """Dimension rows with no row in ``data`` (left anti join)."""
    keys = data.select(F.col(data_key).alias("_k")).distinct()
    return dim.join(keys, dim[dim_key] == keys["_k"], "left_anti")


def search_names(
    dim: DataFrame, query: str, n: int = SEARCH_RESULTS, name: str = "name", order_by: str | None = None
) -> DataFrame:
    """F18 + F19 + L7: up to ``n`` names containing ``query`` (any case) in list
    order, with the first match split out for highlighting.  A blank query
    finds nothing."""
    order = order_by or name
    hits = dim.filter(contains_ci(name, query)).orderBy(F.col(order).asc_nulls_last(), F.col(name))
    return hits.limit(n).withColumn("match", highlight_parts(name, query))
