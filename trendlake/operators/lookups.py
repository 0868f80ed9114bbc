"""R6, R7, R16 country lookups and L4 / C4 table browsing.

Lookups filter on the country first.  Over a table published with
``partitionBy(country)`` the filter becomes a PartitionFilter (one folder is
read); over a freshly computed ranking Catalyst pushes it below the rank
window and the aggregates down to the scan.  ``limit`` appears only where the
list length is the feature (top 10, page size).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendlake.functions.dates import month_start_text
from trendlake.schema import APPEARANCES, CATEGORY, COUNTRY, MONTH, RESULT_TABLES, YEAR
from trendlake.sources.ordered import OrderedTable
from trendlake.sources.sinks import LIST_SEPARATOR

LIST_LENGTH = 10
PAGE_SIZE = 100
MAX_PAGE_SIZE = 10_000


def require_country(country: str | None) -> str:
    """A country name is required."""
    if country is None or not str(country).strip():
        raise ValueError("a country name is needed")
    return str(country)


def country_top(table: DataFrame, country: str, n: int = LIST_LENGTH) -> DataFrame:
    """A country's rows of a top-k table, most appearances first
    (rank breaks ties), at most ``n`` rows."""
    c = require_country(country)
    order = [F.col(APPEARANCES).desc_nulls_last()]
    if "rank" in table.columns:
        order.append(F.col("rank").asc_nulls_last())
    return table.filter(F.col(COUNTRY) == F.lit(c)).orderBy(*order).limit(n)


country_top_channels = country_top
country_top_categories = country_top
country_top_videos = country_top


def _tags_text(df: DataFrame, col: str) -> F.Column:
    if isinstance(df.schema[col].dataType, T.ArrayType):
        return F.nullif(F.concat_ws(LIST_SEPARATOR, F.col(col)), F.lit(""))
    return F.col(col)


def country_category_trends(trends: DataFrame, country: str) -> DataFrame:
    """One country's category months as (date, category, appearances, tags
    text), ordered by year, month and category."""
    c = require_country(country)
    return (
        trends.filter(F.col(COUNTRY) == F.lit(c))
        .orderBy(YEAR, MONTH, CATEGORY)
        .select(
            month_start_text(YEAR, MONTH).alias("date"),
            F.col(CATEGORY).alias("category"),
            F.col(APPEARANCES),
            _tags_text(trends, "top5_tags").alias("top5_tags"),
        )
    )


def country_video_trends(trends: DataFrame, country: str) -> DataFrame:
    """One country's top video per month, ordered by year and month."""
    c = require_country(country)
    return (
        trends.filter(F.col(COUNTRY) == F.lit(c))
        .orderBy(YEAR, MONTH)
        .select(
            month_start_text(YEAR, MONTH).alias("date"),
            "video_title",
            F.col(CATEGORY).alias("category"),
            "channel_title",
            "video_view_count",
            "video_like_count",
            "video_comment_count",
            "video_duration",
            APPEARANCES,
        )
    )


def country_report(tables: Mapping[str, DataFrame], country: str) -> dict[str, DataFrame]:
    """The five lookups of one country, as independent DataFrames."""
    c = require_country(country)
    return {
        "top_channels": country_top(tables["top10_channels_per_country"], c),
        "top_categories": country_top(tables["top10_categories_per_country"], c),
        "top_videos": country_top(tables["top10_videos_per_country"], c),
        "category_trends": country_category_trends(tables["category_trends_over_time"], c),
        "video_trends": country_video_trends(tables["video_trends_over_time"], c),
    }


def _page_bounds(limit: int | str | None, offset: int | str | None, max_page: int) -> tuple[int, int]:
    n = int(PAGE_SIZE if limit is None else limit)
    if n > max_page:
        raise ValueError(f"a page has at most {max_page} rows")
    skip = int(0 if offset is None else offset)
    if n < 0 or skip < 0:
        raise ValueError("limit and offset must not be negative")
    return n, skip


def browse(
    table: DataFrame | OrderedTable,
    filters: Mapping[str, object] | None = None,
    limit: int | str | None = PAGE_SIZE,
    offset: int | str | None = 0,
    order_by: Sequence[str] | None = None,
    table_name: str | None = None,
    max_page: int = MAX_PAGE_SIZE,
) -> DataFrame:
    """C4 = P11 + L4: equality filters on named columns, then a page.

    Unknown filter columns are rejected (they are never spliced into SQL).
    Pages follow a stable order: ``order_by``, else the table's primary key,
    else all columns.  A page of more than ``max_page`` rows is refused.

    A table published in order (``sources.ordered``, ``Release.table``) is paged in its own
    order through its index: however large the offset, only the files that the page overlaps
    are read.  Any other DataFrame is sorted down to ``limit + offset`` rows.
    """
    filters = dict(filters or {})
    unknown = [k for k in filters if k not in table.columns]
    if unknown:
        raise KeyError(f"unknown column(s): {', '.join(sorted(unknown))}")
    n, skip = _page_bounds(limit, offset, max_page)
    if isinstance(table, OrderedTable):
        if order_by:
            raise ValueError("a table published in order is paged in that order")
        return table.page(n, skip, filters).select(*table.columns)
    cond = F.lit(True)
    for col, value in filters.items():
        cond = cond & (F.col(col) == F.lit(value).cast(table.schema[col].dataType))
    spec = RESULT_TABLES.get(table_name or "")
    keys = list(order_by or (spec.primary_key if spec else table.columns))
    out = table.filter(cond).orderBy(*[F.col(k).asc_nulls_last() for k in keys])
    if skip:
        out = out.offset(skip)
    return out.limit(n)
