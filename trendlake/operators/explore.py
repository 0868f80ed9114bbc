"""The trend explorer's data shaping, as DataFrame operators.

Inputs are the published trend tables (R4 / R5 shape, with country, year and
month) or a country's lookup rows (R7 shape, with a ``date`` text).  Every
group these operators form is small by construction -- a country's
categories, a series' months, a top-k list -- so the windows below never
gather a data-sized group in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendlake.functions.dates import date_part_text
from trendlake.functions.tags import parse_tags
from trendlake.functions.values import first_present, number_or_zero, to_number
from trendlake.plans.ordering import asc, desc, first_per_group, top_k_per_group
from trendlake.schema import APPEARANCES, CATEGORY, COUNTRY, MONTH, YEAR

LEADING = 5
PINNED_TAGS = 5
# Y-axis head room of the trend charts and the smallest axis top.
Y_HEADROOM = 1.1
Y_MIN_TOP = 1.0


def _has_text(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def _point_date(df: DataFrame) -> Column:
    """The chart date of a row: ``date`` text (date part) or year + month."""
    if "date" in df.columns:
        return F.try_to_date(date_part_text("date"), "yyyy-MM-dd")
    return F.when(F.col(MONTH).between(1, 12), F.make_date(F.col(YEAR), F.col(MONTH), F.lit(1)))


def leading_categories(
    trends: DataFrame,
    n: int = LEADING,
    category: str = CATEGORY,
    by: Sequence[str] = (COUNTRY,),
) -> DataFrame:
    """R8 (A10 + L5): per country, the ``n`` categories with the most
    appearances summed over all months.  Ties go to the category that shows up
    first in month order, then by name.  NULL / empty categories are skipped."""
    month_index = (F.col(YEAR) * 12 + F.col(MONTH)) if YEAR in trends.columns else F.datediff(
        _point_date(trends), F.lit("1970-01-01")
    )
    totals = (
        trends.filter(_has_text(F.col(category)))
        .groupBy(*by, category)
        .agg(
            F.sum(F.coalesce(F.col(APPEARANCES).cast("long"), F.lit(0))).alias("total_appearances"),
            F.min(month_index).alias("_first"),
        )
    )
    ranked = top_k_per_group(
        totals, list(by), [desc("total_appearances"), asc("_first"), asc(category)], n
    )
    return ranked.select(*by, category, "total_appearances", "rank")


def leading_category_trends(
    trends: DataFrame, leading: DataFrame, category: str = CATEGORY, by: Sequence[str] = (COUNTRY,)
) -> DataFrame:
    """R8 (P14 / J4): the trend rows whose category is among the leading ones."""
    keys = [*by, category]
    return trends.join(leading.select(*keys), on=keys, how="left_semi")


def video_categories(video_trends: DataFrame, category: str = CATEGORY, by: Sequence[str] = (COUNTRY,)) -> DataFrame:
    """Distinct non-empty categories per country (sorted on output)."""
    return (
        video_trends.filter(_has_text(F.col(category)))
        .select(*by, category)
        .distinct()
        .orderBy(*by, category)
    )


def series_domain(rows: DataFrame, value: str = APPEARANCES, by: Sequence[str] = (COUNTRY,)) -> DataFrame:
    """Per country: first and last chart date, largest value (0 counts as
    1) and the y-axis top ``max(1.1 * largest, 1)``."""
    v = F.coalesce(to_number(value), F.lit(0.0))
    agg = rows.groupBy(*by).agg(
        F.min(_point_date(rows)).alias("min_date"),
        F.max(_point_date(rows)).alias("max_date"),
        F.max(v).alias("_max"),
    )
    top = F.when(F.col("_max") == 0, F.lit(1.0)).otherwise(F.col("_max"))
    return agg.select(
        *by,
        "min_date",
        "max_date",
        top.alias("max_value"),
        F.greatest(top * F.lit(Y_HEADROOM), F.lit(Y_MIN_TOP)).alias("y_max"),
    )


def trend_series(
    rows: DataFrame,
    series: str = CATEGORY,
    value: str = APPEARANCES,
    by: Sequence[str] = (COUNTRY,),
    tags: str | None = None,
) -> DataFrame:
    """A13 / P16, one row per chart point: (country, series, point_index,
    date, value); points without a date are dropped, the rest numbered in
    date order within their series.  ``tags`` names the column of the month's
    tags, which each point then carries as an array (F9)."""
    pts = (
        rows.withColumn("_date", _point_date(rows))
        .filter(F.col("_date").isNotNull())
        .withColumn("_series", F.coalesce(F.col(series).cast("string"), F.lit("")))
        .withColumn("_value", number_or_zero(value))
    )
    order = [F.col("_date").asc(), F.col("_value").asc()]
    carried = []
    if tags is not None:
        pts = pts.withColumn("_tags", parse_tags(tags, rows.schema[tags].dataType))
        order.append(F.col("_tags").asc())
        carried = [F.col("_tags").alias("tags")]
    w = Window.partitionBy(*by, "_series").orderBy(*order)
    return pts.withColumn("point_index", F.row_number().over(w)).select(
        *by,
        F.col("_series").alias(series),
        "point_index",
        F.col("_date").alias("date"),
        F.col("_value").alias("value"),
        *carried,
    )


def trend_series_arrays(
    rows: DataFrame,
    series: str = CATEGORY,
    value: str = APPEARANCES,
    by: Sequence[str] = (COUNTRY,),
    tags: str | None = None,
) -> DataFrame:
    """A13 as arrays: one row per series with its date-sorted points (date, value and, with
    ``tags``, the month's tags).  A series holds one point per month, so each array is bounded
    by the calendar."""
    pts = trend_series(rows, series, value, by, tags)
    fields = ["date", "value"] + (["tags"] if tags is not None else [])
    return pts.groupBy(*by, series).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("point_index", *fields))),
            lambda p: F.struct(*[p[f].alias(f) for f in fields]),
        ).alias("points")
    )


def pinned_points(
    rows: DataFrame, keys: Sequence[str] | DataFrame, kind: str = "category", position: Sequence[str] = ()
) -> DataFrame:
    """R10 (J6): pinned cards for ``name|date`` keys, in the order given.

    ``rows`` are one country's trend rows (R7 shape).  The name is the
    category (``kind='category'``) or the video title (``kind='video'``);
    the date is the date part of ``date``.  Keys without a row are dropped.
    Keys come as a list or as a DataFrame (``pos``, ``key``); the join is a plain
    one, so Spark broadcasts them by their bytes or not at all.

    Of rows with one key, the last in input order counts.  A DataFrame has no order of
    its own, so ``position`` names the columns that give it (``position`` of an ordered
    table, or ``file`` and ``offset`` of CSV rows).  Without them, the least row counts.
    """
    if kind not in ("category", "video"):
        raise ValueError("kind must be 'category' or 'video'")
    if isinstance(keys, DataFrame):
        key_df = keys.select("pos", "key")
    else:
        spark = rows.sparkSession
        key_df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "pos int, key string")
    if kind == "category":
        name = F.coalesce(F.col("category").cast("string"), F.lit("null"))
    else:
        name = F.coalesce(F.col("video_title").cast("string"), F.lit(""))
    keyed = rows.withColumn("key", F.concat(name, F.lit("|"), date_part_text("date")))
    others = [c for c in keyed.columns if c != "key" and c not in position]
    if position:
        last = F.max(F.struct(*position, *others)).alias("_last")  # an aggregate, so combined map-side
        one = keyed.groupBy("key").agg(last).select("key", *[F.col(f"_last.{c}").alias(c) for c in others])
    else:
        one = first_per_group(keyed, ["key"], [asc(c) for c in others])
    hit = one.join(key_df, on="key", how="inner")
    if kind == "category":
        tags_type = rows.schema["top5_tags"].dataType if "top5_tags" in rows.columns else T.StringType()
        tags = F.slice(parse_tags("top5_tags", tags_type), 1, PINNED_TAGS) if "top5_tags" in rows.columns else F.array()
        cols = [
            "pos", "key", F.coalesce(F.col("category"), F.lit("")).alias("category"), "date",
            number_or_zero(APPEARANCES).cast("long").alias(APPEARANCES),
            tags.alias("top5_tags"),
        ]
    else:
        cols = [
            "pos", "key", "video_title", "category", "channel_title", "date",
            *[number_or_zero(c).cast("long").alias(c) for c in ("video_view_count", "video_like_count", "video_comment_count")],
            "video_duration",
            number_or_zero(APPEARANCES).cast("long").alias(APPEARANCES),
        ]
    return hit.select(*cols).orderBy("pos")


# Numeric fields per result kind, and alternate field names the
# client accepts for videos (canonical name first).
NUMERIC_FIELDS = {
    "channels": ("rank", "channel_subscribers", "total_views", "total_videos", APPEARANCES),
    "categories": ("rank", "total_views", "avg_views", "total_likes", APPEARANCES),
    "videos": (APPEARANCES,),
    "category_trends": (APPEARANCES,),
    "video_trends": (APPEARANCES, "video_view_count", "video_like_count", "video_comment_count"),
}
VIDEO_ALTERNATES = {
    "video_title": ("video_title", "title"),
    "video_view_count": ("video_view_count", "view_count", "views", "total_views"),
    "engagement_rating": ("engagement_rating", "engagement_score", "engagement"),
}


def normalize_results(df: DataFrame, kind: str) -> DataFrame:
    """R11 (F15, F16): numeric fields of a result row as doubles, and for videos
    the first present of the alternate field names.  Text that is not a finite
    number becomes NULL there and is kept in ``<field>_text`` (NULL otherwise),
    which text fields get beside them.  Other columns pass through."""
    if kind not in NUMERIC_FIELDS:
        raise ValueError(f"unknown kind {kind!r}")
    out = df
    if kind == "videos":
        out = out.withColumns(
            {name: first_present(out, alts) for name, alts in VIDEO_ALTERNATES.items() if any(a in out.columns for a in alts)}
        )
    numeric = [c for c in NUMERIC_FIELDS[kind] if c in out.columns]
    texts = [c for c in numeric if isinstance(out.schema[c].dataType, T.StringType)]
    kept = {f"{c}_text": F.when(to_number(c).isNull() & _has_text(F.col(c)), F.col(c)) for c in texts}
    return out.withColumns({**kept, **{c: to_number(c) for c in numeric}})


def category_share(top_categories: DataFrame, by: Sequence[str] = (COUNTRY,)) -> DataFrame:
    """R12 (A14, W8): each category's total views as a percentage of the
    largest total in its country's list (the bar length).

    The input is a top-k list, so a country's window holds at most k rows and the
    list is computed once.
    """
    v = F.coalesce(F.col("total_views").cast("double"), F.lit(0.0))
    largest = F.max(v).over(Window.partitionBy(*by))
    return top_categories.withColumn("share_pct", F.try_divide(v, largest) * 100)
