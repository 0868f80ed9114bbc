"""Declared schemas of the snapshot tables, the five result tables and the
table constraints the result store declares (used by ``operators.quality``)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

COUNTRY = "video_trending_country"
CATEGORY = "video_category_id"
VIDEO = "video_id"
CHANNEL = "channel_title"
VIEWS = "video_view_count"
LIKES = "video_like_count"
COMMENTS = "video_comment_count"
TRENDING_DATE = "video_trending_date"
YEAR = "trending_year"
MONTH = "trending_month"
APPEARANCES = "trending_appearances"

# The 18 raw snapshot columns kept by cleaning, in source order
# (the raw trending-date column has a double underscore).
RAW_COLUMNS = [
    "video_id",
    "video_published_at",
    "video_trending__date",
    "video_trending_country",
    "video_title",
    "video_category_id",
    "video_tags",
    "video_duration",
    "video_view_count",
    "video_like_count",
    "video_comment_count",
    "channel_id",
    "channel_subscriber_count",
    "channel_country",
    "channel_title",
    "channel_custom_url",
    "channel_view_count",
    "channel_video_count",
]
RAW_DATE_COLUMN = "video_trending__date"

COUNT_COLUMNS = [
    "video_view_count",
    "video_like_count",
    "video_comment_count",
    "channel_subscriber_count",
    "channel_view_count",
    "channel_video_count",
]

RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in RAW_COLUMNS])

CLEAN_SCHEMA = T.StructType(
    [
        T.StructField(
            TRENDING_DATE if c == RAW_DATE_COLUMN else c,
            T.LongType() if c in COUNT_COLUMNS else T.StringType(),
            True,
        )
        for c in RAW_COLUMNS
    ]
)


@dataclass(frozen=True)
class TableSpec:
    """Columns and declared constraints of one published result table."""

    name: str
    schema: T.StructType
    primary_key: tuple[str, ...]
    not_null: tuple[str, ...] = ()
    varchar255: tuple[str, ...] = ()
    month_columns: tuple[str, ...] = ()
    decimal_10_4: tuple[str, ...] = ()
    sort_by: tuple[str, ...] = field(default=())

    @property
    def columns(self) -> list[str]:
        return [f.name for f in self.schema.fields]


def _s(*cols: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in cols])


_str, _long, _int, _dbl = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()

TOP_CHANNELS = TableSpec(
    "top10_channels_per_country",
    _s(
        (COUNTRY, _str), (CHANNEL, _str), ("channel_custom_url", _str), (CATEGORY, _str),
        (APPEARANCES, _long), ("total_views", _long), ("total_videos", _long),
        ("channel_subscribers", _long), ("channel_view_count", _long), ("rank", _int),
    ),
    primary_key=(COUNTRY, "rank"),
    not_null=(COUNTRY,),
    varchar255=(COUNTRY, CHANNEL, "channel_custom_url", CATEGORY),
    sort_by=(COUNTRY, "rank"),
)

TOP_CATEGORIES = TableSpec(
    "top10_categories_per_country",
    _s(
        (COUNTRY, _str), (CATEGORY, _str), (APPEARANCES, _long), ("total_views", _long),
        ("avg_views", _long), ("total_likes", _long), ("rank", _int),
    ),
    primary_key=(COUNTRY, "rank"),
    not_null=(COUNTRY,),
    varchar255=(COUNTRY, CATEGORY),
    sort_by=(COUNTRY, "rank"),
)

CATEGORY_TRENDS = TableSpec(
    "category_trends_over_time",
    _s(
        (COUNTRY, _str), (CATEGORY, _str), (YEAR, _int), (MONTH, _int),
        (APPEARANCES, _long), ("total_views", _long), ("top5_tags", _str),
    ),
    primary_key=(COUNTRY, CATEGORY, YEAR, MONTH),
    not_null=(COUNTRY, CATEGORY, YEAR, MONTH),
    varchar255=(COUNTRY, CATEGORY),
    month_columns=(MONTH,),
    sort_by=(COUNTRY, YEAR, MONTH, CATEGORY),
)

TOP_VIDEOS = TableSpec(
    "top10_videos_per_country",
    _s(
        (COUNTRY, _str), (CATEGORY, _str), ("video_title", _str), (CHANNEL, _str),
        ("video_duration", _str), (VIEWS, _long), ("engagement_rating", _dbl),
        (APPEARANCES, _long), ("peak_trending_date", _str), ("rank", _int),
    ),
    primary_key=(COUNTRY, "rank"),
    not_null=(COUNTRY,),
    varchar255=(COUNTRY, CATEGORY, CHANNEL, "video_duration", "peak_trending_date"),
    decimal_10_4=("engagement_rating",),
    sort_by=(COUNTRY, "rank"),
)

VIDEO_TRENDS = TableSpec(
    "video_trends_over_time",
    _s(
        (COUNTRY, _str), (YEAR, _int), (MONTH, _int), ("video_title", _str), (CATEGORY, _str),
        (CHANNEL, _str), (VIEWS, _long), (LIKES, _long), (COMMENTS, _long),
        ("video_duration", _str), (APPEARANCES, _long),
    ),
    primary_key=(COUNTRY, YEAR, MONTH),
    not_null=(COUNTRY, YEAR, MONTH),
    varchar255=(COUNTRY, CATEGORY, CHANNEL, "video_duration"),
    month_columns=(MONTH,),
    sort_by=(COUNTRY, YEAR, MONTH),
)

RESULT_TABLES: dict[str, TableSpec] = {
    t.name: t for t in (TOP_CHANNELS, TOP_CATEGORIES, CATEGORY_TRENDS, TOP_VIDEOS, VIDEO_TRENDS)
}
