"""The sighting summary: one row per (country, category, channel, video,
year, month, tag text) with everything R1-R5 need.

Every analysis reduces sightings with associative functions -- counts add,
maxima and arg-minima combine -- so it gives the same rows from the summary
as from the snapshots themselves.  The summary is written once (one scan, one
shuffle of the snapshot table); the five analyses then read a table that is
smaller by the number of daily sightings per video-month, instead of each
scanning and shuffling the full snapshot table.

``as_sightings`` is the common input shape of the analyses.  A summary
passes through unchanged; raw cleaned snapshots become weight-1 summary rows
through a projection only (no shuffle), so calling an analysis directly on
snapshots costs nothing extra.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendlake.functions.metrics import engagement_rating
from trendlake.operators.clean import with_trending_month
from trendlake.plans.ordering import ArgMin, asc, desc
from trendlake.schema import (
    CATEGORY,
    CHANNEL,
    COMMENTS,
    COUNTRY,
    LIKES,
    MONTH,
    TRENDING_DATE,
    VIDEO,
    VIEWS,
    YEAR,
)

SIGHTINGS = "sightings"
# The video id leads: the sort of the (sort-based) aggregate compares an
# 8-byte prefix of the first key, and the video id almost always decides it.
SUMMARY_KEYS = [VIDEO, CHANNEL, COUNTRY, CATEGORY, YEAR, MONTH, "video_tags"]

_TYPES = {
    VIEWS: T.LongType(),
    LIKES: T.LongType(),
    COMMENTS: T.LongType(),
    TRENDING_DATE: T.StringType(),
    CATEGORY: T.StringType(),
    CHANNEL: T.StringType(),
    "video_title": T.StringType(),
    "video_duration": T.StringType(),
    "engagement_rating": T.DoubleType(),
}

# Peak sighting of a video in a country (W4): most views, then earliest
# trending date, then every carried column ascending (NULLs last).
PEAK_VIDEO = ArgMin.of(
    _TYPES,
    [desc(VIEWS), asc(TRENDING_DATE), asc(CATEGORY), asc("video_title"), asc("engagement_rating"),
     asc(CHANNEL), asc("video_duration")],
)
# Peak sighting of a video in a month (W5): most views, then every carried
# column ascending (NULLs last).
PEAK_MONTH = ArgMin.of(
    _TYPES,
    [desc(VIEWS), asc("video_title"), asc(CATEGORY), asc(CHANNEL), asc(LIKES), asc(COMMENTS),
     asc("video_duration")],
)


# Inside a summary row, category and channel are grouping keys, so the
# stored peak keys leave them out; readers widen them back (``peak_video_key``).
_CONSTANT = (CATEGORY, CHANNEL)
PEAK_VIDEO_SLIM = PEAK_VIDEO.without(_CONSTANT)
PEAK_MONTH_SLIM = PEAK_MONTH.without(_CONSTANT)


def peak_video_key() -> Column:
    """The full W4 key of each summary row, ready for ``min``."""
    return PEAK_VIDEO.widen(PEAK_VIDEO_SLIM, "peak_video")


def peak_month_key() -> Column:
    """The full W5 key of each summary row, ready for ``min``."""
    return PEAK_MONTH.widen(PEAK_MONTH_SLIM, "peak_month")


# All analyses count by these and others first.
DEALT_BY = [VIDEO, COUNTRY]
# The columns of a snapshot that a summary row is made of, besides its keys.
_CARRIED = [
    VIEWS, LIKES, COMMENTS, TRENDING_DATE, "video_title", "video_duration", "channel_subscriber_count",
    "channel_view_count", "channel_custom_url",
]


def is_summary(df: DataFrame) -> bool:
    return SIGHTINGS in df.columns


def _typed(snap: DataFrame) -> DataFrame:
    return snap.withColumns(
        {
            VIEWS: F.col(VIEWS).cast("long"),
            LIKES: F.col(LIKES).cast("long"),
            COMMENTS: F.col(COMMENTS).cast("long"),
            "engagement_rating": engagement_rating(VIEWS, LIKES, COMMENTS),
        }
    )


def _measures() -> dict[str, Column]:
    """What a snapshot brings into each column of its summary row."""
    return {
        SIGHTINGS: F.lit(1).cast("long"),
        "max_views": F.col(VIEWS),
        "max_likes": F.col(LIKES),
        "max_subscribers": F.col("channel_subscriber_count").cast("long"),
        "max_channel_views": F.col("channel_view_count").cast("long"),
        "min_custom_url": F.col("channel_custom_url"),
        "peak_video": PEAK_VIDEO_SLIM.key(),
        "peak_month": PEAK_MONTH_SLIM.key(),
    }


def as_sightings(snap: DataFrame) -> DataFrame:
    """Summary-shaped rows: a summary as is, cleaned snapshots as weight-1 rows."""
    if is_summary(snap):
        return snap
    return _typed(with_trending_month(snap)).select(*SUMMARY_KEYS, *[c.alias(name) for name, c in _measures().items()])


def sighting_summary(snap: DataFrame, partitions: int | None = None) -> DataFrame:
    """Aggregate cleaned snapshots into the summary (one shuffle).

    The snapshots' own columns, each once, are dealt out by video and country; behind that
    shuffle they are sorted and reduced, and the peak keys are made.  A video has a row a day in
    a country, so combining in the map tasks would find next to nothing to combine; it would sort
    all rows of a file split (which spills, and takes the more memory the better a file is
    compressed) and send two peak keys for each.

    Groups with NULL keys are kept as groups; each analysis drops the NULL
    keys its own semantics drop.  Write the result once (``write_snapshots``, or
    ``write_by_key`` by ``DEALT_BY`` if it was dealt out to that many ``partitions``)
    and pass the written table to the analyses.
    """
    if is_summary(snap):
        rows, of = snap, {name: F.col(name) for name in _measures()}
    else:
        own = [c for c in SUMMARY_KEYS if c not in (YEAR, MONTH)]  # those two come from the date, behind the shuffle
        rows = snap.select(*own, *_CARRIED).repartition(*([partitions] if partitions else []), *DEALT_BY)
        rows, of = _typed(with_trending_month(rows)), _measures()
    reduce = lambda name: F.sum if name == SIGHTINGS else F.max if name.startswith("max_") else F.min
    return rows.groupBy(*SUMMARY_KEYS).agg(*[reduce(name)(c).alias(name) for name, c in of.items()])


def rows_of(summary: DataFrame, listed: DataFrame, keys: list[str]) -> DataFrame:
    """The summary rows whose ``keys`` are in ``listed`` (NULL equals NULL), with its other columns.

    ``listed`` has each key once and is small: some rows a country, or a country's month."""
    names = {c: f"_listed_{c}" for c in keys}
    same = F.lit(True)
    for c, name in names.items():
        same = same & F.col(c).eqNullSafe(F.col(name))
    return summary.join(F.broadcast(listed.withColumnsRenamed(names)), same).drop(*names.values())


def with_peak_columns(summary: DataFrame) -> DataFrame:
    """A summary with its two peak rows as plain columns (``peak_video_*``, ``peak_month_*``)."""
    plain = [c for c in summary.columns if c not in ("peak_video", "peak_month")]
    peaks = [
        F.col(f"_{p}.{c}").alias(f"{p}_{c}")
        for p, key in (("peak_video", PEAK_VIDEO_SLIM), ("peak_month", PEAK_MONTH_SLIM))
        for c in (o.column for o in key.order)
    ]
    restored = summary.withColumns({
        "_peak_video": F.struct(*PEAK_VIDEO_SLIM.restore("peak_video")),
        "_peak_month": F.struct(*PEAK_MONTH_SLIM.restore("peak_month")),
    })
    return restored.select(*plain, *peaks)
