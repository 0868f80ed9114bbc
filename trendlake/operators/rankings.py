"""Top channels, categories and videos per country.

The reference builds each ranking from two or three separately shuffled
aggregates glued by inner joins on the group keys.  Here one scan feeds a
two-level aggregate: level 1 per (group keys, video) takes the per-video
maxima and sighting counts, level 2 per group adds them up.  Counting is
additive and max is associative, so the rows are the same; the inner-join
rule that groups with a NULL key vanish is kept by dropping NULL keys before
level 1.  Both levels combine map-side, so a hot group never reaches one task
whole.  The country rank is ``row_number() <= k`` with a total tie-break,
which Catalyst turns into a partial WindowGroupLimit before the shuffle.

Inputs are cleaned snapshots or their sighting summary (operators.summary).  A summary is a
written table, so channels and videos are ranked by their counts and views alone, and only
the rows of the listed ones are read for the rest (``rows_of``): counts and maxima reduce by
hashing, whereas text reduces by a sort of the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendlake.operators.clean import drop_null_keys
from trendlake.operators.summary import PEAK_VIDEO, SIGHTINGS, as_sightings, is_summary, peak_video_key, rows_of
from trendlake.plans.ordering import asc, desc, top_k_per_group
from trendlake.schema import (
    APPEARANCES,
    CATEGORY,
    CHANNEL,
    COUNTRY,
    TRENDING_DATE,
    VIDEO,
    VIEWS,
)

DEFAULT_K = 10
# Lists of up to so many rows a country are sent to all tasks.
MAX_SENT_K = 1_000


def top_categories(snap: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """R2: categories per country by sightings, then by summed per-video peak views."""
    keys = [COUNTRY, CATEGORY]
    per_video = (
        drop_null_keys(as_sightings(snap), keys)
        .groupBy(*keys, VIDEO)
        .agg(
            F.sum(SIGHTINGS).alias("n"),
            F.max("max_views").alias("v"),
            F.max("max_likes").alias("l"),
        )
    )
    groups = per_video.groupBy(*keys).agg(
        F.sum("n").alias(APPEARANCES),
        F.sum("v").alias("total_views"),
        F.round(F.avg("v"), 0).cast("long").alias("avg_views"),
        F.sum("l").alias("total_likes"),
    )
    ranked = top_k_per_group(
        groups, [COUNTRY], [desc(APPEARANCES), desc("total_views"), asc(CATEGORY)], k
    )
    return ranked.select(
        COUNTRY, CATEGORY, APPEARANCES, "total_views", "avg_views", "total_likes", "rank"
    )


def top_channels(snap: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """(channel, category) pairs per country by sightings, then summed peak views."""
    if is_summary(snap) and k <= MAX_SENT_K:
        return _top_channels_of_summary(snap, k)
    # High-cardinality keys first: both levels are sort-based (string min), and
    # the sort compares a prefix of the first key.
    keys = [CHANNEL, COUNTRY, CATEGORY]
    per_video = (
        drop_null_keys(as_sightings(snap), keys)
        .groupBy(VIDEO, *keys)
        .agg(
            F.sum(SIGHTINGS).alias("n"),
            F.max("max_views").alias("v"),
            F.max("max_subscribers").alias("subs"),
            F.max("max_channel_views").alias("cviews"),
            F.min("min_custom_url").alias("url"),
        )
    )
    groups = per_video.groupBy(*keys).agg(
        F.sum("n").alias(APPEARANCES),
        F.sum("v").alias("total_views"),
        F.count(F.lit(1)).alias("total_videos"),
        F.max("subs").alias("channel_subscribers"),
        F.max("cviews").alias("channel_view_count"),
        F.min("url").alias("channel_custom_url"),
    )
    ranked = top_k_per_group(
        groups,
        [COUNTRY],
        [desc(APPEARANCES), desc("total_views"), asc(CHANNEL), asc(CATEGORY)],
        k,
    )
    return ranked.select(
        COUNTRY, CHANNEL, "channel_custom_url", CATEGORY, APPEARANCES, "total_views",
        "total_videos", "channel_subscribers", "channel_view_count", "rank",
    )


def _top_channels_of_summary(summary: DataFrame, k: int) -> DataFrame:
    keys = [CHANNEL, COUNTRY, CATEGORY]
    rows = drop_null_keys(summary, keys)
    per_video = rows.groupBy(VIDEO, *keys).agg(F.sum(SIGHTINGS).alias("n"), F.max("max_views").alias("v"))
    groups = per_video.groupBy(*keys).agg(
        F.sum("n").alias(APPEARANCES), F.sum("v").alias("total_views"), F.count(F.lit(1)).alias("total_videos")
    )
    order = [desc(APPEARANCES), desc("total_views"), asc(CHANNEL), asc(CATEGORY)]
    top = top_k_per_group(groups, [COUNTRY], order, k)
    return rows_of(rows, top, keys).groupBy(*top.columns).agg(
        F.max("max_subscribers").alias("channel_subscribers"),
        F.max("max_channel_views").alias("channel_view_count"),
        F.min("min_custom_url").alias("channel_custom_url"),
    ).select(
        COUNTRY, CHANNEL, "channel_custom_url", CATEGORY, APPEARANCES, "total_views",
        "total_videos", "channel_subscribers", "channel_view_count", "rank",
    )


def peak_snapshots(snap: DataFrame) -> DataFrame:
    """W4 + J2: one row per (video, country) -- the peak-views sighting with its
    engagement -- and the number of sightings.  Sightings with a NULL country
    keep their peak row but get NULL appearances (a left join in the reference).
    """
    peak = (
        as_sightings(snap)
        .groupBy(VIDEO, COUNTRY)
        .agg(F.sum(SIGHTINGS).alias("_n"), F.min(peak_video_key()).alias("_first"))
        .select(VIDEO, COUNTRY, "_n", *PEAK_VIDEO.restore("_first"))
    )
    return peak.select(
        VIDEO, COUNTRY, CATEGORY, "video_title", CHANNEL, "video_duration", VIEWS,
        "engagement_rating",
        F.col(TRENDING_DATE).alias("peak_trending_date"),
        F.when(F.col(COUNTRY).isNotNull(), F.col("_n")).alias(APPEARANCES),
    )


def top_videos(snap: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """Videos per country by sightings, then by peak views, then video id."""
    order = [desc(APPEARANCES), desc(VIEWS), asc(VIDEO)]
    if is_summary(snap) and k <= MAX_SENT_K:
        counts = snap.groupBy(VIDEO, COUNTRY).agg(F.sum(SIGHTINGS).alias("_n"), F.max("max_views").alias(VIEWS))
        counts = counts.withColumn(APPEARANCES, F.when(F.col(COUNTRY).isNotNull(), F.col("_n")))
        snap = rows_of(snap, top_k_per_group(counts, [COUNTRY], order, k).select(VIDEO, COUNTRY), [VIDEO, COUNTRY])
    ranked = top_k_per_group(peak_snapshots(snap), [COUNTRY], order, k)
    return ranked.select(
        COUNTRY, CATEGORY, "video_title", CHANNEL, "video_duration", VIEWS, "engagement_rating",
        APPEARANCES, "peak_trending_date", "rank",
    )
