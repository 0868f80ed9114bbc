"""R4 category trends per month (with top-5 tags) and R5 top video per month.

Rows whose country, category (R4) or trending month is NULL vanish, as the
inner joins of the reference make them do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendlake.functions.tags import clean_tag, long_enough, split_tags
from trendlake.operators.clean import drop_null_keys
from trendlake.functions.dates import parse_trending_date
from trendlake.operators.summary import PEAK_MONTH, SIGHTINGS, as_sightings, is_summary, peak_month_key, rows_of
from trendlake.plans.ordering import asc, desc, first_per_group, top_k_per_group
from trendlake.schema import (
    APPEARANCES,
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

TREND_KEYS = [COUNTRY, CATEGORY, YEAR, MONTH]
DEFAULT_TAGS = 5


def _monthly(snap: DataFrame, keys: list[str]) -> DataFrame:
    """Summary-shaped rows with all ``keys`` present (NULL keys dropped).

    For raw snapshots the month keys are NULL exactly when the trending date
    does not parse, so that is tested once on the date itself; a filter on
    the derived year and month would be pushed below their projection and
    parse the date once more for each of them.
    """
    if is_summary(snap):
        return drop_null_keys(snap, keys)
    dated = snap.filter(parse_trending_date(TRENDING_DATE).isNotNull())
    return drop_null_keys(as_sightings(dated), [k for k in keys if k not in (YEAR, MONTH)])


def tag_counts(snap: DataFrame) -> DataFrame:
    """A8 with F2-F4: sightings per cleaned tag and (country, category, year, month).

    Explode, normalise and clean happen in one narrow stage; the count is
    combined map-side before the shuffle on (keys, tag).
    """
    # F3 lower-cases each trimmed tag; lower-casing the whole text once before
    # the split gives the same tags (the comma and the spaces trim removes are
    # unchanged by lower-casing) with one call per row instead of per tag.
    tags = (
        _monthly(snap, TREND_KEYS)
        .filter(F.col("video_tags").isNotNull())
        .select(*TREND_KEYS, SIGHTINGS, F.explode(split_tags(F.lower("video_tags"))).alias("tag"))
        .withColumn("tag", F.trim(F.col("tag")))
        .filter(long_enough(F.col("tag")))
        .withColumn("tag", clean_tag(F.col("tag")))
    )
    # The second length rule applies to the cleaned tag, which is the grouping
    # key, so it is folded into the count: short tags sum to NULL and are
    # dropped after the aggregate.  As a filter before it, Catalyst would push
    # it under the projection and inline the whole cleaning expression,
    # computing it twice per tag; a condition on an aggregate cannot be pushed.
    counts = tags.groupBy(*TREND_KEYS, "tag").agg(
        F.sum(F.when(long_enough(F.col("tag")), F.col(SIGHTINGS))).alias("tag_count")
    )
    return counts.filter(F.col("tag_count").isNotNull())


def top_tags(snap: DataFrame, n: int = DEFAULT_TAGS) -> DataFrame:
    """The ``n`` most used tags per (country, category, year, month); ties by tag."""
    return top_k_per_group(
        tag_counts(snap), TREND_KEYS, [desc("tag_count"), asc("tag")], n, rank_col="tag_rank"
    )


def category_trends(snap: DataFrame, n_tags: int = DEFAULT_TAGS) -> DataFrame:
    """Per (country, category, year, month): sightings, summed per-video peak
    views and the top tags as an array in rank order (NULL when no tag)."""
    per_video = (
        _monthly(snap, TREND_KEYS)
        .groupBy(*TREND_KEYS, VIDEO)
        .agg(F.sum(SIGHTINGS).alias("n"), F.max("max_views").alias("v"))
    )
    months = per_video.groupBy(*TREND_KEYS).agg(
        F.sum("n").alias(APPEARANCES), F.sum("v").alias("total_views")
    )
    tags = (
        top_tags(snap, n_tags)
        .groupBy(*TREND_KEYS)
        .agg(F.array_sort(F.collect_list(F.struct("tag_rank", "tag"))).alias("_t"))
        .select(*TREND_KEYS, F.transform("_t", lambda x: x["tag"]).alias("top5_tags"))
    )
    return months.join(tags, on=TREND_KEYS, how="left").select(
        *TREND_KEYS, APPEARANCES, "total_views", "top5_tags"
    )


# Top video of a (country, year, month): most sightings, most views, video id.
MONTH_TOP_ORDER = [desc(APPEARANCES), desc(VIEWS), asc(VIDEO)]


def video_trends(snap: DataFrame) -> DataFrame:
    """The top video of every (country, year, month) with its peak counters.

    Both steps (peak row per video-month, top video per country-month) are
    arg-min aggregates, so hot videos and hot months combine map-side.  From a (written)
    summary, the top videos are found by their counts and views first, which reduce by hashing;
    then only their rows are reduced to peak rows.
    """
    keys = [COUNTRY, YEAR, MONTH]
    rows = _monthly(snap, keys)
    if is_summary(snap):
        counts = rows.groupBy(VIDEO, *keys).agg(F.sum(SIGHTINGS).alias(APPEARANCES), F.max("max_views").alias(VIEWS))
        rows = rows_of(rows, first_per_group(counts, keys, MONTH_TOP_ORDER).select(*keys, VIDEO), [*keys, VIDEO])
    peak = (
        rows.groupBy(VIDEO, *keys)
        .agg(F.sum(SIGHTINGS).alias(APPEARANCES), F.min(peak_month_key()).alias("_first"))
        .select(VIDEO, *keys, APPEARANCES, *PEAK_MONTH.restore("_first"))
    )
    top = first_per_group(
        peak,
        keys,
        MONTH_TOP_ORDER,
        payload=["video_title", CATEGORY, CHANNEL, LIKES, COMMENTS, "video_duration"],
    )
    return top.select(
        COUNTRY, YEAR, MONTH, "video_title", CATEGORY, CHANNEL, VIEWS, LIKES, COMMENTS,
        "video_duration", APPEARANCES,
    )
