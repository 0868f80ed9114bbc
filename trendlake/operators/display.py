"""Display rows -- formatted counts, durations, links and defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendlake.functions.dates import month_label
from trendlake.functions.text import (
    MISSING_TEXT,
    channel_link,
    format_count,
    format_duration,
    format_engagement,
    with_default,
)
from trendlake.functions.values import first_present
from trendlake.operators.explore import category_share
from trendlake.operators.lookups import LIST_LENGTH
from trendlake.plans.ordering import Order, asc, desc, top_k_per_group
from trendlake.schema import APPEARANCES, COUNTRY

# Display placeholders.
UNTITLED_VIDEO = "Untitled Video"
UNKNOWN_CHANNEL = "Unknown Channel"
TOP_VIDEO = "Top Video"


def _count_text(c: str) -> F.Column:
    return format_count(F.coalesce(F.col(c), F.lit(0)))


def _trending_text() -> F.Column:
    return F.concat(F.coalesce(F.col(APPEARANCES), F.lit(0)).cast("string"), F.lit("x"))


def _text(c: str) -> F.Column:
    """``String(x)`` of the client: NULL prints as ``null``."""
    return F.coalesce(F.col(c).cast("string"), F.lit("null"))


def _list_order(df: DataFrame) -> list[Order]:
    """The order a country list arrives in: most appearances first, then rank."""
    return [desc(APPEARANCES)] + ([asc("rank")] if "rank" in df.columns else [])


def display_rows(df: DataFrame, kind: str, link_host: str | None = None, n: int = LIST_LENGTH) -> DataFrame:
    """Display fields for a country list (``channels``, ``categories``,
    ``videos``) or for video trend points (``video_trends``).

    Lists are capped at ``n`` rows per country (L6) with a per-country top-k,
    which keeps the partial group limit even for a large input.
    """
    if kind in ("channels", "categories", "videos"):
        df = top_k_per_group(df, [COUNTRY], _list_order(df), n, rank_col="_pos")
    if kind == "channels":
        link = channel_link("channel_custom_url") if link_host is None else channel_link("channel_custom_url", link_host)
        subs = F.col("channel_subscribers")
        return df.select(
            COUNTRY, "rank",
            _text("channel_title").alias("title"),
            link.alias("link"),
            F.when(subs > 0, F.concat(format_count(subs), F.lit(" subs"))).alias("subscribers_text"),
            F.col("video_category_id").alias("category"),
            _count_text("total_views").alias("total_views_text"),
            _count_text("total_videos").alias("total_videos_text"),
            _trending_text().alias("trending_text"),
        )
    if kind == "categories":
        return category_share(df).select(
            COUNTRY, "rank",
            F.col("video_category_id").alias("category"),
            F.col("share_pct").alias("bar_pct"),
            _count_text("total_views").alias("total_views_text"),
            _count_text("avg_views").alias("avg_views_text"),
            _count_text("total_likes").alias("likes_text"),
            _trending_text().alias("trending_text"),
        )
    if kind == "videos":
        # The shown rank is the position in the list, not the stored rank.
        title = first_present(df, ("video_title", "title"))
        return df.select(
            COUNTRY,
            F.col("_pos").alias("display_rank"),
            with_default(title, UNTITLED_VIDEO).alias("title"),
            with_default("channel_title", UNKNOWN_CHANNEL).alias("channel"),
            F.col("video_category_id").alias("category"),
            _count_text("video_view_count").alias("views_text"),
            format_engagement("engagement_rating").alias("engagement_text"),
            _trending_text().alias("trending_text"),
        )
    if kind == "video_trends":
        date_col = "date" if "date" in df.columns else None
        month = month_label(date_col) if date_col else F.format_string("%04d-%02d", "trending_year", "trending_month")
        return df.select(
            *[c for c in (COUNTRY,) if c in df.columns],
            month.alias("month"),
            with_default("video_title", TOP_VIDEO).alias("title"),
            with_default("channel_title", MISSING_TEXT).alias("channel"),
            F.coalesce(format_duration("video_duration"), F.lit(MISSING_TEXT)).alias("duration_text"),
            _count_text("video_view_count").alias("views_text"),
            _count_text("video_like_count").alias("likes_text"),
            _count_text("video_comment_count").alias("comments_text"),
            F.coalesce(F.col(APPEARANCES), F.lit(0)).alias(APPEARANCES),
        )
    raise ValueError(f"unknown kind {kind!r}")
