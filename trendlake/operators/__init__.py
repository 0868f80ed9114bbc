"""User-level operators.  All are lazy DataFrame ->
DataFrame functions; none triggers an action."""

from trendlake.operators.clean import clean_snapshots, with_trending_month
from trendlake.operators.rankings import (
    peak_snapshots,
    top_categories,
    top_channels,
    top_videos,
)
from trendlake.operators.summary import as_sightings, sighting_summary
from trendlake.operators.trends import (
    category_trends,
    tag_counts,
    top_tags,
    video_trends,
)

__all__ = [
    "clean_snapshots",
    "with_trending_month",
    "top_categories",
    "top_channels",
    "top_videos",
    "peak_snapshots",
    "category_trends",
    "tag_counts",
    "top_tags",
    "video_trends",
    "sighting_summary",
    "as_sightings",
]
