"""Column -> Column helpers.  All are built-in Spark expressions (no UDFs), so
they stay inside whole-stage code generation."""

from trendlake.functions.dates import (
    date_part_text,
    month_label,
    month_start_text,
    parse_trending_date,
)
from trendlake.functions.metrics import engagement_rating
from trendlake.functions.tags import clean_tag, parse_tags, split_tags
from trendlake.functions.text import (
    channel_link,
    contains_ci,
    format_count,
    format_duration,
    format_engagement,
    highlight_parts,
    js_trim,
    with_default,
)
from trendlake.functions.values import first_present, number_or_zero, to_number

__all__ = [
    "engagement_rating",
    "split_tags",
    "clean_tag",
    "parse_tags",
    "parse_trending_date",
    "month_start_text",
    "date_part_text",
    "month_label",
    "format_duration",
    "format_count",
    "format_engagement",
    "channel_link",
    "contains_ci",
    "highlight_parts",
    "with_default",
    "js_trim",
    "to_number",
    "first_present",
    "number_or_zero",
]
