from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from trendlake.schema import RAW_COLUMNS  # noqa: E402
from trendlake.session import get_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[4]", "trendlake-tests", **{"spark.sql.shuffle.partitions": "8"})
    yield s
    s.stop()


def raw_rows(spark, rows):
    """Raw snapshot frame from dicts; missing columns are NULL text."""
    data = [tuple(r.get(c) for c in RAW_COLUMNS) for r in rows]
    return spark.createDataFrame(data, ", ".join(f"{c} string" for c in RAW_COLUMNS))


def snap_row(**kw):
    """One raw snapshot with sensible defaults for the required fields."""
    base = {
        "video_id": "v1",
        "video_published_at": "2024.01.01",
        "video_trending__date": "2024.01.05",
        "video_trending_country": "US",
        "video_title": "t",
        "video_category_id": "Music",
        "video_tags": None,
        "video_duration": "PT1M",
        "video_view_count": "100",
        "video_like_count": "10",
        "video_comment_count": "1",
        "channel_id": "c1",
        "channel_subscriber_count": "5",
        "channel_country": "US",
        "channel_title": "ch",
        "channel_custom_url": "@ch",
        "channel_view_count": "50",
        "channel_video_count": "3",
    }
    base.update(kw)
    return base
