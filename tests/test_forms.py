"""The rankings against plain Python on hand-made and random rows (tests/forms.py)."""

import pytest

from trendlake.fixtures import daily_raw
from trendlake.operators import clean_snapshots, sighting_summary, top_categories, top_channels, top_videos, video_trends, with_trending_month

from tests import forms
from tests.conftest import SF_SMALL, raw_rows


def rows_of(df):
    return sorted((tuple(round(v, 4) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)


def check(snap, k):
    seen = [r.asDict() for r in with_trending_month(snap).collect()]
    wanted = {top_categories: forms.categories(seen, k), top_channels: forms.channels(seen, k), top_videos: forms.videos(seen, k)}
    for source in (snap, sighting_summary(snap)):
        for op, rows in wanted.items():
            assert rows_of(op(source, k)) == sorted(rows, key=str), op.__name__
        assert rows_of(video_trends(source)) == sorted(forms.month_videos(seen), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_random_rows_with_nulls(spark, seed):
    check(clean_snapshots(raw_rows(spark, forms.random_rows(seed))), 3)


def test_daily_view(spark):
    snap = clean_snapshots(daily_raw(spark, SF_SMALL))
    assert 2 * sighting_summary(snap).count() <= snap.count()
    check(snap, 10)
