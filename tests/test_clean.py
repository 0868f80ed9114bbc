from trendlake.operators import clean_snapshots, with_trending_month
from trendlake.schema import CLEAN_SCHEMA

from tests.conftest import raw_rows, snap_row


def test_cleaning_drops_required_nulls_and_boolean_categories(spark):
    rows = [
        snap_row(video_id="keep"),
        snap_row(video_id=None),
        snap_row(video_id="np", video_published_at=None),
        snap_row(video_id="nv", video_view_count=None),
        snap_row(video_id="nc", video_category_id=None),
        snap_row(video_id="t1", video_category_id="TRUE"),
        snap_row(video_id="t2", video_category_id="False"),
        snap_row(video_id="ok2", video_category_id="Trueish"),
    ]
    out = clean_snapshots(raw_rows(spark, rows))
    assert sorted(r.video_id for r in out.collect()) == ["keep", "ok2"]


def test_clean_schema_and_rename(spark):
    out = clean_snapshots(raw_rows(spark, [snap_row()]))
    assert [f.name for f in out.schema.fields] == [f.name for f in CLEAN_SCHEMA.fields]
    assert dict(out.dtypes)["video_view_count"] == "bigint"
    assert "video_trending_date" in out.columns and "video_trending__date" not in out.columns


def test_bad_counter_becomes_null_without_error(spark):
    out = clean_snapshots(raw_rows(spark, [snap_row(video_view_count="abc", video_like_count="12.7")]))
    r = out.collect()[0]
    assert r.video_view_count is None  # present as text, so cleaning keeps the row
    assert r.video_like_count is None  # ANSI try_cast: no truncation


def test_trending_month_is_strict(spark):
    rows = [
        snap_row(video_id="a", video_trending__date="2024.10.12"),
        snap_row(video_id="b", video_trending__date="2024-10-12"),
        snap_row(video_id="c", video_trending__date="2024.1.2"),
        snap_row(video_id="d", video_trending__date=None),
    ]
    out = {r.video_id: (r.trending_year, r.trending_month) for r in with_trending_month(clean_snapshots(raw_rows(spark, rows))).collect()}
    assert out == {"a": (2024, 10), "b": (None, None), "c": (None, None), "d": (None, None)}
