from trendlake.operators import clean_snapshots, peak_snapshots, top_categories, top_channels, top_videos

from tests.conftest import raw_rows, snap_row


def snaps(spark, rows):
    return clean_snapshots(raw_rows(spark, rows))


def test_snapshot_growth_counts_every_sighting_but_sums_peaks(spark):
    rows = [snap_row(video_id="v", video_view_count=v) for v in ("10", "50", "30")]
    r = top_categories(snaps(spark, rows)).collect()[0]
    assert (r.trending_appearances, r.total_views, r.avg_views, r.rank) == (3, 50, 50, 1)


def test_avg_views_rounds_half_up(spark):
    rows = [snap_row(video_id="a", video_view_count="1"), snap_row(video_id="b", video_view_count="2")]
    assert top_categories(snaps(spark, rows)).collect()[0].avg_views == 2


def test_all_null_likes_give_null_total(spark):
    rows = [snap_row(video_id="a", video_like_count=None), snap_row(video_id="b", video_like_count="x")]
    assert top_categories(snaps(spark, rows)).collect()[0].total_likes is None


def test_null_country_vanishes_from_categories_and_channels(spark):
    rows = [snap_row(video_trending_country=None), snap_row(video_id="v2")]
    assert top_categories(snaps(spark, rows)).count() == 1
    rows = [snap_row(channel_title=None), snap_row(video_id="v2", channel_title="x")]
    out = top_channels(snaps(spark, rows)).collect()
    assert [r.channel_title for r in out] == ["x"]


def test_ties_break_on_views_then_name_and_rank_is_dense_to_k(spark):
    rows = []
    for i in range(12):
        cat = f"C{i:02d}"
        rows.append(snap_row(video_id=f"v{i}", video_category_id=cat, video_view_count="100" if i != 5 else "999"))
    out = top_categories(snaps(spark, rows)).orderBy("rank").collect()
    assert [r.rank for r in out] == list(range(1, 11))
    assert out[0].video_category_id == "C05"  # equal appearances, more views first
    assert [r.video_category_id for r in out[1:4]] == ["C00", "C01", "C02"]  # full tie -> name


def test_channel_url_is_deterministic_min(spark):
    rows = [snap_row(video_id="a", channel_custom_url=None), snap_row(video_id="b", channel_custom_url="@zz"), snap_row(video_id="c", channel_custom_url="@aa")]
    r = top_channels(snaps(spark, rows)).collect()[0]
    assert (r.channel_custom_url, r.total_videos, r.trending_appearances) == ("@aa", 3, 3)


def test_peak_row_prefers_earliest_date_on_equal_views(spark):
    rows = [
        snap_row(video_trending__date="2024.02.01", video_view_count="50", video_title="late"),
        snap_row(video_trending__date="2024.01.01", video_view_count="50", video_title="early"),
        snap_row(video_trending__date="2024.03.01", video_view_count="10", video_title="low"),
    ]
    r = peak_snapshots(snaps(spark, rows)).collect()[0]
    assert (r.video_title, r.peak_trending_date, r.trending_appearances) == ("early", "2024.01.01", 3)


def test_null_country_videos_stay_with_null_appearances(spark):
    rows = [snap_row(video_id="a", video_trending_country=None), snap_row(video_id="b")]
    out = {r.video_trending_country: r for r in top_videos(snaps(spark, rows)).collect()}
    assert out[None].trending_appearances is None and out[None].rank == 1
    assert out["US"].trending_appearances == 1


def test_engagement_zero_views_and_missing_counts(spark):
    rows = [
        snap_row(video_id="z", video_view_count="0"),
        snap_row(video_id="n", video_view_count="100", video_like_count=None, video_comment_count=None),
        snap_row(video_id="r", video_view_count="3", video_like_count="1", video_comment_count="0"),
    ]
    out = {r.video_title + r.video_category_id: r.engagement_rating for r in top_videos(snaps(spark, [dict(r, video_title=r["video_id"]) for r in rows])).collect()}
    assert out == {"zMusic": 0.0, "nMusic": 0.0, "rMusic": 33.3333}
