from trendlake.operators import category_trends, clean_snapshots, tag_counts, top_tags, video_trends
from trendlake.sources.sinks import publishable

from tests.conftest import raw_rows, snap_row


def snaps(spark, rows):
    return clean_snapshots(raw_rows(spark, rows))


def tags_of(spark, *tag_texts):
    rows = [snap_row(video_id=f"v{i}", video_tags=t) for i, t in enumerate(tag_texts)]
    return {r.tag: r.tag_count for r in tag_counts(snaps(spark, rows)).collect()}


def test_tag_case_and_spaces_merge(spark):
    assert tags_of(spark, " Foo ,FOO") == {"foo": 2}


def test_short_tags_dropped(spark):
    assert tags_of(spark, "a, ,b") == {}


def test_quoted_and_delimited_tags(spark):
    assert tags_of(spark, '"x;y"', "x|y") == {"x y": 2}


def test_trailing_delimiter_keeps_space(spark):
    assert tags_of(spark, "foo;") == {"foo ": 1}


def test_line_breaks_and_runs_collapse(spark):
    assert tags_of(spark, "a\nb", "c\t\t d", "e\x0bf") == {"a b": 1, "c d": 1, "e f": 1}


def test_tag_tie_is_alphabetical_and_top5(spark):
    rows = [snap_row(video_id="v", video_tags="zz,yy,xx,ww,vv,uu,tt")]
    out = category_trends(snaps(spark, rows)).collect()[0]
    assert out.top5_tags == ["tt", "uu", "vv", "ww", "xx"]
    ranked = [(r.tag, r.tag_rank) for r in top_tags(snaps(spark, rows)).orderBy("tag_rank").collect()]
    assert ranked[0] == ("tt", 1) and len(ranked) == 5


def test_month_without_tags_keeps_row_with_null(spark):
    rows = [snap_row(video_tags=None)]
    out = publishable(category_trends(snaps(spark, rows))).collect()[0]
    assert out.top5_tags is None and out.trending_appearances == 1


def test_bad_date_vanishes_from_trends_but_stays_in_rankings(spark):
    from trendlake.operators import top_categories, top_videos

    rows = [snap_row(video_id="a", video_trending__date="2024-01-01"), snap_row(video_id="b"), snap_row(video_id="c", video_trending__date=None)]
    assert category_trends(snaps(spark, rows)).collect()[0].trending_appearances == 1
    assert video_trends(snaps(spark, rows)).collect()[0].trending_appearances == 1
    assert top_categories(snaps(spark, rows)).collect()[0].trending_appearances == 3
    assert top_videos(snaps(spark, rows)).count() == 3


def test_video_trend_picks_most_sighted_then_most_viewed(spark):
    rows = [
        snap_row(video_id="a", video_title="A", video_view_count="10"),
        snap_row(video_id="a", video_title="A", video_view_count="20", video_trending__date="2024.01.06"),
        snap_row(video_id="b", video_title="B", video_view_count="999"),
        snap_row(video_id="c", video_title="C", video_view_count="5", video_trending__date="2024.02.01"),
    ]
    out = {(r.trending_year, r.trending_month): (r.video_title, r.video_view_count, r.trending_appearances) for r in video_trends(snaps(spark, rows)).collect()}
    assert out == {(2024, 1): ("A", 20, 2), (2024, 2): ("C", 5, 1)}
