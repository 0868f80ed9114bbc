
from trendlake.operators.dims import countries_without_data, country_coverage, enrich_country, search_names
from trendlake.operators.display import display_rows
from trendlake.operators.explore import (
    category_share,
    leading_categories,
    leading_category_trends,
    normalize_results,
    pinned_points,
    series_domain,
    trend_series,
    trend_series_arrays,
    video_categories,
)

TREND_COLS = "video_trending_country string, video_category_id string, trending_year int, trending_month int, trending_appearances bigint"


def test_leading_categories_ties_keep_first_appearance(spark):
    rows = [
        ("US", "B", 2024, 2, 5), ("US", "A", 2024, 3, 5),  # tie on 5: B shows up first
        ("US", "C", 2024, 1, 2), ("US", "C", 2024, 4, 2),  # 4, first
        ("US", "", 2024, 1, 99), ("US", None, 2024, 1, 99),  # skipped
        ("US", "D", 2024, 1, None),
    ]
    t = spark.createDataFrame(rows, TREND_COLS)
    out = [(r.video_category_id, r.total_appearances, r.rank) for r in leading_categories(t, n=3).orderBy("rank").collect()]
    assert out == [("B", 5, 1), ("A", 5, 2), ("C", 4, 3)]
    kept = leading_category_trends(t, leading_categories(t, n=1))
    assert [r.video_category_id for r in kept.collect()] == ["B"]


def test_series_domain_and_points(spark):
    t = spark.createDataFrame([("US", "A", 2024, 3, 0), ("US", "A", 2024, 1, 0), ("DE", "B", 2023, 12, 7)], TREND_COLS)
    d = {r.video_trending_country: r for r in series_domain(t).collect()}
    assert (str(d["US"].min_date), str(d["US"].max_date), d["US"].max_value) == ("2024-01-01", "2024-03-01", 1.0)
    assert abs(d["US"].y_max - 1.1) < 1e-12 and abs(d["DE"].y_max - 7.7) < 1e-12
    pts = [(r.point_index, str(r.date)) for r in trend_series(t).filter("video_trending_country = 'US'").orderBy("point_index").collect()]
    assert pts == [(1, "2024-01-01"), (2, "2024-03-01")]
    arr = trend_series_arrays(t).filter("video_trending_country = 'US'").collect()[0].points
    assert [str(p.date) for p in arr] == ["2024-01-01", "2024-03-01"]


def test_video_categories_sorted_distinct(spark):
    vt = spark.createDataFrame([("US", "b"), ("US", "a"), ("US", "a"), ("US", ""), ("US", None)], "video_trending_country string, video_category_id string")
    assert [r.video_category_id for r in video_categories(vt).collect()] == ["a", "b"]


def test_pinned_points_order_and_missing_keys(spark):
    rows = spark.createDataFrame(
        [("2024-01-01", "A", 3, "x|y| |z|w|v|u"), ("2024-02-01T00:00:00", "B", None, None)],
        "date string, category string, trending_appearances bigint, top5_tags string",
    )
    out = pinned_points(rows, ["B|2024-02-01", "nope|2024-01-01", "A|2024-01-01"]).collect()
    assert [(r.key, r.trending_appearances, r.top5_tags) for r in out] == [
        ("B|2024-02-01", 0, []), ("A|2024-01-01", 3, ["x", "y", "z", "w", "v"])
    ]


def test_normalize_results_videos(spark):
    df = spark.createDataFrame([(None, "T", "12", " 3 ", "abc")], "video_title string, title string, views string, trending_appearances string, rank string")
    r = normalize_results(df, "videos").collect()[0]
    assert (r.video_title, r.video_view_count, r.trending_appearances, r.rank) == ("T", "12", 3.0, "abc")


def test_category_share_and_display(spark):
    cats = spark.createDataFrame(
        [("US", "A", 5, 200, 100, None, 1), ("US", "B", 3, 50, 50, 7, 2)],
        "video_trending_country string, video_category_id string, trending_appearances bigint, total_views bigint, avg_views bigint, total_likes bigint, rank int",
    )
    share = {r.video_category_id: r.share_pct for r in category_share(cats).collect()}
    assert share == {"A": 100.0, "B": 25.0}
    d = {r.category: r for r in display_rows(cats, "categories").collect()}
    assert (d["A"].likes_text, d["B"].trending_text, d["A"].bar_pct) == ("0", "3x", 100.0)


def test_display_videos_rank_follows_appearances(spark):
    v = spark.createDataFrame(
        [("US", "M", "", None, "PT1M", 1500, 2.675, 2, "d", 2), ("US", "M", "B", "c", None, 5, None, 9, "d", 1)],
        "video_trending_country string, video_category_id string, video_title string, channel_title string, video_duration string, video_view_count bigint, engagement_rating double, trending_appearances bigint, peak_trending_date string, rank int",
    )
    out = [(r.display_rank, r.title, r.channel, r.views_text, r.engagement_text) for r in display_rows(v, "videos").orderBy("display_rank").collect()]
    assert out == [(1, "B", "c", "5", "—"), (2, "Untitled Video", "Unknown Channel", "1.5K", "2.68%")]


def test_dimension_joins(spark):
    dim = spark.createDataFrame([("Kenya", "KEN", 1), ("Chad", "TCD", 2), ("United Kingdom", "GBR", 3)], "name string, iso string, pos int")
    data = spark.createDataFrame([("Kenya", 1), ("Kenya", 2), ("Atlantis", 3)], "video_trending_country string, x int")
    e = {r.x: r.iso for r in enrich_country(data, dim).collect()}
    assert e == {1: "KEN", 2: "KEN", 3: None}
    cov = {r.name: (r.has_channels, r.has_videos, r.has_data) for r in country_coverage(dim, {"channels": data, "videos": data.limit(0)}).collect()}
    assert cov == {"Kenya": (True, False, True), "Chad": (False, False, False), "United Kingdom": (False, False, False)}
    assert sorted(r.name for r in countries_without_data(dim, data).collect()) == ["Chad", "United Kingdom"]
    hits = search_names(dim, "n", order_by="pos").collect()
    assert [r.name for r in hits] == ["Kenya", "United Kingdom"]
    assert search_names(dim, "  ").count() == 0


def test_normalize_results_keeps_text_that_is_no_number(spark):
    df = spark.createDataFrame([("n/a",), ("5",), (None,), ("",)], "trending_appearances string")
    got = [(r.trending_appearances, r.trending_appearances_text) for r in normalize_results(df, "category_trends").collect()]
    assert got == [(None, "n/a"), (5.0, None), (None, None), (None, None)]
