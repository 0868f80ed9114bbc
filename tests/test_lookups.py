import pytest

from trendlake.operators import clean_snapshots, top_categories
from trendlake.operators.catalog import (
    ReadOnlyViolation,
    describe_table,
    list_tables,
    readonly_sql,
    require_table,
)
from trendlake.operators.lookups import browse, country_report, country_top, require_country

from tests.conftest import raw_rows, snap_row


@pytest.fixture(scope="module")
def cats(spark):
    rows = [snap_row(video_id=f"v{i}", video_category_id=f"C{i % 12}", video_trending_country=c) for i in range(40) for c in ("US", "DE")]
    return top_categories(clean_snapshots(raw_rows(spark, rows)))


def test_country_required():
    for bad in (None, "", "  "):
        with pytest.raises(ValueError):
            require_country(bad)


def test_country_top_is_ordered_and_capped(spark, cats):
    out = country_top(cats, "US", n=3).collect()
    assert [r.rank for r in out] == [1, 2, 3]
    assert all(r.video_trending_country == "US" for r in out)


def test_browse_filters_pages_and_rejects_unknown_columns(spark, cats):
    page = browse(cats, {"video_trending_country": "DE"}, limit=4, offset=2, table_name="top10_categories_per_country").collect()
    assert [r.rank for r in page] == [3, 4, 5, 6]
    with pytest.raises(KeyError):
        browse(cats, {"nope": 1})
    with pytest.raises(ValueError):
        browse(cats, limit=10**9)
    assert browse(cats, limit=20_000, max_page=20_000).count() == cats.count()


def test_country_report_has_five_parts(spark, cats):
    tables = {n: cats for n in ("top10_channels_per_country", "top10_categories_per_country", "top10_videos_per_country")}
    trends = spark.createDataFrame(
        [("US", "C1", 2024, 1, 3, 10, ["a"])],
        "video_trending_country string, video_category_id string, trending_year int, trending_month int, trending_appearances bigint, total_views bigint, top5_tags array<string>",
    )
    vt = spark.createDataFrame(
        [("US", 2024, 1, "t", "C1", "ch", 1, 2, 3, "PT1M", 4)],
        "video_trending_country string, trending_year int, trending_month int, video_title string, video_category_id string, channel_title string, video_view_count bigint, video_like_count bigint, video_comment_count bigint, video_duration string, trending_appearances bigint",
    )
    rep = country_report({**tables, "category_trends_over_time": trends, "video_trends_over_time": vt}, "US")
    assert set(rep) == {"top_channels", "top_categories", "top_videos", "category_trends", "video_trends"}
    ct = rep["category_trends"].collect()[0]
    assert (ct.date, ct.category, ct.top5_tags) == ("2024-01-01", "C1", "a")


def test_readonly_sql_guard(spark, cats):
    cats.createOrReplaceTempView("guard_cats")
    assert readonly_sql(spark, "  select count(*) as n from guard_cats ;").collect()[0].n == cats.count()
    assert readonly_sql(spark, "WITH x AS (SELECT 1 AS a) SELECT a FROM x").collect()[0].a == 1
    spark.sql("CREATE TABLE IF NOT EXISTS guard_target (a INT) USING parquet")
    for bad in (
        "DROP TABLE guard_target",
        "INSERT INTO guard_target VALUES (1)",
        "WITH x AS (SELECT 1 AS a) INSERT INTO guard_target SELECT a FROM x",
        "SELECT 1; DROP TABLE guard_target",
        "SHOW TABLES; DROP TABLE guard_target",
        "DESCRIBE guard_target; DROP TABLE guard_target",
    ):
        with pytest.raises(ReadOnlyViolation):
            readonly_sql(spark, bad)
    assert spark.table("guard_target").count() == 0
    assert readonly_sql(spark, "SHOW TABLES").count() >= 1
    with pytest.raises(ValueError):
        readonly_sql(spark, "   ")


def test_catalog_listing_and_describe(spark):
    spark.sql("CREATE TABLE IF NOT EXISTS cat_b (a INT, b STRING) USING parquet")
    spark.sql("CREATE TABLE IF NOT EXISTS cat_a (a INT) USING parquet")
    names = [r.table_name for r in list_tables(spark).collect()]
    assert names == sorted(names) and {"cat_a", "cat_b"} <= set(names)
    d = describe_table(spark, "cat_b").collect()
    assert [(r.field, r.type, r.default) for r in d] == [("a", "int", None), ("b", "string", None)]
    with pytest.raises(KeyError):
        require_table(spark, "no_such_table")


def test_readonly_sql_refuses_reflection(spark):
    for bad in ("SELECT reflect('java.lang.System', 'exit', 0)", "select JAVA_METHOD ('java.lang.Thread', 'sleep', 1L)"):
        with pytest.raises(ReadOnlyViolation):
            readonly_sql(spark, bad)
