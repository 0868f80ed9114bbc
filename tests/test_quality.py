from trendlake.operators.quality import check_constraints, constraint_summary
from trendlake.schema import CATEGORY_TRENDS, TOP_VIDEOS


def trends(spark, rows):
    return spark.createDataFrame(rows, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in CATEGORY_TRENDS.schema.fields))


def test_month_check_and_not_null(spark):
    df = trends(spark, [("US", "M", 2024, 0, 1, 1, None), ("US", "M", 2024, 13, 1, 1, None), ("US", "M", 2024, None, 1, 1, None), ("US", "M", 2024, 5, 1, 1, None)])
    v = check_constraints(df, "category_trends_over_time").collect()
    assert sorted(r.value for r in v if r.check_name == "month_range") == ["0", "13"]
    assert [(r.check_name, r.column_name) for r in v if r.check_name == "not_null"] == [("not_null", "trending_month")]


def test_primary_key_duplicates(spark):
    df = trends(spark, [("US", "M", 2024, 1, 1, 1, None), ("US", "M", 2024, 1, 2, 2, None), ("DE", "M", 2024, 1, 1, 1, None)])
    v = [r for r in check_constraints(df, "category_trends_over_time").collect() if r.check_name == "primary_key"]
    assert [(r.row_key, r.value) for r in v] == [("US|M|2024|1", "2")]
    s = {(r.check_name, r.column_name): r.violations for r in constraint_summary(df, "category_trends_over_time").collect()}
    assert s[("primary_key", "video_trending_country,video_category_id,trending_year,trending_month")] == 1
    assert s[("month_range", "trending_month")] == 0


def test_varchar_and_decimal_checks(spark):
    cols = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in TOP_VIDEOS.schema.fields)
    df = spark.createDataFrame(
        [("US", "x" * 256, "t", "c", "d", 1, 1234567.5, 1, "p", 1), ("US", "ok", "t", "c", "d", 1, 999999.9999, 1, "p", 2)], cols
    )
    s = {(r.check_name, r.column_name): r.violations for r in constraint_summary(df, "top10_videos_per_country").collect()}
    assert s[("varchar_255", "video_category_id")] == 1
    assert s[("decimal_10_4", "engagement_rating")] == 1
    assert s[("primary_key", "video_trending_country,rank")] == 0


def test_equal_violations_are_counted_in_one_scan(spark):
    df = trends(spark, [("US", "M", 2024, 13, 1, 1, None)] * 3 + [("US", "NULL", 2024, 1, 1, 1, None), ("US", None, 2024, 1, 1, 1, None)])
    v = check_constraints(df, "category_trends_over_time")
    got = sorted((r.check_name, r.row_key, r.value, r.rows) for r in v.collect())
    assert got == [("month_range", "US|M|2024|13", "13", 3), ("not_null", "US|NULL|2024|1", None, 1), ("primary_key", "US|M|2024|13", "3", 3)]


def test_empty_table_has_no_violations(spark):
    df = trends(spark, [])
    assert check_constraints(df, "category_trends_over_time").collect() == []
    assert {r.violations for r in constraint_summary(df, "category_trends_over_time").collect()} == {0}
