from trendlake.schema import TOP_VIDEOS
from trendlake.session import scratch_dir
from trendlake.sources import export_csv, publish, publish_all, read_results_csv, read_snapshots_csv
from trendlake.schema import RAW_COLUMNS


def test_csv_round_trip_keeps_quotes_commas_newlines_and_nulls(spark):
    rows = [("US", 'a "b", c\nd', 1, ["x", "y"]), ("DE", None, None, []), ("JP", "", 3, None), ("FR", " a ", 2, None)]
    df = spark.createDataFrame(rows, "country string, title string, n bigint, tags array<string>")
    path = scratch_dir(spark, "rt")
    export_csv(df, path, single_file=True)
    back = read_results_csv(spark, path, schema=spark.createDataFrame([], "country string, title string, n bigint, tags string").schema)
    got = {r.country: (r.title, r.n, r.tags) for r in back.collect()}
    # empty text is read back as NULL, as the result loader does
    assert got == {"US": ('a "b", c\nd', 1, "x|y"), "DE": (None, None, None), "JP": (None, 3, None), "FR": (" a ", 2, None)}


def test_results_csv_header_rename_and_short_rows(spark):
    path = scratch_dir(spark, "short")
    import os

    os.makedirs(path)
    with open(f"{path}/part.csv", "w") as f:
        f.write('Country,Views\nUS,5\n\nDE\n"J""P",7\n')
    back = read_results_csv(spark, path, columns={"Country": "country", "Views": "views"})
    assert sorted((r.country, r.views) for r in back.collect()) == [("DE", None), ('J"P', "7"), ("US", "5")]


def test_raw_csv_ingest_by_header_name(spark):
    path = scratch_dir(spark, "rawcsv")
    import os

    os.makedirs(path)
    with open(f"{path}/raw.csv", "w") as f:
        f.write('video_title,video_id,extra\n"multi\nline",v1,z\n')
    df = read_snapshots_csv(spark, path)
    assert df.columns == RAW_COLUMNS
    r = df.collect()[0]
    assert (r.video_id, r.video_title, r.channel_id) == ("v1", "multi\nline", None)


def test_publish_partitions_by_country_and_casts_engagement(spark):
    df = spark.createDataFrame(
        [("US", "Music", "t", "c", "PT1M", 10, 12.34567, 3, "2024.01.01", 1), ("DE", "News", "u", "d", None, 5, 0.0, 1, "2024.01.02", 1)],
        ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in TOP_VIDEOS.schema.fields),
    )
    path = scratch_dir(spark, "pub")
    publish(df, "top10_videos_per_country", path)
    back = spark.read.parquet(path)
    assert dict(back.dtypes)["engagement_rating"] == "decimal(10,4)"
    import os

    assert sorted(d for d in os.listdir(path) if d.startswith("video_")) == ["video_trending_country=DE", "video_trending_country=US"]
    assert back.filter("video_trending_country = 'US'").collect()[0].engagement_rating == __import__("decimal").Decimal("12.3457")


def test_publish_all_stops_at_first_failure(spark):
    good = spark.createDataFrame([("US", 1)], "video_trending_country string, x int")
    base = scratch_dir(spark, "puball")
    done = publish_all({"zz_extra": good, "top10_categories_per_country": good.selectExpr("video_trending_country", "'c' as video_category_id", "1L as trending_appearances", "1L as total_views", "1L as avg_views", "1L as total_likes", "1 as rank")}, base)
    assert done == ["top10_categories_per_country", "zz_extra"]
    import pytest

    bad = good.selectExpr("video_trending_country")  # missing columns
    with pytest.raises(Exception):
        publish_all({"top10_channels_per_country": bad, "top10_categories_per_country": good}, scratch_dir(spark, "puball2"))


def test_catalog_publish_swaps_in_a_complete_table(spark):
    df = spark.createDataFrame([("US", "c", 1, 2, 3, 4, 1)], "video_trending_country string, video_category_id string, trending_appearances bigint, total_views bigint, avg_views bigint, total_likes bigint, rank int")
    publish(df, "top10_categories_per_country")
    publish(df.union(df.withColumn("rank", df["rank"] + 1)), "top10_categories_per_country")
    assert spark.table("top10_categories_per_country").count() == 2
    assert spark.table("top10_categories_per_country").filter("video_trending_country = 'US'").count() == 2


def test_publish_writes_one_file_per_country(spark):
    import os

    rows = [(c, f"cat{i}", i, i, i, i, i) for c in ("US", "DE") for i in range(1, 11)]
    df = spark.createDataFrame(rows, "video_trending_country string, video_category_id string, trending_appearances bigint, total_views bigint, avg_views bigint, total_likes bigint, rank int").repartition(6)
    path = scratch_dir(spark, "one-file")
    publish(df, "top10_categories_per_country", path)
    for country in ("US", "DE"):
        files = [f for f in os.listdir(f"{path}/video_trending_country={country}") if f.endswith(".parquet")]
        assert len(files) == 1


def test_published_country_text_is_kept_and_empty_names_are_refused(spark):
    import pytest

    from trendlake.sources import read_published

    schema = "video_trending_country string, video_category_id string, trending_appearances bigint, total_views bigint, avg_views bigint, total_likes bigint, rank int"
    path = scratch_dir(spark, "country-text")
    publish(spark.createDataFrame([("01", "c", 1, 2, 3, 4, 1)], schema), "top10_categories_per_country", path)
    assert [tuple(r) for r in read_published(spark, "top10_categories_per_country", path).collect()] == [("01", "c", 1, 2, 3, 4, 1)]
    with pytest.raises(Exception, match="empty video_trending_country"):
        publish(spark.createDataFrame([("", "c", 1, 2, 3, 4, 1)], schema), "top10_categories_per_country", scratch_dir(spark, "empty-country"))


def test_export_csv_in_order(spark):
    path = scratch_dir(spark, "ordered")
    export_csv(spark.createDataFrame([(i * 7 % 50, "x") for i in range(50)], "n int, t string").repartition(4), path, sort_by=["n"])
    import glob

    lines = [line.split(",")[0].strip('"') for f in sorted(glob.glob(f"{path}/part-*.csv")) for line in open(f).read().splitlines()[1:]]
    assert [int(x) for x in lines] == list(range(50))
