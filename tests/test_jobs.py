from trendlake.fixtures import trending_raw
from trendlake.jobs import refresh_results
from trendlake.operators import clean_snapshots, top_videos
from trendlake.operators.lookups import country_top
from trendlake.session import scratch_dir

from tests.conftest import SF_SMALL


def test_refresh_results_end_to_end(spark):
    raw_path = scratch_dir(spark, "raw")
    trending_raw(spark, SF_SMALL).write.parquet(raw_path)
    paths = refresh_results(spark, raw_path, scratch_dir(spark, "out"))
    assert set(paths) >= {"cleaned", "summary", "top10_videos_per_country", "video_trends_over_time"}
    published = spark.read.parquet(paths["top10_videos_per_country"])
    direct = top_videos(clean_snapshots(trending_raw(spark, SF_SMALL)))
    for country in ("ASIA", "EUROPE"):
        a = [(r.video_title, r.rank) for r in country_top(published, country).collect()]
        b = [(r.video_title, r.rank) for r in country_top(direct, country).collect()]
        assert a == b and len(a) == 10


def test_refresh_results_from_raw_csv_matches_parquet_path(spark):
    raw = trending_raw(spark, SF_SMALL)
    csv_path = scratch_dir(spark, "raw-csv")
    raw.write.option("header", "true").option("quote", '"').option("escape", '"').csv(csv_path)
    pq_path = scratch_dir(spark, "raw-pq")
    raw.write.parquet(pq_path)
    a = refresh_results(spark, csv_path, scratch_dir(spark, "out-csv"), raw_format="csv")
    b = refresh_results(spark, pq_path, scratch_dir(spark, "out-pq"))
    for table in ("category_trends_over_time", "top10_channels_per_country"):
        ra = sorted(map(tuple, spark.read.parquet(a[table]).collect()), key=str)
        rb = sorted(map(tuple, spark.read.parquet(b[table]).collect()), key=str)
        assert ra == rb and len(ra) > 0
