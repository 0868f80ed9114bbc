"""

Every query reads the driver's tables through the ``trending_raw`` fixture
view (lineitem rows mapped to trending snapshots), cleans them and runs one
operator over the whole data.  ``oracle_sql`` holds an independent DuckDB
formulation of the same result for each key (trendlake/oracle.py).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendlake import oracle, store_queries
from trendlake.fixtures import DRAFT_SPEC, daily_raw, drafts, read_table, trending_raw
from trendlake.functions import (
    channel_link,
    engagement_rating,
    format_count,
    format_duration,
    format_engagement,
    parse_tags,
)
from trendlake.operators import (
    category_trends,
    clean_snapshots,
    peak_snapshots,
    sighting_summary,
    tag_counts,
    top_categories,
    top_channels,
    top_tags,
    top_videos,
    video_trends,
    with_trending_month,
)
from trendlake.operators.summary import DEALT_BY, with_peak_columns
from trendlake.operators.catalog import readonly_sql
from trendlake.operators.dims import (
    countries_without_data,
    country_coverage,
    enrich_country,
    search_names,
)
from trendlake.operators.display import display_rows
from trendlake.operators.explore import (
    category_share,
    leading_categories,
    leading_category_trends,
    normalize_results,
    pinned_points,
    series_domain,
    trend_series,
    video_categories,
)
from trendlake.operators.lookups import (
    browse,
    country_category_trends,
    country_top,
    country_video_trends,
)
from trendlake.operators.quality import check_constraints, constraint_summary
from trendlake.schema import CATEGORY_TRENDS, COUNTRY, RESULT_TABLES
from trendlake.session import scratch_dir
from trendlake.sources import (
    buckets,
    export_csv,
    publish,
    publishable,
    read_published,
    read_results_csv,
    read_snapshots,
    read_snapshots_csv,
    write_by_key,
    write_snapshots,
)

try:  # the training-data operators and their pipeline are an optional part
    import corpus_pipeline
    from trendlake.llm import queries as llm_queries
except ImportError:
    corpus_pipeline = llm_queries = None

SMOKE_DIR = "/root/testdata/sf0.001"
Q = Callable[[SparkSession, str], DataFrame]


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_snapshots(trending_raw(spark, sf_dir))


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: top-10 categories per country on sf0.001."""
    return top_categories(snapshots(spark, SMOKE_DIR))


def _on_snap(op) -> Q:
    return lambda spark, sf: op(snapshots(spark, sf))


def written_summary(spark: SparkSession, sf_dir: str, raw=trending_raw) -> DataFrame:
    """The path the refresh job runs: cleaned table -> written summary."""
    cleaned, summary = scratch_dir(spark, "cleaned"), scratch_dir(spark, "summary")
    write_snapshots(clean_snapshots(raw(spark, sf_dir)), cleaned)
    return write_by_key(sighting_summary(read_snapshots(spark, cleaned), buckets(spark)), summary, DEALT_BY)


def _on_summary(op, raw=trending_raw) -> Q:
    return lambda spark, sf: op(written_summary(spark, sf, raw))


def _q_raw_csv(spark, sf):
    path = scratch_dir(spark, "raw-csv")
    export_csv(trending_raw(spark, sf), path)
    return clean_snapshots(read_snapshots_csv(spark, path))


# ---------------------------------------------------------------- R0-R5 parts
def _q_engagement(spark, sf):
    return snapshots(spark, sf).select(
        "video_id", COUNTRY, "video_trending_date", "video_view_count", "video_like_count",
        "video_comment_count",
        engagement_rating("video_view_count", "video_like_count", "video_comment_count").alias("engagement_rating"),
    )


def _q_months(spark, sf):
    return with_trending_month(snapshots(spark, sf)).select(
        "video_id", COUNTRY, "video_trending_date", "trending_date", "trending_year", "trending_month"
    )


# ---------------------------------------------------------------- serving
def _ct(spark, sf):
    return category_trends(snapshots(spark, sf))


def _q_readonly(spark, sf):
    top_categories(snapshots(spark, sf)).createOrReplaceTempView("top10_categories_per_country")
    return readonly_sql(spark, oracle.READONLY_SQL_TEXT)


def _q_browse(spark, sf):
    return browse(
        publishable(_ct(spark, sf)), {COUNTRY: oracle.BROWSE_COUNTRY}, limit=50, offset=10,
        table_name="category_trends_over_time",
    )


# ---------------------------------------------------------------- explorer
def _leading_trends(spark, sf):
    ct = _ct(spark, sf)
    return leading_category_trends(ct, leading_categories(ct))


def _q_pinned_categories(spark, sf):
    rows = country_category_trends(_leading_trends(spark, sf), oracle.LOOKUP_COUNTRY)
    keys = rows.select(
        F.concat("date", F.lit("|"), "category").alias("pos"),
        F.concat("category", F.lit("|"), "date").alias("key"),
    )
    return publishable(pinned_points(rows, keys, "category"))


def _q_pinned_videos(spark, sf):
    rows = country_video_trends(video_trends(snapshots(spark, sf)), oracle.LOOKUP_COUNTRY)
    keys = rows.select(
        F.col("date").alias("pos"),
        F.concat(F.coalesce("video_title", F.lit("")), F.lit("|"), "date").alias("key"),
    )
    return pinned_points(rows, keys, "video")


# ---------------------------------------------------------------- formatting
def _q_format_duration(spark, sf):
    return snapshots(spark, sf).select(
        "video_duration", format_duration("video_duration").alias("duration_text")
    ).distinct()


def _q_format_count(spark, sf):
    return snapshots(spark, sf).select(
        "video_view_count", "channel_view_count",
        format_count("video_view_count").alias("views_text"),
        format_count("channel_view_count").alias("channel_views_text"),
    ).distinct()


def _q_format_engagement(spark, sf):
    return peak_snapshots(snapshots(spark, sf)).select(
        "engagement_rating", format_engagement("engagement_rating").alias("engagement_text")
    ).distinct()


def _q_channel_link(spark, sf):
    return snapshots(spark, sf).select(
        "channel_custom_url", channel_link("channel_custom_url").alias("link")
    ).distinct()


def _q_parse_tags(spark, sf):
    ct = publishable(_ct(spark, sf))
    return ct.select(
        COUNTRY, "video_category_id", "trending_year", "trending_month",
        F.posexplode(parse_tags("top5_tags")).alias("tag_pos", "tag"),
    ).withColumn("tag_pos", F.col("tag_pos") + 1)


# ---------------------------------------------------------------- dimension
def _region_dim(spark, sf):
    return read_table(spark, sf, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("region_key"))


def _q_enrich(spark, sf):
    return enrich_country(top_categories(snapshots(spark, sf)), _region_dim(spark, sf))


def _q_coverage(spark, sf):
    # The three lists come from the written summary: one pass over the snapshots, not three.
    summary = written_summary(spark, sf)
    lists = {"channels": top_channels(summary), "categories": top_categories(summary), "videos": top_videos(summary)}
    return country_coverage(_region_dim(spark, sf), lists)


def _q_without_data(spark, sf):
    snap = snapshots(spark, sf)
    nations = read_table(spark, sf, "nation").select(
        F.col("n_name").alias("name"), F.col("n_nationkey").alias("nation_key")
    )
    listed = snap.join(top_channels(snap).select("channel_title"), "channel_title", "left_semi")
    return countries_without_data(nations, listed, data_key="channel_country")


def _q_search(spark, sf):
    names = read_table(spark, sf, "part").select(F.col("p_name").alias("name"))
    hits = search_names(names, oracle.SEARCH_TERM)
    return hits.select(
        "name", F.col("match.before").alias("match_before"), F.col("match.hit").alias("match_hit"),
        F.col("match.after").alias("match_after"),
    )


# ---------------------------------------------------------------- quality, sinks
def _q_constraint_summary(spark, sf):
    # The five results come from the written summary, as in the refresh job: one pass over the snapshots, not six.
    summary = written_summary(spark, sf)
    tables = {
        "top10_channels_per_country": top_channels(summary),
        "top10_categories_per_country": top_categories(summary),
        "top10_videos_per_country": top_videos(summary),
        "category_trends_over_time": publishable(category_trends(summary)),
        "video_trends_over_time": video_trends(summary),
    }
    return reduce(DataFrame.unionByName, [constraint_summary(df, RESULT_TABLES[n]) for n, df in tables.items()])


def _q_check_constraints(spark, sf):
    return check_constraints(drafts(spark, sf), DRAFT_SPEC)


def _q_csv_round_trip(spark, sf):
    path = scratch_dir(spark, "csv-round-trip")
    export_csv(_ct(spark, sf), path, sort_by=CATEGORY_TRENDS.sort_by)
    return read_results_csv(spark, path, schema=CATEGORY_TRENDS.schema)


def _q_normalize(spark, sf):
    path = scratch_dir(spark, "csv-videos")
    export_csv(top_videos(snapshots(spark, sf)), path)
    text = read_results_csv(spark, path)
    return normalize_results(text, "videos").select(
        COUNTRY, "video_title", "channel_title", "video_view_count", "trending_appearances", "rank"
    )


def _q_publish_lookup(spark, sf):
    path = scratch_dir(spark, "published-videos")
    publish(top_videos(snapshots(spark, sf)), "top10_videos_per_country", path)
    return country_top(read_published(spark, "top10_videos_per_country", path), oracle.LOOKUP_COUNTRY)


def queries() -> dict[str, Q]:
    extra = {**llm_queries.QUERIES, "pipeline": corpus_pipeline.run} if llm_queries else {}
    return _own_queries() | extra


def _own_queries() -> dict[str, Q]:
    c = oracle.LOOKUP_COUNTRY
    return {
        # R0-R5 and their parts
        "clean_snapshots": snapshots,
        "top_categories": _on_snap(top_categories),
        "top_channels": _on_snap(top_channels),
        "top_videos": _on_snap(top_videos),
        "peak_snapshots": _on_snap(peak_snapshots),
        "engagement_rating": _q_engagement,
        "trending_months": _q_months,
        "tag_counts": _on_snap(tag_counts),
        "top_tags": _on_snap(top_tags),
        "category_trends": lambda spark, sf: publishable(_ct(spark, sf)),
        "video_trends": _on_snap(video_trends),
        "sighting_summary": _on_snap(lambda snap: with_peak_columns(sighting_summary(snap))),
        # R6, R7, L4, C5
        "country_top_channels": lambda spark, sf: country_top(top_channels(snapshots(spark, sf)), c),
        "country_top_categories": lambda spark, sf: country_top(top_categories(snapshots(spark, sf)), c),
        "country_top_videos": lambda spark, sf: country_top(top_videos(snapshots(spark, sf)), c),
        "country_category_trends": lambda spark, sf: country_category_trends(_ct(spark, sf), c),
        "country_video_trends": lambda spark, sf: country_video_trends(video_trends(snapshots(spark, sf)), c),
        "browse_table": _q_browse,
        "readonly_sql": _q_readonly,
        # R8-R12
        "leading_categories": lambda spark, sf: leading_categories(_ct(spark, sf)),
        "leading_category_trends": lambda spark, sf: publishable(_leading_trends(spark, sf)),
        "video_categories": lambda spark, sf: video_categories(video_trends(snapshots(spark, sf))),
        "series_domain": lambda spark, sf: series_domain(_leading_trends(spark, sf)),
        "video_series_domain": lambda spark, sf: series_domain(video_trends(snapshots(spark, sf))),
        "trend_series": lambda spark, sf: trend_series(_leading_trends(spark, sf)),
        "pinned_categories": _q_pinned_categories,
        "pinned_videos": _q_pinned_videos,
        "category_share": lambda spark, sf: category_share(top_categories(snapshots(spark, sf))),
        # R11, R13 and the F-functions
        "normalize_results": _q_normalize,
        "format_duration": _q_format_duration,
        "format_count": _q_format_count,
        "format_engagement": _q_format_engagement,
        "channel_link": _q_channel_link,
        "parse_tags": _q_parse_tags,
        "display_videos": lambda spark, sf: display_rows(top_videos(snapshots(spark, sf)), "videos"),
        "display_channels": lambda spark, sf: display_rows(top_channels(snapshots(spark, sf)), "channels"),
        "display_categories": lambda spark, sf: display_rows(top_categories(snapshots(spark, sf)), "categories"),
        "display_video_trends": lambda spark, sf: display_rows(video_trends(snapshots(spark, sf)), "video_trends"),
        # R14, R15
        "enrich_country": _q_enrich,
        "country_coverage": _q_coverage,
        "countries_without_data": _q_without_data,
        "search_names": _q_search,
        "check_constraints": _q_check_constraints,
        "constraint_summary": _q_constraint_summary,
        # S2-S10
        "csv_round_trip": _q_csv_round_trip,
        "publish_and_lookup": _q_publish_lookup,
        "raw_csv_ingest": _q_raw_csv,
        # R1-R5 from the written summary
        "summary_top_categories": _on_summary(top_categories),
        "summary_top_channels": _on_summary(top_channels),
        "summary_top_videos": _on_summary(top_videos),
        "summary_category_trends": _on_summary(lambda s: publishable(category_trends(s))),
        "summary_video_trends": _on_summary(video_trends),
        # the same on daily sightings: repeats within a month, nulls, bad dates and counts
        "daily_sighting_summary": _on_summary(with_peak_columns, daily_raw),
        "daily_top_categories": _on_summary(top_categories, daily_raw),
        "daily_top_channels": _on_summary(top_channels, daily_raw),
        "daily_top_videos": _on_summary(top_videos, daily_raw),
        "daily_category_trends": _on_summary(lambda s: publishable(category_trends(s)), daily_raw),
        "daily_video_trends": _on_summary(video_trends, daily_raw),
        "daily_display_videos": lambda spark, sf: display_rows(top_videos(clean_snapshots(daily_raw(spark, sf))), "videos"),
        # published stores, CSV files of several headers, long lists
        **store_queries.QUERIES,
    }


def oracle_sql() -> dict[str, str]:
    extra = dict(llm_queries.ORACLE_SQL) if llm_queries else {}
    if corpus_pipeline and corpus_pipeline.ORACLE_SQL:
        extra["pipeline"] = corpus_pipeline.ORACLE_SQL
    return _own_oracle_sql() | extra


def _own_oracle_sql() -> dict[str, str]:
    o = oracle
    return {
        "clean_snapshots": o.CLEAN,
        "top_categories": o.TOP_CATEGORIES,
        "top_channels": o.TOP_CHANNELS,
        "top_videos": o.TOP_VIDEOS,
        "peak_snapshots": o.PEAK_SNAPSHOTS,
        "engagement_rating": o.ENGAGEMENT_ROWS,
        "trending_months": o.TRENDING_MONTHS,
        "tag_counts": o.TAG_COUNTS,
        "top_tags": o.TOP_TAGS,
        "category_trends": o.CATEGORY_TRENDS,
        "video_trends": o.VIDEO_TRENDS,
        "sighting_summary": o.SIGHTING_SUMMARY,
        "country_top_channels": o.COUNTRY_TOP_CHANNELS,
        "country_top_categories": o.COUNTRY_TOP_CATEGORIES,
        "country_top_videos": o.COUNTRY_TOP_VIDEOS,
        "country_category_trends": o.COUNTRY_CATEGORY_TRENDS,
        "country_video_trends": o.COUNTRY_VIDEO_TRENDS,
        "browse_table": o.BROWSE_TABLE,
        "readonly_sql": o.READONLY_SQL,
        "leading_categories": o.LEADING_CATEGORIES,
        "leading_category_trends": o.LEADING_CATEGORY_TRENDS,
        "video_categories": o.VIDEO_CATEGORIES,
        "series_domain": o.SERIES_DOMAIN,
        "video_series_domain": o.VIDEO_SERIES_DOMAIN,
        "trend_series": o.TREND_SERIES,
        "pinned_categories": o.PINNED_CATEGORIES,
        "pinned_videos": o.PINNED_VIDEOS,
        "category_share": o.CATEGORY_SHARE,
        "normalize_results": o.NORMALIZE_RESULTS,
        "format_duration": o.FORMAT_DURATION,
        "format_count": o.FORMAT_COUNT,
        "format_engagement": o.FORMAT_ENGAGEMENT,
        "channel_link": o.CHANNEL_LINK,
        "parse_tags": o.PARSE_TAGS,
        "display_videos": o.DISPLAY_VIDEOS,
        "display_channels": o.DISPLAY_CHANNELS,
        "display_categories": o.DISPLAY_CATEGORIES,
        "display_video_trends": o.DISPLAY_VIDEO_TRENDS,
        "enrich_country": o.ENRICH_COUNTRY,
        "country_coverage": o.COUNTRY_COVERAGE,
        "countries_without_data": o.COUNTRIES_WITHOUT_DATA,
        "search_names": o.SEARCH_NAMES,
        "check_constraints": o.CHECK_CONSTRAINTS,
        "constraint_summary": o.CONSTRAINT_SUMMARY,
        "csv_round_trip": o.CATEGORY_TRENDS,
        "publish_and_lookup": o.PUBLISH_AND_LOOKUP,
        "raw_csv_ingest": o.CLEAN,
        "summary_top_categories": o.TOP_CATEGORIES,
        "summary_top_channels": o.TOP_CHANNELS,
        "summary_top_videos": o.TOP_VIDEOS,
        "summary_category_trends": o.CATEGORY_TRENDS,
        "summary_video_trends": o.VIDEO_TRENDS,
        "daily_sighting_summary": o.on_daily(o.SIGHTING_SUMMARY),
        "daily_top_categories": o.on_daily(o.TOP_CATEGORIES),
        "daily_top_channels": o.on_daily(o.TOP_CHANNELS),
        "daily_top_videos": o.on_daily(o.TOP_VIDEOS),
        "daily_category_trends": o.on_daily(o.CATEGORY_TRENDS),
        "daily_video_trends": o.on_daily(o.VIDEO_TRENDS),
        "daily_display_videos": o.on_daily(o.DISPLAY_VIDEOS),
        **store_queries.ORACLE_SQL,
    }
