import pytest

from trendlake.fixtures import trending_raw
from trendlake.operators import (
    category_trends,
    clean_snapshots,
    top_categories,
    top_channels,
    top_videos,
    video_trends,
)
from trendlake.operators.lookups import country_top
from trendlake.plans import physical_plan, plan_nodes
from trendlake.session import scratch_dir
from trendlake.sources import publish, write_snapshots

from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def snap(spark):
    path = scratch_dir(spark, "plan-snap")
    write_snapshots(clean_snapshots(trending_raw(spark, SF_SMALL)), path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("op", [top_channels, top_categories, top_videos])
def test_rankings_limit_before_the_country_shuffle(snap, op):
    plan = physical_plan(op(snap), "simple")
    assert "WindowGroupLimit" in plan and ", Partial" in plan and ", Final" in plan


@pytest.mark.parametrize("op", [top_channels, top_categories, top_videos, video_trends])
def test_rankings_need_no_join(snap, op):
    nodes = plan_nodes(op(snap))
    assert not [n for n in nodes if "Join" in n]


@pytest.mark.parametrize("op", [top_videos, video_trends])
def test_peak_rows_are_aggregates_not_row_windows(snap, op):
    plan = physical_plan(op(snap), "simple")
    assert "partial_min(peak_" in plan or "partial_min(struct(" in plan
    assert "row_number() windowspecdefinition(video_id" not in plan


def test_key_filters_reach_the_scan(snap):
    plan = physical_plan(top_categories(snap), "formatted")
    pushed = [l for l in plan.splitlines() if l.startswith("PushedFilters")]
    assert any("IsNotNull(video_trending_country)" in l and "IsNotNull(video_category_id)" in l for l in pushed)


def test_category_trends_scans_only_needed_columns(snap):
    plan = physical_plan(category_trends(snap), "formatted")
    schemas = [l for l in plan.splitlines() if "ReadSchema" in l]
    assert schemas and all("channel_title" not in s and "video_title" not in s for s in schemas)


def test_country_lookup_prunes_partitions(spark, snap):
    path = scratch_dir(spark, "plan-pub")
    publish(top_categories(snap), "top10_categories_per_country", path)
    plan = physical_plan(country_top(spark.read.parquet(path), "ASIA"), "formatted")
    assert "PartitionFilters: [isnotnull(video_trending_country" in plan and "ASIA" in plan


def test_country_filter_pushes_below_the_rank_window(snap):
    plan = physical_plan(country_top(top_categories(snap), "ASIA"), "formatted")
    scan = [l for l in plan.splitlines() if "PushedFilters" in l]
    assert any("EqualTo(video_trending_country,ASIA)" in l for l in scan)


def test_large_k_keeps_the_partial_group_limit(spark, snap):
    # longer lists than the default threshold: the session raises the setting, the operator does not
    key = "spark.sql.optimizer.windowGroupLimitThreshold"
    spark.conf.set(key, "5000")
    try:
        plan = physical_plan(top_channels(snap, k=5000), "simple")
        assert "WindowGroupLimit" in plan and ", Partial" in plan
    finally:
        spark.conf.unset(key)


def test_tag_cleaning_is_not_inlined_into_a_pushed_filter(snap):
    from trendlake.operators import tag_counts

    plan = physical_plan(tag_counts(snap), "simple")
    filters = [ln for ln in plan.splitlines() if "Filter" in ln]
    assert filters and not any("translate(" in ln for ln in filters)
