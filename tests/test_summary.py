"""Analyses give the same rows from the sighting summary as from snapshots."""

import pytest

from trendlake.fixtures import trending_raw
from trendlake.operators import (
    category_trends,
    clean_snapshots,
    peak_snapshots,
    sighting_summary,
    tag_counts,
    top_categories,
    top_channels,
    top_videos,
    video_trends,
)
from trendlake.plans import physical_plan
from trendlake.session import scratch_dir
from trendlake.operators.summary import DEALT_BY
from trendlake.sources import buckets, write_by_key, write_snapshots

from tests.conftest import SF_SMALL, raw_rows
from tests.forms import random_rows

OPS = [top_categories, top_channels, top_videos, peak_snapshots, tag_counts, category_trends, video_trends]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def fixture_pair(spark):
    snap = clean_snapshots(trending_raw(spark, SF_SMALL))
    path = scratch_dir(spark, "summary")
    write_snapshots(sighting_summary(snap), path)
    return snap, spark.read.parquet(path)


@pytest.mark.parametrize("op", OPS, ids=[o.__name__ for o in OPS])
def test_summary_gives_same_rows_on_fixture(fixture_pair, op):
    snap, summary = fixture_pair
    assert rows_of(op(summary)) == rows_of(op(snap))


def test_summary_gives_same_rows_on_random_frames(spark):
    for seed in range(3):
        rows = random_rows(seed, n=400)
        for i, r in enumerate(rows):  # repeated sightings over a few dates, some bad
            r["video_trending__date"] = ["2024.01.05", "2024.01.20", "2024.02.01", "bad", None][i % 5]
            r["video_tags"] = ["a,bb,cc", "bb; Dd", None, "x|y,zz"][i % 4]
        snap = clean_snapshots(raw_rows(spark, rows))
        summary = sighting_summary(snap)
        for op in OPS:
            assert rows_of(op(summary)) == rows_of(op(snap)), (seed, op.__name__)


def test_summary_shrinks_repeated_sightings(spark):
    rows = [dict(r, video_trending__date=f"2024.01.{d:02d}") for r in random_rows(1, n=50) for d in range(1, 11)]
    snap = clean_snapshots(raw_rows(spark, rows))
    assert sighting_summary(snap).count() * 5 <= snap.count()


def test_snapshot_path_adds_no_shuffle(spark, fixture_pair):
    snap, _ = fixture_pair
    # two-level aggregate + rank window: exactly three exchanges, as before the summary existed
    plan = physical_plan(top_categories(snap), "simple")
    assert plan.count("Exchange hashpartitioning") == 3


def _nodes_below(plan, node):
    """The lines of a plan's text from the deepest ``node`` down."""
    lines = plan.splitlines()
    at = max(k for k, line in enumerate(lines) if node in line)
    return "\n".join(lines[at + 1:])


def test_the_summary_sorts_nothing_before_its_shuffle(spark, fixture_pair):
    path = scratch_dir(spark, "cleaned")
    write_snapshots(fixture_pair[0], path)
    plan = physical_plan(sighting_summary(spark.read.parquet(path)), "simple")
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_COL" in plan
    below = _nodes_below(plan, "Exchange")
    assert "Sort" not in below and "Aggregate" not in below


@pytest.mark.parametrize("op", [top_channels, top_videos, video_trends], ids=lambda o: o.__name__)
def test_rankings_of_a_summary_shuffle_counts_only(fixture_pair, op):
    plan = physical_plan(op(fixture_pair[1]), "simple")
    first = [ln for ln in plan.splitlines() if "HashAggregate(keys=[video_id" in ln and "partial_sum(sightings" in ln]
    assert first and all("partial_min" not in ln for ln in first)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "NestedLoop" not in plan


def test_null_keys_and_unseen_views_rank_alike_from_a_summary(spark):
    rows = random_rows(11, n=300)
    for i, r in enumerate(rows):
        r["video_trending_country"] = ["US", None, "DE"][i % 3]
        r["video_view_count"] = ["many", "5", "5", "12"][i % 4]
        r["video_trending__date"] = ["2024.01.05", "2024.02.01", None][i % 3]
    snap = clean_snapshots(raw_rows(spark, rows))
    path = scratch_dir(spark, "summary-null-keys")
    write_snapshots(sighting_summary(snap), path)
    for op in (top_channels, top_videos, video_trends):
        assert rows_of(op(spark.read.parquet(path))) == rows_of(op(snap)), op.__name__


@pytest.mark.parametrize("op", [top_categories, top_channels, top_videos, video_trends, category_trends], ids=lambda o: o.__name__)
def test_a_summary_in_buckets_is_not_shuffled_by_video(spark, fixture_pair, op):
    names = [t.name for t in spark.catalog.listTables()]
    path = scratch_dir(spark, "summary-by-key")
    summary = write_by_key(sighting_summary(fixture_pair[0], buckets(spark)), path, DEALT_BY)
    assert [t.name for t in spark.catalog.listTables()] == names
    assert "hashpartitioning(video_id" not in physical_plan(op(summary), "simple")
    assert rows_of(op(summary)) == rows_of(op(fixture_pair[0]))
