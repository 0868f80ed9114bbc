"""The batch refresh the product runs when new snapshots arrive: raw files ->
cleaned table -> sighting summary -> the five published result tables.

Each step writes its output before the next one reads it, so lineage is cut
at every table and a lost executor only re-runs tasks of the current step.
All outputs live under one root on shared storage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trendlake.operators import (
    category_trends,
    clean_snapshots,
    sighting_summary,
    top_categories,
    top_channels,
    top_videos,
    video_trends,
)
from trendlake.operators.summary import DEALT_BY
from trendlake.schema import RAW_COLUMNS
from trendlake.sources import Release, buckets, publish_all, publish_release, read_csv_files, read_snapshots, read_snapshots_csv, write_by_key, write_snapshots


def refresh_results(spark: SparkSession, raw_path: str, out_root: str, raw_format: str = "parquet") -> dict[str, str]:
    """Rebuild every derived table from the raw snapshots at ``raw_path``.

    Returns the paths written: ``cleaned``, ``summary`` and one per result
    table under ``published/``.
    """
    root = out_root.rstrip("/")
    raw = read_snapshots_csv(spark, raw_path) if raw_format == "csv" else read_snapshots(spark, raw_path)
    paths = {"cleaned": f"{root}/cleaned", "summary": f"{root}/summary"}
    tables = _results(spark, raw, paths)
    for name in publish_all(tables, f"{root}/published"):
        paths[name] = f"{root}/published/{name}"
    return paths


def refresh_release(spark: SparkSession, raw_path: str, out_root: str, raw_format: str = "parquet") -> Release:
    """The same with all five tables published at once, as the next release below ``out_root/results``.

    CSV files may differ in their headers; records that do not fit theirs go to
    ``out_root/quarantine``.
    """
    root = out_root.rstrip("/")
    if raw_format == "csv":
        files = read_csv_files(spark, raw_path)
        files.bad().write.mode("overwrite").parquet(f"{root}/quarantine")
        raw = files.rows(RAW_COLUMNS)
    else:
        raw = read_snapshots(spark, raw_path)
    tables = _results(spark, raw, {"cleaned": f"{root}/cleaned", "summary": f"{root}/summary"})
    return publish_release(spark, f"{root}/results", tables)


def _results(spark: SparkSession, raw: DataFrame, paths: dict[str, str]) -> dict[str, DataFrame]:
    """The five analyses over the summary of ``raw``, which is written on the way."""
    write_snapshots(clean_snapshots(raw), paths["cleaned"])
    summary = write_by_key(sighting_summary(read_snapshots(spark, paths["cleaned"]), buckets(spark)), paths["summary"], DEALT_BY)
    return {
        "top10_channels_per_country": top_channels(summary),
        "top10_categories_per_country": top_categories(summary),
        "top10_videos_per_country": top_videos(summary),
        "category_trends_over_time": category_trends(summary),
        "video_trends_over_time": video_trends(summary),
    }
