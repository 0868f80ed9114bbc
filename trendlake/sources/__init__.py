"""Readers (S1, S2, S6, S7) and sinks."""

from trendlake.sources.csv_files import CsvFiles, read_csv_files
from trendlake.sources.ordered import OrderedTable, open_ordered, write_ordered
from trendlake.sources.releases import Release, open_release, publish_release, sweep
from trendlake.sources.results import read_results_csv
from trendlake.sources.sinks import (
    buckets,
    export_csv,
    publish,
    publish_all,
    publish_jdbc,
    publishable,
    read_published,
    write_by_key,
    write_snapshots,
)
from trendlake.sources.snapshots import read_snapshots, read_snapshots_csv

__all__ = [
    "read_snapshots",
    "read_snapshots_csv",
    "read_results_csv",
    "buckets",
    "write_by_key",
    "write_snapshots",
    "export_csv",
    "publish",
    "publish_all",
    "publish_jdbc",
    "publishable",
    "read_published",
    "CsvFiles",
    "read_csv_files",
    "OrderedTable",
    "open_ordered",
    "write_ordered",
    "Release",
    "open_release",
    "publish_release",
    "sweep",
]
