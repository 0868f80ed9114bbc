"""Benchmark: headline operators at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line.  Stages timed:

* ``clean_snapshots`` -- driver tables -> trending snapshots -> cleaned Parquet
  (written once to the shared checkpoint location, as the product does);
* ``sighting_summary`` -- cleaned snapshots -> sighting summary Parquet;
* R1-R5 over the summary, each run to completion with the ``noop`` sink;
* ``publish_all`` -- the five result tables (from the summary) to
  partitioned Parquet;
* country lookups (R6/R7) against the published tables.

``direct_from_snapshots`` reports R1-R5 run straight on the cleaned table
(same rows; not part of ``value``).

Each query runs once to warm the JVM, then ``BENCH_REPEAT`` (default 5) times;
the median is reported.  ``value`` is the sum of the medians.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from trendlake.fixtures import trending_raw  # noqa: E402
from trendlake.operators import (  # noqa: E402
    category_trends,
    clean_snapshots,
    sighting_summary,
    top_categories,
    top_channels,
    top_videos,
    video_trends,
)
from trendlake.operators.lookups import country_category_trends, country_top  # noqa: E402
from trendlake.plans.eventlog import event_log_conf, group_metrics  # noqa: E402
from trendlake.session import get_session, scratch_dir  # noqa: E402
from trendlake.sources.sinks import publish_all, write_snapshots  # noqa: E402


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


_SPARK = None


def timed(fn, repeat: int, group: str | None = None) -> float:
    """Median wall time of ``repeat`` runs after one warm-up run.  The timed
    runs are tagged with ``group`` so their shuffle volume can be read back
    from the event log."""
    fn()
    runs = []
    if group and _SPARK is not None:
        _SPARK.sparkContext.setJobGroup(group, group)
    for _ in range(repeat):
        t0 = time.perf_counter()
        fn()
        runs.append(time.perf_counter() - t0)
    if group and _SPARK is not None:
        _SPARK.sparkContext.setJobGroup("", "")
    return statistics.median(runs)


def _stages(spark, sf_dir: str, repeat: int, q: dict, info: dict) -> None:
    snap_path = scratch_dir(spark, "snapshots")
    q["clean_snapshots"] = timed(
        lambda: write_snapshots(clean_snapshots(trending_raw(spark, sf_dir)), snap_path), repeat, "clean_snapshots"
    )
    snap = spark.read.parquet(snap_path)
    summary_path = scratch_dir(spark, "summary")
    q["sighting_summary"] = timed(
        lambda: write_snapshots(sighting_summary(snap), summary_path), repeat, "sighting_summary"
    )
    summary = spark.read.parquet(summary_path)
    ops = {
        "top_channels": top_channels,
        "top_categories": top_categories,
        "top_videos": top_videos,
        "category_trends": category_trends,
        "video_trends": video_trends,
    }
    for name, op in ops.items():
        q[name] = timed(lambda op=op: run(op(summary)), repeat, name)
    direct = {name: timed(lambda op=op: run(op(snap)), repeat) for name, op in ops.items()}

    pub = scratch_dir(spark, "published")
    tables = {
        "top10_channels_per_country": top_channels(summary),
        "top10_categories_per_country": top_categories(summary),
        "top10_videos_per_country": top_videos(summary),
        "category_trends_over_time": category_trends(summary),
        "video_trends_over_time": video_trends(summary),
    }
    q["publish_all"] = timed(lambda: publish_all(tables, pub), repeat, "publish_all")
    country = snap.select("video_trending_country").where("video_trending_country is not null").first()[0]
    published = {n: spark.read.parquet(f"{pub}/{n}") for n in tables}
    q["country_lookups"] = timed(
        lambda: [
            run(country_top(published["top10_channels_per_country"], country)),
            run(country_top(published["top10_categories_per_country"], country)),
            run(country_top(published["top10_videos_per_country"], country)),
            run(country_category_trends(published["category_trends_over_time"], country)),
        ],
        repeat,
        "country_lookups",
    )
    rows = spark.read.parquet(snap_path).count()
    summary_rows = summary.count()
    info["snapshot_rows"] = rows
    info["summary_rows"] = summary_rows
    info["direct_from_snapshots"] = {k: round(v, 3) for k, v in direct.items()}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "5"))
    parts = os.environ.get("BENCH_SHUFFLE_PARTITIONS", cpus)
    logdir = tempfile.mkdtemp(prefix="trendlake-bench-eventlog-")
    spark = get_session(
        f"local[{cpus}]", "trendlake-bench", **{"spark.sql.shuffle.partitions": parts, **event_log_conf(logdir)}
    )
    global _SPARK
    _SPARK = spark

    q: dict[str, float] = {}
    info: dict[str, object] = {}
    try:
        _stages(spark, sf_dir, repeat, q, info)
    except Exception as e:  # noqa: BLE001 - report what ran; never lose the JSON line
        info["error"] = f"{type(e).__name__}: {e}"[:500]
    spark.stop()
    try:
        metrics = group_metrics(logdir)
        shuffle_mb = {k: round(metrics[k]["shuffle_write_bytes"] / repeat / 2**20, 2) for k in q if k in metrics}
    except Exception:  # noqa: BLE001 - measurement only; never lose the timing line
        shuffle_mb = {}
    print(
        json.dumps(
            {
                "metric": "trendlake_headline_total",
                "value": round(sum(q.values()), 3),
                "unit": "sec",
                "queries": {k: round(v, 3) for k, v in q.items()},
                "sf": os.path.basename(sf_dir).replace("sf", ""),
                **info,
                "shuffle_write_mb_per_run": shuffle_mb,
                "cpus": int(cpus),
                "repeat": repeat,
            }
        )
    )


if __name__ == "__main__":
    main()
