"""Hot-key check: one (video, country, category, channel) holds a third of all
snapshot rows.  For each operator, report the largest number of shuffle
records any single task reads.  With map-side combining that stays near the
number of map tasks per key instead of a third of the input.

usage: python scripts/skew_report.py [sf_dir]   (prints one JSON object)
"""

from __future__ import annotations

import json
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from trendlake.fixtures import trending_raw  # noqa: E402
from trendlake.operators import (  # noqa: E402
    category_trends,
    clean_snapshots,
    top_categories,
    top_channels,
    top_videos,
    video_trends,
)
from trendlake.plans.eventlog import event_log_conf, group_metrics  # noqa: E402
from trendlake.session import get_session, scratch_dir  # noqa: E402
from trendlake.sources import write_snapshots  # noqa: E402


def hot_snapshots(raw):
    """Every third row (by a hash of its identity) becomes the same hot video."""
    hot = (F.abs(F.hash("video_id", "video_trending__date", "channel_id", "video_title")) % 3) == 0
    return raw.withColumns(
        {
            "video_id": F.when(hot, F.lit("HOT")).otherwise(F.col("video_id")),
            "video_trending_country": F.when(hot, F.lit("HOTLAND")).otherwise(F.col("video_trending_country")),
            "video_category_id": F.when(hot, F.lit("HotCat")).otherwise(F.col("video_category_id")),
            "channel_title": F.when(hot, F.lit("HotChannel")).otherwise(F.col("channel_title")),
        }
    )


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    logdir = tempfile.mkdtemp(prefix="trendlake-skewlog-")
    spark = get_session(
        "local[8]", "skew-report",
        **{
            **event_log_conf(logdir),
            "spark.sql.shuffle.partitions": "16",
            "spark.sql.files.maxPartitionBytes": "1m",  # several map tasks even on small input
            "spark.sql.adaptive.coalescePartitions.enabled": "false",
        },
    )
    path = scratch_dir(spark, "hot-snap")
    write_snapshots(clean_snapshots(hot_snapshots(trending_raw(spark, sf))).repartition(16), path)
    snap = spark.read.parquet(path)
    total = snap.count()
    hot_rows = snap.filter(F.col("video_id") == "HOT").count()
    ops = {
        "top_channels": top_channels,
        "top_categories": top_categories,
        "top_videos": top_videos,
        "category_trends": category_trends,
        "video_trends": video_trends,
    }
    for name, op in ops.items():
        spark.sparkContext.setJobGroup(name, name)
        op(snap).write.format("noop").mode("overwrite").save()
    spark.sparkContext.setJobGroup("", "")
    spark.stop()

    metrics = group_metrics(logdir)
    report = {"sf": sf, "rows": total, "hot_rows": hot_rows, "operators": {}}
    for name in ops:
        per_stage = metrics.get(name, {}).get("max_task_records", {})
        report["operators"][name] = [
            {"stage": sid, "max_task_records": n} for sid, n in sorted(per_stage.items()) if n
        ]
    report["max_task_records_any_stage"] = max(
        (s["max_task_records"] for v in report["operators"].values() for s in v), default=0
    )
    print(json.dumps(report))


if __name__ == "__main__":
    main()
