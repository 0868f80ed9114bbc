"""Wall time and shuffle bytes of R1-R5, from Spark's event log.

usage: python scripts/shuffle_report.py [sf_dir]
The event log goes to a fresh folder under /tmp; nothing is served.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from trendlake.fixtures import trending_raw  # noqa: E402
from trendlake.operators import category_trends, clean_snapshots, top_categories, top_channels, top_videos, video_trends  # noqa: E402
from trendlake.plans.eventlog import event_log_conf, group_metrics  # noqa: E402
from trendlake.session import get_session, scratch_dir  # noqa: E402
from trendlake.sources import write_snapshots  # noqa: E402


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    logdir = tempfile.mkdtemp(prefix="trendlake-eventlog-")
    spark = get_session("local[8]", "shuffle-report", **{**event_log_conf(logdir), "spark.sql.shuffle.partitions": "8"})
    snap_path = scratch_dir(spark, "report-snap")
    write_snapshots(clean_snapshots(trending_raw(spark, sf)), snap_path)
    snap = spark.read.parquet(snap_path)
    cases = {
        "R1 top_channels": top_channels,
        "R2 top_categories": top_categories,
        "R3 top_videos": top_videos,
        "R4 category_trends": category_trends,
        "R5 video_trends": video_trends,
    }
    marks = []
    for name, op in cases.items():
        df = op(snap)
        df.write.format("noop").mode("overwrite").save()  # warm
        spark.sparkContext.setJobGroup(name, name)
        t0 = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        marks.append((name, time.perf_counter() - t0))
        spark.sparkContext.setJobGroup("", "")
    spark.stop()

    metrics = group_metrics(logdir)
    rows = [
        {
            "query": n, "seconds": round(t, 3),
            "shuffle_bytes": metrics.get(n, {}).get("shuffle_write_bytes", 0),
            "stages": metrics.get(n, {}).get("stages", 0),
        }
        for n, t in marks
    ]
    print(json.dumps({"sf": sf, "rows": rows}, indent=1))


if __name__ == "__main__":
    main()
