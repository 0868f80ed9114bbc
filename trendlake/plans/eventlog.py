"""Per-job-group task metrics from Spark's event log (for local measurement).

Enable with ``spark.eventLog.enabled=true``, ``spark.eventLog.dir=<scratch>``
and ``spark.eventLog.compress=false``; tag work with
``sparkContext.setJobGroup(name, name)``; read after ``spark.stop()``.
"""

from __future__ import annotations

import glob
import json
import os
from collections import defaultdict


def event_log_conf(logdir: str) -> dict[str, str]:
    return {"spark.eventLog.enabled": "true", "spark.eventLog.dir": logdir, "spark.eventLog.compress": "false"}


def group_metrics(logdir: str) -> dict[str, dict]:
    """For each job group: stages, tasks, shuffle bytes written / read, and per
    stage the largest number of shuffle records one task read."""
    stage_group: dict[int, str | None] = {}
    out: dict[str, dict] = defaultdict(
        lambda: {"stages": set(), "tasks": 0, "shuffle_write_bytes": 0, "shuffle_read_bytes": 0, "max_task_records": {}}
    )
    files = sorted(p for p in glob.glob(os.path.join(logdir, "**", "*"), recursive=True) if os.path.isfile(p))
    for path in files:
        with open(path) as f:
            for line in f:
                e = json.loads(line)
                ev = e.get("Event")
                if ev == "SparkListenerJobStart":
                    g = (e.get("Properties") or {}).get("spark.jobGroup.id")
                    for s in e.get("Stage IDs", []):
                        stage_group[s] = g
                elif ev == "SparkListenerTaskEnd":
                    g = stage_group.get(e.get("Stage ID"))
                    if not g:
                        continue
                    m = e.get("Task Metrics") or {}
                    w = m.get("Shuffle Write Metrics") or {}
                    r = m.get("Shuffle Read Metrics") or {}
                    rec = out[g]
                    rec["stages"].add(e["Stage ID"])
                    rec["tasks"] += 1
                    rec["shuffle_write_bytes"] += w.get("Shuffle Bytes Written", 0)
                    rec["shuffle_read_bytes"] += r.get("Remote Bytes Read", 0) + r.get("Local Bytes Read", 0)
                    n = r.get("Total Records Read", 0)
                    rec["max_task_records"][e["Stage ID"]] = max(rec["max_task_records"].get(e["Stage ID"], 0), n)
    return {g: {**v, "stages": len(v["stages"])} for g, v in out.items()}
