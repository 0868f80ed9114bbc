"""A key holding a third of all rows must not land in one task."""

import json
import os
import subprocess
import sys

from tests.conftest import SF_SMALL

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_hot_key_is_combined_before_the_shuffle():
    out = subprocess.run(
        [sys.executable, os.path.join(ROOT, "scripts", "skew_report.py"), SF_SMALL],
        capture_output=True, text=True, timeout=600, cwd=ROOT,
    )
    assert out.returncode == 0, out.stderr[-2000:]
    report = json.loads(out.stdout.strip().splitlines()[-1])
    assert report["hot_rows"] * 3 >= report["rows"] * 0.9  # about a third is hot
    for name, stages in report["operators"].items():
        first = stages[0]
        # without map-side combining, one task would read every hot row
        assert first["max_task_records"] < report["hot_rows"] / 2, (name, first, report["hot_rows"])
