"""Physical-plan text for plan tests and for reading plans while tuning."""

from __future__ import annotations

import contextlib
import io
import re

from pyspark.sql import DataFrame


def physical_plan(df: DataFrame, mode: str = "formatted") -> str:
    """The text that ``df.explain(mode)`` prints (the query is not run)."""
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode=mode)
    return buf.getvalue()


def plan_nodes(df: DataFrame) -> list[str]:
    """Operator names of the physical plan, top-down (AQE initial plan)."""
    names = []
    for line in physical_plan(df, "simple").splitlines():
        m = re.match(r"^[\s:+\-*()0-9]*([A-Z][A-Za-z]+)", line)
        if m:
            names.append(m.group(1))
    return names
