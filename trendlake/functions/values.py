"""Numbers from loosely typed result columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendlake.functions.text import js_trim


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_number(c: Column | str) -> Column:
    """NULL or '' -> NULL; text or number -> double; NaN / infinite -> NULL."""
    s = js_trim(_c(c).cast("string"))
    d = F.when(F.length(s) > 0, s.try_cast("double"))
    return F.when(~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))), d)


def first_present(df: DataFrame, candidates: Sequence[str]) -> Column:
    """F16: first non-NULL among the candidate columns that exist in ``df``."""
    present = [F.col(c) for c in candidates if c in df.columns]
    if not present:
        return F.lit(None)
    return present[0] if len(present) == 1 else F.coalesce(*present)


def number_or_zero(c: Column | str) -> Column:
    """the value as a number, or 0 when missing, non-numeric or NaN."""
    return F.coalesce(to_number(c), F.lit(0.0))
