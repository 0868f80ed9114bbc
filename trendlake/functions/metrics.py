"""engagement rating."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def engagement_rating(views: Column | str, likes: Column | str, comments: Column | str) -> Column:
    """``round((likes + comments) / views * 100, 4)`` for positive views, else 0.0.

    Missing likes or comments count as 0; NULL or non-positive views give 0.0.
    """
    v, lk, cm = (F.col(c) if isinstance(c, str) else c for c in (views, likes, comments))
    ratio = (F.coalesce(lk, F.lit(0)) + F.coalesce(cm, F.lit(0))) / v * 100
    return F.when(v > 0, F.round(ratio, 4)).otherwise(F.lit(0.0))
