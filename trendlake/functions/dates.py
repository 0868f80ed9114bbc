"""Trending-date parsing and date text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the trending-date text format of the snapshots.
TRENDING_DATE_FORMAT = "yyyy.MM.dd"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_trending_date(c: Column | str, fmt: str = TRENDING_DATE_FORMAT) -> Column:
    """Strict parse of the trending date; NULL (not an error) when it does not fit."""
    return F.try_to_date(_c(c), fmt)


def month_start_text(year: Column | str, month: Column | str) -> Column:
    """``YYYY-MM-01`` for a year and a month in 1..12, else NULL."""
    y, m = _c(year), _c(month)
    return F.when(m.between(1, 12), F.date_format(F.make_date(y, m, F.lit(1)), "yyyy-MM-dd"))


def date_part_text(c: Column | str) -> Column:
    """Date part of an ISO date/time text (before ``T``); NULL or empty -> ''."""
    s = _c(c).cast("string")
    return F.coalesce(F.substring_index(s, "T", 1), F.lit(""))


def month_label(c: Column | str) -> Column:
    """``YYYY-MM`` label of a date (or of ``YYYY-MM-DD`` text)."""
    return F.date_format(F.try_to_date(date_part_text(c), "yyyy-MM-dd"), "yyyy-MM")
