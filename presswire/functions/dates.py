"""Date windows over `YYYYMMDD` strings and 14-digit timestamps.

Bounds are computed from an explicit `as_of`, so they reach the scan as literals
and prune day partitions.
"""

from __future__ import annotations

import calendar
import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F


def day_key(day: dt.date) -> str:
    return day.strftime("%Y%m%d")


def days_before(as_of: dt.date, days: int) -> str:
    return day_key(as_of - dt.timedelta(days=days))


def filter_recent(events: DataFrame, as_of: dt.date, days: int) -> DataFrame:
    """Events dated at most `days` days before `as_of` (0 keeps today onwards)."""
    return events.filter(F.col("DATE") >= days_before(as_of, days))


def calendar_week(as_of: dt.date, which: str) -> tuple[str, str]:
    """Monday and Sunday of the `current` or `previous` week."""
    shift = {"current": 0, "previous": 7}[which]
    monday = as_of - dt.timedelta(days=as_of.weekday() + shift)
    return day_key(monday), day_key(monday + dt.timedelta(days=6))


def calendar_month(as_of: dt.date, month: int) -> tuple[str, str]:
    """First and last day of `month`; a month after as_of's belongs to last year."""
    year = as_of.year - 1 if month > as_of.month else as_of.year
    last = calendar.monthrange(year, month)[1]
    return day_key(dt.date(year, month, 1)), day_key(dt.date(year, month, last))


def between_days(lo: str, hi: str) -> Column:
    return (F.col("DATE") >= lo) & (F.col("DATE") <= hi)


def filter_calendar_week(events: DataFrame, as_of: dt.date, which: str = "previous") -> DataFrame:
    return events.filter(between_days(*calendar_week(as_of, which)))


def filter_calendar_month(events: DataFrame, as_of: dt.date, month: int) -> DataFrame:
    return events.filter(between_days(*calendar_month(as_of, month)))


def hour_floor_cutoff(as_of: dt.datetime, hours: int = 24) -> int:
    """`as_of` minus `hours`, floored to the hour, as YYYYMMDDHHMMSS."""
    return int((as_of - dt.timedelta(hours=hours)).strftime("%Y%m%d%H0000"))


def gkg_day_cutoff(as_of: dt.date, days: int) -> int:
    """Midnight `days` days before `as_of` as YYYYMMDDHHMMSS."""
    return int((as_of - dt.timedelta(days=days)).strftime("%Y%m%d000000"))


def gkg_day(date_column: Column) -> Column:
    """Leading `YYYYMMDD` of a 14-digit timestamp number."""
    return F.substring(date_column.cast("string"), 1, 8)


def since_cutoff(gkg: DataFrame, cutoff: int) -> DataFrame:
    """Rows at or after a 14-digit cutoff; prunes `DATE_KEY` partitions when present."""
    kept = gkg.filter(F.col("DATE") >= F.lit(cutoff))
    if "DATE_KEY" in gkg.columns:
        kept = kept.filter(F.col("DATE_KEY") >= str(cutoff)[:8])
    return kept
