"""Date arithmetic on ``timestamp_ntz`` columns, free of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def days(n: int) -> Column:
    """An interval of ``n`` days; adding it keeps the time of day."""
    return F.expr(f"INTERVAL '{n}' DAY")


def months(n: int | Column) -> Column:
    """An interval of ``n`` months; adding it clamps to the month's last day."""
    return F.make_ym_interval(F.lit(0), F.lit(n) if isinstance(n, int) else n)


def years(n: int | Column) -> Column:
    return F.make_ym_interval(F.lit(n) if isinstance(n, int) else n, F.lit(0))


def midnight(ts: Column) -> Column:
    return ts.cast("date").cast("timestamp_ntz")


def month_floor(ts: Column) -> Column:
    """Start of the month. ``trunc`` yields a DATE, so no zone conversion happens."""
    return F.trunc(ts, "month").cast("timestamp_ntz")


def month_ceil(ts: Column) -> Column:
    """First month start at or after ``ts``."""
    floor = month_floor(ts)
    return F.when(floor == ts, floor).otherwise(floor + months(1))


def half_day(ts: Column) -> Column:
    """Midnight for midnight values and noon for any later time of the same day.

    Every comparison with a midnight boundary gives the same answer as ``ts``
    itself, and a customer has at most two distinct values per day.
    """
    start = midnight(ts)
    return F.when(ts == start, start).otherwise(start + F.expr("INTERVAL '12' HOUR"))


def month_starts(first: Column, last: Column) -> Column:
    """Array of month starts from ``first`` to ``last``; NULL if the range is empty."""
    return F.when(first <= last, F.sequence(first, last, F.expr("INTERVAL '1' MONTH")))


def day_diff(start: Column, end: Column) -> Column:
    """Calendar-day boundaries crossed from ``start`` to ``end``."""
    return F.datediff(end, start)


def parse_timestamp(text: Column) -> Column:
    """NULL where the text is not a timestamp."""
    return text.try_cast("timestamp_ntz")


def timestamp_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
