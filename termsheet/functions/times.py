"""ISO-text time helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def wall_clock(c: Column) -> Column:
    """ISO text as a zone-less timestamp; null where it is not a timestamp."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$"), c.try_cast("timestamp_ntz"))


def week_label(ts: Column) -> Column:
    """``YYYY-Www`` with Monday weeks counted from the year's first Monday (week 00 before it)."""
    week = F.floor((F.dayofyear(ts) - 1 + 7 - F.weekday(ts)) / 7)
    return F.concat(F.date_format(ts, "yyyy"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))


def bucket_label(ts: Column, granularity: str) -> Column:
    """Day, week or month label of a timestamp column."""
    labels = {"day": lambda t: F.date_format(t, "yyyy-MM-dd"), "month": lambda t: F.date_format(t, "yyyy-MM"),
              "week": week_label}
    if granularity not in labels:
        raise ValueError(f"granularity must be day, week or month, not {granularity!r}")
    return labels[granularity](ts)


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", wall_clock(start), wall_clock(end)) / 1e6
