"""ISO-8601 times in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = r"^\d{4}-\d{2}-\d{2}$"


def parse_time(text: Column) -> Column:
    """A timestamp from ISO-8601; a time without zone is UTC; null if it can't be read."""
    return F.try_to_timestamp(F.trim(text))


def start_of(bound: str | None) -> Column:
    """Lower bound; a bare date is its first microsecond."""
    return F.to_timestamp(F.lit(bound))


def end_of(bound: str | None) -> Column:
    """Upper bound; a bare date is its last microsecond."""
    t = F.to_timestamp(F.lit(bound))
    return F.when(F.lit(bound).rlike(DAY), t + F.expr("INTERVAL 1 DAY") - F.expr("INTERVAL 1 MICROSECOND")).otherwise(t)


def in_range(time: Column, start: str | None, end: str | None) -> Column:
    """Inclusive; an unknown time passes only if no bound is given."""
    out = F.lit(True)
    if start is not None:
        out = out & F.coalesce(time >= start_of(start), F.lit(False))
    if end is not None:
        out = out & F.coalesce(time <= end_of(end), F.lit(False))
    return out


def compact_time(day: Column, clock: Column) -> Column:
    """yyyyMMdd and HHmmss without leading zeros."""
    return F.to_timestamp(F.concat(day.cast("string"), F.lpad(clock.cast("string"), 6, "0")), "yyyyMMddHHmmss")
