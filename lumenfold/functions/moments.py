"""Column expressions on instants, windows and validity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "America/New_York"


def cutoff(day: Column, zone: str = ZONE) -> Column:
    """The instant of 05:30 local time that closes the brief of ``day``."""
    local = F.to_timestamp(F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" 05:30:00")))
    return F.to_utc_timestamp(local, zone)


def brief_date(moment: Column, zone: str = ZONE) -> Column:
    """The date whose window (start, end] holds the moment."""
    local = F.from_utc_timestamp(moment, zone)
    day = F.to_date(local)
    return F.when(moment <= cutoff(day, zone), day).otherwise(F.date_add(day, 1))


def local_date(moment: Column, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(moment, zone))


def valid_at(valid_from: Column, valid_to: Column, day: Column) -> Column:
    """Open ends are unbounded; a null day isn't filtered."""
    return day.isNull() | ((valid_from.isNull() | (valid_from <= day)) & (valid_to.isNull() | (day <= valid_to)))


def span_hours(first: Column, last: Column) -> Column:
    return F.greatest(F.lit(1.0), (F.unix_micros(last) - F.unix_micros(first)) / 3.6e9)


def is_stale(seen: Column, today: Column, most_days: int) -> Column:
    return seen.isNull() | (F.datediff(today, seen) > most_days)
