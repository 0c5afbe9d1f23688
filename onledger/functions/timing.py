"""Time scalars on epoch seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor_to(ts: Column, width: int) -> Column:
    return (F.floor(ts / width) * width).cast("bigint")


def last_closed_start(ts: Column, width: int = 60) -> Column:
    """Start of the newest interval that is over at ``ts``."""
    return floor_to(ts, width) - width


def ceil_second(ts: Column) -> Column:
    return F.ceil(ts).cast("bigint")


def iso_utc(ts: Column) -> Column:
    return F.date_format(F.timestamp_seconds(ts), "yyyy-MM-dd'T'HH:mm:ss")


def day(ts: Column) -> Column:
    return F.date_format(F.timestamp_seconds(ts), "yyyy-MM-dd")


def month(ts: Column) -> Column:
    return F.date_format(F.timestamp_seconds(ts), "yyyy-MM")


def age(now: Column, ts: Column) -> Column:
    return now - ts
