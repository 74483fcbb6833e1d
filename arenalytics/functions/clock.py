"""Epoch-millisecond arithmetic. Timestamps and durations are bigint milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR
WEEK = 7 * DAY
MONTH = 30 * DAY


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bucket(ts: str | Column, width: int, offset: int = 0) -> Column:
    """Start of the ``width``-wide bucket holding ``ts`` after a fixed zone offset."""
    shifted = col(ts) + F.lit(offset).cast("bigint")
    return shifted - F.pmod(shifted, F.lit(width).cast("bigint"))


def day(ts: str | Column, offset: int = 0) -> Column:
    return bucket(ts, DAY, offset)


def hour(ts: str | Column, offset: int = 0) -> Column:
    return bucket(ts, HOUR, offset)


def minute(ts: str | Column, offset: int = 0) -> Column:
    return bucket(ts, MINUTE, offset)


def hour_of_day(ts: str | Column, offset: int = 0) -> Column:
    shifted = col(ts) + F.lit(offset).cast("bigint")
    return F.floor(F.pmod(shifted, F.lit(DAY)) / HOUR).cast("int")


def day_of_week(ts: str | Column, offset: int = 0) -> Column:
    """Monday = 0 … Sunday = 6 (the epoch started on a Thursday)."""
    shifted = col(ts) + F.lit(offset).cast("bigint") + F.lit(3 * DAY)
    return F.floor(F.pmod(shifted, F.lit(WEEK)) / DAY).cast("int")
