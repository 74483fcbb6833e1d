"""Days of a window as bits of a few integers, so that distinct days and (user, day) pairs are counted without a row for each day.

Bits are merged by OR: of a user's sessions, then of all users. The bits of a user count the days of that user; those of
all users count the days on which anybody played.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from arenalytics.functions.clock import DAY

DAYS_A_WORD = 62


def day_words(a: int, b: int) -> int:
    """Integers that the days of ``[a, b]`` take, whatever the zone."""
    return -(-(b - a + 2 * DAY) // (DAY * DAYS_A_WORD))


def marked_days(flag: Column, ts: str, a: int, b: int, offset: int, name: str) -> list[Column]:
    """Aggregates ``{name}0 …``: the days of ``ts``, in a zone, of the rows with the flag; their ``ts`` lies in ``[a, b]``."""
    day = F.floor((F.col(ts) + offset) / DAY) - (a + offset) // DAY
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(day, F.lit(DAYS_A_WORD)).cast("int"))
    return [F.bit_or(F.when(flag & (F.floor(day / DAYS_A_WORD) == k), bit)).alias(f"{name}{k}") for k in range(day_words(a, b))]


def merged_days(a: int, b: int, name: str) -> list[Column]:
    return [F.bit_or(f"{name}{k}").alias(f"{name}{k}") for k in range(day_words(a, b))]


def count_days(a: int, b: int, name: str) -> Column:
    """Days marked in the columns of one row."""
    return reduce(add, [F.coalesce(F.bit_count(f"{name}{k}").cast("bigint"), F.lit(0)) for k in range(day_words(a, b))])


def distinct_days(a: int, b: int, name: str) -> Column:
    """Aggregate: days marked in any row."""
    return reduce(add, [F.coalesce(F.bit_count(F.bit_or(f"{name}{k}")).cast("bigint"), F.lit(0)) for k in range(day_words(a, b))])


def per_day(amount: Column, days: Column) -> Column:
    """The amount over the days, cut to an integer; null without days."""
    return F.when(days > 0, amount / F.when(days > 0, days)).cast("bigint")
