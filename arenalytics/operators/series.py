"""Clock sweeps, gap filling and the punch card."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arenalytics.functions.clock import DAY, HOUR, MINUTE, day_of_week, hour_of_day
from arenalytics.functions.ordered import running_total, with_next, with_previous


def clock_segments(sessions: DataFrame) -> DataFrame:
    """How many sessions run at each time of day: ``(start, end, sessions)`` between neighbouring clock instants.

    +1 at ``start % 24h`` and −1 at ``end % 24h``; the first segment starts at midnight with 0.
    """
    changes = sessions.select(
        F.explode(
            F.array(
                F.struct(F.pmod("session_start", F.lit(DAY)).alias("clock"), F.lit(1).alias("n")),
                F.struct(F.pmod("session_end", F.lit(DAY)).alias("clock"), F.lit(-1).alias("n")),
            )
        ).alias("c")
    ).select("c.clock", F.col("c.n").cast("bigint").alias("n"))
    levels = running_total(changes, [], "clock", {"level": "n"}, MINUTE)
    steps = with_previous(levels, [], "clock", ["level"], MINUTE)
    return steps.select(
        F.coalesce("prev.clock", F.lit(0).cast("bigint")).alias("start"),
        F.col("clock").alias("end"),
        F.coalesce("prev.level", F.lit(0).cast("bigint")).alias("sessions"),
    )


STEPS_A_PIECE = 1_000
"""Points of a gap that one row makes; a long silence is many rows, which tasks can share."""


def _points_between(gaps: DataFrame, keys: Sequence[str], first: Column, last: Column, step: int, x: str) -> DataFrame:
    """``first``, ``first + step`` … up to ``last`` of each row, in pieces: no row holds all points of a long gap."""
    wide = F.lit(step * STEPS_A_PIECE).cast("bigint")
    pieces = gaps.select(*keys, last.alias("_last"), F.explode(F.sequence(first, last, wide)).alias("_from"))
    own = F.sequence(F.col("_from"), F.least(F.col("_last"), F.col("_from") + wide - 1), F.lit(step).cast("bigint"))
    return pieces.select(*keys, F.explode(own).alias(x))


def fill_missing(points: DataFrame, keys: Sequence[str], x: str, y: str, accuracy: int, now: int, fill=0) -> DataFrame:
    """Insert ``fill`` every ``accuracy`` inside larger gaps and after the last point up to ``now``."""
    ahead = with_next(points.select(*keys, x, y), keys, x, (), 1024 * accuracy)
    until = F.coalesce(F.col(f"next.{x}"), F.lit(now).cast("bigint"))
    holes = _points_between(ahead.where(until - F.col(x) > accuracy), keys, F.col(x) + accuracy, until - 1, accuracy, x)
    return points.select(*keys, x, y).unionByName(holes.select("*", F.lit(fill).cast(points.schema[y].dataType).alias(y)))


def gap_markers(points: DataFrame, keys: Sequence[str], x: str, acceptable: int = 3 * MINUTE, first: int = MINUTE, every: int = 30 * MINUTE) -> DataFrame:
    """Null points at ``x + first``, then every ``every``, inside gaps longer than ``acceptable``."""
    ahead = with_next(points.select(*keys, x).distinct(), keys, x)
    end = F.col(f"next.{x}")
    marks = ahead.where((end - F.col(x) > acceptable) & (F.col(x) + first < end))
    return _points_between(marks, keys, F.col(x) + first, end - 1, every, x)


def punch_card(sessions: DataFrame, offset: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """168 cells (Monday = 0, hour of day) of session starts with the scaled dot size.

    Size = int(10·n/max), +4 when that is not 0.
    """
    counts = sessions.groupBy(
        *by, day_of_week("session_start", offset).alias("day"), hour_of_day("session_start", offset).alias("hour")
    ).agg(F.count("*").alias("n"))
    cells = F.explode(F.sequence(F.lit(0), F.lit(167))).alias("c")
    if by:
        spine = counts.select(*by).distinct().select(*by, cells)
    else:
        spine = sessions.sparkSession.range(1).select(cells)
    empty = spine.select(*by, F.floor(F.col("c") / 24).cast("int").alias("day"), (F.col("c") % 24).alias("hour"), F.lit(0).cast("bigint").alias("n"))
    full = counts.unionByName(empty).groupBy(*by, "day", "hour").agg(F.sum("n").alias("n"))
    size = (F.col("n") * 10.0 / F.greatest(F.max("n").over(Window.partitionBy(*by)), F.lit(1))).cast("int")
    return full.select(*by, "day", "hour", (F.col("hour") * HOUR).alias("x"), "n", F.when(size != 0, size + 4).otherwise(0).alias("z"))
