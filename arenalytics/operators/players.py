"""Unique, new and retained player counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arenalytics.functions.clock import DAY, HOUR, bucket
from arenalytics.functions.windows import contained, scope



def unique_players(sessions, a, b, servers=None, by=(), approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.countDistinct
    return scope(sessions, servers).where(contained(a, b)).groupBy(*by).agg(count("user_id").alias("players"))


def unique_players_per_bucket(sessions, a, b, width=DAY, offset=0, servers=None, by=(), approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.countDistinct
    chosen = scope(sessions, servers).where(contained(a, b))
    return chosen.groupBy(*by, bucket("session_start", width, offset).alias("date")).agg(count("user_id").alias("players"))


PERIODS = {"hour": HOUR, "day": DAY, "week": 7 * DAY, "month": 30 * DAY}


def unique_cells(sessions, a, b, offset=0, servers=None, by=(), user: str = "user_id") -> DataFrame:
    """Cells (by, hour, part, users): who started a session in an hour, as bitmaps over 32,768 user numbers each.

    ``user`` numbers users densely from 0 or 1, as ids do. Cells can be stored, and cells of later sessions be added: bitmaps are
    merged by OR, so uniques of any longer period need no session again.
    """
    chosen = scope(sessions, servers).where(contained(a, b))
    return chosen.groupBy(*by, bucket("session_start", HOUR, offset).alias("hour"), F.bitmap_bucket_number(user).alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(user)).alias("users")
    )


def unique_rollup(cells: DataFrame, periods: dict[str, int] = PERIODS, by=()) -> DataFrame:
    """(by, period, date, players): exact unique users of every period that the cells hold, from one pass over them."""
    starts = F.explode(F.array(*[F.struct(F.lit(name).alias("period"), bucket("hour", width).alias("date")) for name, width in periods.items()]))
    merged = cells.select(*by, "part", "users", starts.alias("p")).groupBy(*by, "p.period", "p.date", "part").agg(F.bitmap_or_agg("users").alias("users"))
    return merged.groupBy(*by, "period", "date").agg(F.sum(F.bitmap_count("users")).alias("players"))


def average_unique_players(sessions, a, b, offset=0, servers=None, by=()) -> DataFrame:
    per_day = unique_players_per_bucket(sessions, a, b, DAY, offset, servers, by)
    return per_day.groupBy(*by).agg(F.avg("players").alias("average_players"))


def registered_between(registrations, a, b, servers=None) -> DataFrame:
    """Rows of ``users`` or ``user_info`` with a register date in the closed window."""
    return (scope(registrations, servers) if servers else registrations).where(F.col("registered").between(a, b))


def new_players(registrations, a, b, servers=None, by=()) -> DataFrame:
    return registered_between(registrations, a, b, servers).groupBy(*by).agg(F.count("*").alias("players"))


def new_players_per_bucket(registrations, a, b, width=DAY, offset=0, servers=None, by=()) -> DataFrame:
    chosen = registered_between(registrations, a, b, servers)
    return chosen.groupBy(*by, bucket("registered", width, offset).alias("date")).agg(F.count("*").alias("players"))


def average_new_players(registrations, a, b, offset=0, servers=None, by=(), user="user_id") -> DataFrame:
    """Mean of the per-day counts of distinct new users."""
    chosen = registered_between(registrations, a, b, servers)
    per_day = chosen.groupBy(*by, bucket("registered", DAY, offset).alias("date")).agg(F.countDistinct(user).alias("players"))
    return per_day.groupBy(*by).agg(F.avg("players").alias("average_players"))


def retained_players(user_info, sessions, a, b, servers=None, by=()) -> DataFrame:
    """Distinct users registered in ``[a, b]`` on a server and seen there in the second half of the window."""
    half = b - (b - a) // 2
    fresh = registered_between(user_info, a, b, servers).select("user_id", "server_id")
    late = sessions.where(contained(half, b)).select("user_id", "server_id")
    return fresh.join(late, ["user_id", "server_id"], "left_semi").groupBy(*by).agg(F.countDistinct("user_id").alias("players"))


def operator_count(user_info, by=("server_id",)) -> DataFrame:
    return user_info.groupBy(*by).agg(F.count_if("opped").alias("operators"))


def user_counts(user_info, by=()) -> DataFrame:
    return user_info.groupBy(*by).agg(F.countDistinct("user_id").alias("users"))


def first_register_date(users) -> DataFrame:
    return users.agg(F.min("registered").alias("registered"))


def register_dates(user_info, a, b, servers=None) -> DataFrame:
    return registered_between(user_info, a, b, servers).select("user_id", "server_id", "registered")


def new_per_day_filled(registrations, now: int, offset: int = 0) -> DataFrame:
    """New users per day with 0 for empty days between the first day and the day of ``now`` (exclusive)."""
    counts = registrations.groupBy(bucket("registered", DAY, offset).alias("date")).agg(F.count("*").alias("players"))
    first = counts.agg(F.min("date").alias("first"))
    last = now - now % DAY - DAY
    spine = first.where(F.col("first") <= last).select(
        F.explode(F.sequence("first", F.lit(last).cast("bigint"), F.lit(DAY).cast("bigint"))).alias("date"), F.lit(0).alias("players")
    )
    return counts.unionByName(spine).groupBy("date").agg(F.sum("players").alias("players"))
