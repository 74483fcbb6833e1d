"""World times and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arenalytics.functions.windows import contained, length, overlap, scope

MODES = ["survival", "creative", "adventure", "spectator"]


def _sums():
    return [F.sum(f"{m}_time").alias(m) for m in MODES]


def _of_sessions(world_times, sessions, condition) -> DataFrame:
    ids = sessions.where(condition).select(F.col("id").alias("session_id"))
    return world_times.join(ids, "session_id", "left_semi")


def world_totals(world_times, worlds, sessions=None, a=None, b=None, servers=None, by=()) -> DataFrame:
    """Time per world and mode, of sessions overlapping the window when one is given."""
    chosen = scope(world_times, servers)
    if sessions is not None:
        chosen = _of_sessions(chosen, sessions, overlap(a, b))
    per_id = chosen.groupBy(*by, "world_id").agg(*_sums())
    named = per_id.join(worlds.select(F.col("id").alias("world_id"), "world_name"), "world_id")
    return named.groupBy(*by, "world_name").agg(*[F.sum(m).alias(m) for m in MODES])


def mode_totals(world_times, sessions, a, b, servers=None, by=()) -> DataFrame:
    """Time per mode of the sessions inside the window."""
    return _of_sessions(scope(world_times, servers), sessions, contained(a, b)).groupBy(*by).agg(*_sums())


def total_per_world(totals: DataFrame, by=()) -> DataFrame:
    return totals.select(*by, "world_name", sum((F.col(m) for m in MODES[1:]), F.col(MODES[0])).alias("total"))


def by_mode(totals: DataFrame, by=()) -> DataFrame:
    """Long form ``(by…, mode, time)`` summed over worlds."""
    pairs = ", ".join(f"'{m.upper()}', {m}" for m in MODES)
    return totals.groupBy(*by).agg(*[F.sum(m).alias(m) for m in MODES]).selectExpr(*by, f"stack({len(MODES)}, {pairs}) as (mode, time)")


def most_used_mode(totals: DataFrame, by=()) -> DataFrame:
    """The mode with the greatest time above 0, the first in mode order on ties."""
    sums = totals.groupBy(*by).agg(*[F.sum(m).alias(m) for m in MODES])
    top = F.greatest(*[F.col(m) for m in MODES])
    pick = F.coalesce(*[F.when((F.col(m) == top) & (top > 0), F.lit(m.upper())) for m in MODES])
    return sums.select(*by, pick.alias("mode"))


def most_played_world(totals: DataFrame, by=()) -> DataFrame:
    """Per group the world with the greatest total, the first name on ties."""
    best = F.min_by("world_name", F.struct(-F.col("total"), F.col("world_name")))
    return total_per_world(totals, by).where(F.col("total") > 0).groupBy(*by).agg(best.alias("world_name"))


def world_pie(totals: DataFrame, aliases: DataFrame | None = None, by=()) -> DataFrame:
    """Slices per world alias with their mode breakdown; empty slices are dropped.

    ``aliases`` has (world_name, alias); worlds without one keep their name.
    """
    named = totals if aliases is None else totals.join(aliases, "world_name", "left")
    alias = F.col("world_name") if aliases is None else F.coalesce("alias", "world_name")
    sums = named.groupBy(*by, alias.alias("name")).agg(*[F.sum(m).alias(m) for m in MODES])
    total = sum((F.col(m) for m in MODES[1:]), F.col(MODES[0]))
    drilldown = F.array(*[F.struct(F.lit(m.upper()).alias("mode"), F.col(m).alias("time")) for m in MODES])
    return sums.select(*by, "name", total.alias("total"), drilldown.alias("drilldown")).where(F.col("total") != 0)


def favourite_server(sessions) -> DataFrame:
    """Per user the server with the greatest playtime, the smallest id on ties."""
    played = sessions.groupBy("user_id", "server_id").agg(F.sum(length()).alias("playtime"))
    best = F.max_by("server_id", F.struct(F.col("playtime"), -F.col("server_id")))
    return played.groupBy("user_id").agg(best.alias("server_id"))


def statistic_values(statistic, values, by) -> DataFrame:
    """Sums of the statistic values per statistic name and ``by``."""
    sums = values.groupBy(*by, "statistic_id").agg(F.sum("value").alias("value"))
    return sums.join(statistic.select(F.col("id").alias("statistic_id"), "name"), "statistic_id").select(*by, "name", "value")
