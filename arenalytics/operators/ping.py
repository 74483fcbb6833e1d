"""Latency measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arenalytics.functions.clock import DAY, MINUTE, bucket
from arenalytics.functions.ordered import interval_sums
from arenalytics.functions.windows import scope, valid_ping
from arenalytics.operators.geo import latest_geolocations


def average_ping(ping, a, b, servers=None, by=()) -> DataFrame:
    return scope(ping, servers).where(F.col("date").between(a, b)).groupBy(*by).agg(
        F.coalesce(F.avg("avg_ping"), F.lit(-1.0)).alias("average_ping")
    )


def valid(ping, column: str = "avg_ping") -> DataFrame:
    return ping.where(valid_ping(column))


def by_geolocation(ping, geolocations, servers=None, by=()) -> DataFrame:
    """Lowest, highest and mean ping of the users whose latest geolocation it is.

    Pings are reduced per user before the join, so the join sees one row per user.
    """
    per_user = scope(ping, servers).groupBy(*by, "user_id").agg(
        F.min("min_ping").alias("lo"), F.max("max_ping").alias("hi"), F.sum("avg_ping").alias("s"), F.count("avg_ping").alias("n")
    )
    located = per_user.join(latest_geolocations(geolocations), "user_id")
    return located.groupBy(*by, "geolocation").agg(
        F.min("lo").alias("min_ping"), F.max("hi").alias("max_ping"), (F.sum("s") / F.sum("n")).cast("bigint").alias("avg_ping")
    )


def rollup(ping, width: int = MINUTE, servers=None, by=()) -> DataFrame:
    """Per minute: lowest and highest ping in range and the mean of the means in range, −1 without one."""

    def ok(c: str):
        return F.when(valid_ping(c), F.col(c))

    return scope(ping, servers).groupBy(*by, bucket("date", width).alias("date")).agg(
        F.coalesce(F.min(ok("min_ping")), F.lit(-1)).alias("min_ping"),
        F.coalesce(F.max(ok("max_ping")), F.lit(-1)).alias("max_ping"),
        F.coalesce(F.avg(ok("avg_ping")), F.lit(-1.0)).alias("avg_ping"),
    )


def series(ping, a, b, servers=None, user_id: int | None = None) -> DataFrame:
    chosen = scope(ping, servers).where(F.col("date").between(a, b))
    chosen = chosen if user_id is None else chosen.where(F.col("user_id") == user_id)
    return chosen.select("user_id", "server_id", "date", "min_ping", "max_ping", "avg_ping").orderBy("date", "user_id")


def per_country(ping, geolocations, server_id: int) -> DataFrame:
    """Every ping of a server with the user's latest geolocation."""
    return ping.where(F.col("server_id") == server_id).join(latest_geolocations(geolocations), "user_id")


def per_session(sessions, ping) -> DataFrame:
    """Mean ping measured with ``start <= date < end`` on the session's server; sessions without one are absent."""
    exact = F.col("avg_ping").cast("decimal(20,6)")
    sums = interval_sums(
        ping, sessions.where(F.col("session_end") >= F.col("session_start")), ["user_id", "server_id"], "date",
        {"total": exact, "n": F.lit(1).cast("bigint")}, "id", "session_start", "session_end", DAY,
    )
    return sums.where(F.col("n") > 0).select("id", (F.col("total").cast("double") / F.col("n")).alias("average_ping"))
