"""Joins between facts: session assembly, as-of lookups, latest rows, set membership."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arenalytics.functions.clock import HOUR, bucket
from arenalytics.functions.ordered import last_known


def with_dimensions(sessions, users, servers, join_address) -> DataFrame:
    """Sessions with the natural keys of user, server and join address."""
    return (
        sessions.join(users.select(F.col("id").alias("user_id"), F.col("uuid").alias("user_uuid"), F.col("name").alias("user_name")), "user_id")
        .join(servers.select(F.col("id").alias("server_id"), F.col("uuid").alias("server_uuid"), F.col("name").alias("server_name")), "server_id")
        .join(join_address.select(F.col("id").alias("join_address_id"), "join_address"), "join_address_id")
    )


def session_worlds(world_times, worlds) -> DataFrame:
    """Per session a map world → struct of the four mode times; a session has as many entries as worlds."""
    modes = F.struct(*[F.sum(f"{m}_time").alias(m) for m in ("survival", "creative", "adventure", "spectator")])
    named = world_times.join(worlds.select(F.col("id").alias("world_id"), "world_name"), "world_id")
    per_world = named.groupBy("session_id", "world_name").agg(modes.alias("modes"))
    entries = F.sort_array(F.collect_list(F.struct("world_name", "modes")))
    return per_world.groupBy("session_id").agg(F.map_from_entries(entries).alias("world_times"))


def session_kills(kills, users) -> DataFrame:
    """The kills of each session, one row per kill, with both names (null when unknown)."""
    killer = users.select(F.col("uuid").alias("killer_uuid"), F.col("name").alias("killer_name"))
    victim = users.select(F.col("uuid").alias("victim_uuid"), F.col("name").alias("victim_name"))
    return kills.join(killer, "killer_uuid", "left").join(victim, "victim_uuid", "left").select(
        "session_id", "date", "weapon", "killer_uuid", "killer_name", "victim_uuid", "victim_name"
    )


def assemble_sessions(sessions, users, servers, join_address, world_times, worlds, kills) -> DataFrame:
    """Sessions with natural keys, world times and kill count. Children are reduced before they are joined."""
    counts = kills.groupBy("session_id").agg(F.count("*").alias("player_kills"))
    return (
        with_dimensions(sessions, users, servers, join_address)
        .join(session_worlds(world_times, worlds).withColumnRenamed("session_id", "id"), "id", "left")
        .join(counts.withColumnRenamed("session_id", "id"), "id", "left")
        .withColumn("player_kills", F.coalesce("player_kills", F.lit(0).cast("bigint")))
    )


def latest_rows(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Every row that holds the greatest ``order`` of its keys."""
    newest = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("_r", F.rank().over(newest)).where(F.col("_r") == 1).drop("_r")


def online_states(samples) -> DataFrame:
    """One player count per server and instant, that of the sample with the greatest id."""
    return samples.groupBy("server_id", "date").agg(F.max_by("players_online", "id").alias("players_online"))


def online_on(samples, instants: DataFrame) -> DataFrame:
    """As-of: for every distinct ``(server_id, date)`` the newest sample's player count and age."""
    found = last_known(online_states(samples), instants, ["server_id"], "date", "players_online")
    return found.withColumn("age", F.col("date") - F.col("state_ts")).drop("state_ts")


def lonely_joins(sessions, samples, by=("server_id",)) -> DataFrame:
    """Joins that found nobody online, by the newest sample at or before them.

    Samples and joins of a server are one stream, cut into chunks. A chunk's summary holds its lonely joins, the joins before
    its first sample, which the chunks before decide on, and its last sample; rows are shuffled once.
    """
    server = ["server_id"]
    state = samples.select(*server, "date", F.col("id").alias("tie"), "players_online", F.lit(0).alias("join"))
    asked = sessions.select(*server, F.col("session_start").alias("date"), F.lit(None).cast("bigint").alias("tie"), F.lit(None).cast("int").alias("players_online"), F.lit(1).alias("join"))
    rows = state.unionByName(asked).withColumn("chunk", bucket("date", HOUR)).repartition(*server, "chunk")
    upto = Window.partitionBy(*server, "chunk").orderBy("date", "join", "tie").rowsBetween(Window.unboundedPreceding, 0)
    known = F.last(F.when(F.col("join") == 0, F.struct("players_online")), ignorenulls=True).over(upto)
    joined = F.col("join") == 1
    summaries = rows.withColumn("known", known).groupBy(*server, "chunk").agg(
        F.count_if(joined).alias("n"), F.count_if(joined & (F.col("known.players_online") == 0)).alias("lonely"), F.count_if(joined & F.col("known").isNull()).alias("first"),
        F.max(F.when(~joined, F.struct("date", "tie", "players_online"))).alias("last"),
    )
    before = F.last("last", ignorenulls=True).over(Window.partitionBy(*server).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    alone = F.col("lonely") + F.when(F.col("before.players_online") == 0, F.col("first")).otherwise(0)
    counted = summaries.withColumn("before", before).groupBy(*by).agg(F.sum("n").alias("n"), F.coalesce(F.sum(alone), F.lit(0)).alias("lonely_joins"))
    return counted.where((F.col("n") > 0) | F.lit(not by)).select(*by, "lonely_joins")


def server_online_at(samples, instants: DataFrame, limit: int) -> DataFrame:
    """Whether the newest sample at each instant is younger than ``limit``."""
    return online_on(samples, instants).select("server_id", "date", F.coalesce(F.col("age") < limit, F.lit(False)).alias("online"))


def in_set(df: DataFrame, ids: DataFrame, column: str = "user_id") -> DataFrame:
    return df.join(ids.select(F.col(ids.columns[0]).alias(column)), column, "left_semi")


def not_in_set(df: DataFrame, ids: DataFrame, column: str = "user_id") -> DataFrame:
    return df.join(ids.select(F.col(ids.columns[0]).alias(column)), column, "left_anti")
