"""Bulk import of users and sessions from another tool."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arenalytics.operators.quality import _next_id, numbered


def valid_users(incoming: DataFrame) -> DataFrame:
    """One row per uuid: earliest register date, newest name, flags or-ed; rows without uuid or date are dropped."""
    usable = incoming.where(F.col("uuid").isNotNull() & F.col("registered").isNotNull() & (F.col("registered") > 0))
    return usable.groupBy("uuid").agg(
        F.min("registered").alias("registered"), F.max_by("name", "registered").alias("name"), F.max("times_kicked").alias("times_kicked")
    )


def import_users(users: DataFrame, incoming: DataFrame) -> DataFrame:
    """The table extended by unknown users with new ids; known users stay as they are."""
    unknown = valid_users(incoming).join(users.select("uuid"), "uuid", "left_anti")
    added = numbered(unknown, "uuid", _next_id(users)).withColumnRenamed("new_id", "id")
    return users.unionByName(added.select(*[F.col(f.name).cast(f.dataType) for f in users.schema]))


def valid_sessions(incoming: DataFrame) -> DataFrame:
    """Sessions that end after they start, one per user, server and start."""
    usable = incoming.where(F.col("session_end") >= F.col("session_start")).where(F.col("user_uuid").isNotNull())
    keys = ["user_uuid", "server_uuid", "session_start"]
    columns = [c for c in incoming.columns if c not in keys]
    best = usable.groupBy(*keys).agg(F.max_by(F.struct(*columns), "session_end").alias("_r"))
    return best.select(*[F.col(f"_r.{c}").alias(c) if c in columns else F.col(c) for c in incoming.columns])


def import_sessions(sessions: DataFrame, incoming: DataFrame, users: DataFrame, servers: DataFrame) -> DataFrame:
    """New sessions to append: natural keys resolved, already stored ones left out. Ids are not assigned."""
    people = users.select(F.col("id").alias("user_id"), F.col("uuid").alias("user_uuid"))
    places = servers.select(F.col("id").alias("server_id"), F.col("uuid").alias("server_uuid"))
    known = sessions.select("user_id", "server_id", "session_start")
    resolved = valid_sessions(incoming).join(people, "user_uuid").join(places, "server_uuid").drop("user_uuid", "server_uuid")
    return resolved.join(known, ["user_id", "server_id", "session_start"], "left_anti")
