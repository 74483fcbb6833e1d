"""Free SQL over the tables and the per-user questions other tools ask most."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arenalytics.functions.windows import clipped, overlap
from arenalytics.operators.activity import DEFAULT_THRESHOLD, activity_group, activity_index


def run_sql(spark: SparkSession, text: str, **tables: DataFrame) -> DataFrame:
    """Run a Spark SQL text in which ``{name}`` stands for one of the given tables."""
    return spark.sql(text, **tables)


def common_queries(users, sessions, a: int, b: int, threshold: int = DEFAULT_THRESHOLD, servers=None) -> DataFrame:
    """uuid, name, playtime in the window, last seen, activity index and group at ``b`` of every user."""
    base = users.select(F.col("id").alias("user_id"), "registered")
    index = activity_index(sessions, base, b, threshold, servers, closed=False)
    played = sessions.groupBy("user_id").agg(
        F.sum(F.when(overlap(a, b), clipped(a, b)).otherwise(0)).alias("playtime"), F.max("session_end").alias("last_seen")
    )
    people = users.select(F.col("id").alias("user_id"), "uuid", "name")
    return people.join(played, "user_id").join(index, "user_id").select(
        "uuid", "name", "playtime", "last_seen", "activity_index", activity_group().alias("activity_group")
    )


def user_by_name(users, name: str) -> DataFrame:
    return users.where(F.lower("name") == name.lower()).select("id", "uuid", "name")


def users_by_uuid(users, uuids: list[str]) -> DataFrame:
    return users.where(F.col("uuid").isin(uuids)).select("id", "uuid", "name")
