"""The delimited recovery file of sessions that could not be stored before a stop.

One session per line, fields separated by ``;``: user, server, start, end, AFK, then JSON for world times,
kills, mob kills and deaths, then join address and name. Lines with fewer than five fields are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORLD_TIMES = "struct<times: map<string, struct<times: map<string, bigint>>>>"
KILLS = "struct<kills: array<struct<killer: struct<uuid: string, name: string>, victim: struct<uuid: string, name: string>, weapon: string, date: bigint>>>"
COUNTER = "struct<count: int>"


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """Sessions from a DataFrame of text lines."""
    fields = F.filter(F.split(F.col(column), ";"), lambda f: f != "")

    def at(i: int) -> Column:
        return F.get(F.col("_f"), F.lit(i))

    def number(i: int) -> Column:
        return at(i).try_cast("bigint")

    rows = lines.select(fields.alias("_f")).where(F.size("_f") >= 5)
    return rows.select(
        at(0).alias("user_uuid"),
        at(1).alias("server_uuid"),
        number(2).alias("session_start"),
        number(3).alias("session_end"),
        number(4).alias("afk_time"),
        F.from_json(at(5), WORLD_TIMES)["times"].alias("world_times"),
        F.from_json(at(6), KILLS)["kills"].alias("kills"),
        F.from_json(at(7), COUNTER)["count"].alias("mob_kills"),
        F.from_json(at(8), COUNTER)["count"].alias("deaths"),
        at(9).alias("join_address"),
        at(10).alias("name"),
    ).where(F.col("session_start").isNotNull() & F.col("session_end").isNotNull() & F.col("afk_time").isNotNull())


def serialize(sessions: DataFrame) -> DataFrame:
    """Text lines ``value`` for sessions with the columns of :func:`parse`."""
    world_times = F.to_json(F.struct(F.coalesce("world_times", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<struct<times: map<string, bigint>>>"))).alias("times")))
    kills = F.to_json(F.struct(F.coalesce("kills", F.array().cast("array<struct<killer: struct<uuid: string, name: string>, victim: struct<uuid: string, name: string>, weapon: string, date: bigint>>")).alias("kills")))

    def counter(c: str) -> Column:
        return F.to_json(F.struct(F.coalesce(c, F.lit(0)).alias("count")))

    line = F.concat_ws(
        ";", "user_uuid", "server_uuid", F.col("session_start").cast("string"), F.col("session_end").cast("string"),
        F.col("afk_time").cast("string"), world_times, kills, counter("mob_kills"), counter("deaths"),
        F.coalesce(F.translate("join_address", ";", ":"), F.lit("unknown")), F.coalesce("name", "user_uuid"),
    )
    return sessions.select(F.translate(line, "\\", "_").alias("value"))


def read(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.read.text(path))


def write(sessions: DataFrame, path: str) -> None:
    serialize(sessions).write.mode("append").text(path)
