"""Windowed roll-ups of sample pulses and pings with built-in streaming aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arenalytics.functions.windows import valid_ping
from arenalytics.operators.lifecycle import newest_first


def _windowed(stream: DataFrame, delay: str, width: str) -> DataFrame:
    timed = stream.withColumn("at", F.timestamp_millis("date")).withWatermark("at", delay)
    return timed.withColumn("w", F.window("at", width))


def live_minutes(pulses: DataFrame, delay: str = "10 minutes", width: str = "1 minute") -> DataFrame:
    """Minute samples per server, emitted once the watermark has passed the minute; the columns of the batch form.

    The tick times of a server's minute wait in its state as a list; in order they give the 95th percentile by rank and the
    changes between neighbours.
    """
    newest = newest_first("date", "id")
    rolled = _windowed(pulses, delay, width).groupBy("server_id", "w").agg(
        F.avg(F.when(F.col("tps") >= 0, F.col("tps"))).alias("tps"),
        F.max("players").alias("players_online"),
        F.avg("cpu").alias("cpu_usage"),
        F.avg("ram").cast("bigint").alias("ram_usage"),
        F.max_by("entities", newest).alias("entities"),
        F.max_by("chunks", newest).alias("chunks_loaded"),
        F.max_by("disk", newest).alias("free_disk_space"),
        F.avg(F.when(F.col("mspt") > 0, F.col("mspt"))).alias("mspt_average"),
        F.collect_list(F.when(F.col("mspt") > 0, F.struct("date", "id", "mspt"))).alias("ticks"),
    )
    kept = [c for c in rolled.columns if c not in ("server_id", "w", "ticks")]
    in_time = F.transform(F.array_sort("ticks"), lambda t: t["mspt"])
    changes = F.transform(F.slice("series", 2, F.greatest(F.size("series"), F.lit(1))), lambda x, i: F.abs(x - F.get("series", i)).cast("double"))
    rank = F.floor(F.size("series") * F.lit(0.95)).cast("int") - 1
    rows = rolled.select("server_id", F.unix_millis("w.start").alias("date"), *kept, in_time.alias("series"))
    rows = rows.select("server_id", "date", *kept, "series", changes.alias("changes"))
    mean = F.aggregate("changes", F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size("changes"), F.lit(0))
    return rows.select(
        "server_id", "date", *kept, F.when(rank > 0, F.get(F.array_sort("series"), rank)).alias("mspt_95th"),
        mean.alias("mspt_jitter_avg"), F.array_max("changes").alias("mspt_jitter_max"),
    )


def live_pings(pings: DataFrame, delay: str = "10 minutes", width: str = "1 minute") -> DataFrame:
    """Per user and server: last date, lowest and highest ping in range, median of all values."""
    ok = F.when(valid_ping("value"), F.col("value"))
    rolled = _windowed(pings, delay, width).groupBy("user_id", "server_id", "w").agg(
        F.max("date").alias("date"),
        F.coalesce(F.min(ok), F.lit(-1)).alias("min_ping"),
        F.coalesce(F.max(ok), F.lit(-1)).alias("max_ping"),
        F.percentile("value", 0.5).cast("int").cast("double").alias("avg_ping"),
    )
    return rolled.drop("w")


def activity_sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Sessions from activity alone, for logs without joins and leaves: a gap ends the session."""
    timed = events.withColumn("at", F.timestamp_millis("date")).withWatermark("at", delay)
    rolled = timed.groupBy("user_id", F.session_window("at", gap).alias("w")).agg(
        F.min("date").alias("session_start"), F.max("date").alias("session_end"), F.count("*").alias("events")
    )
    return rolled.drop("w")
