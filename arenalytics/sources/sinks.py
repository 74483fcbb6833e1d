"""Writing results: appends, upserts, and the split of finished sessions into three tables.

Upserts return the new table; the caller writes it to a new folder, because a table cannot be overwritten
while it is read. Batch writers put each micro-batch into its own folder, so a repeated batch replaces itself.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def append(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write one micro-batch; running it again with the same id leaves the same files."""
    df.write.mode("overwrite").parquet(os.path.join(path, f"batch={batch_id}"))


def split_sessions(sessions: DataFrame) -> dict[str, DataFrame]:
    """Finished sessions with nested world times and kills as the three tables they are stored in.

    ``world_times``: map world → struct(times: map mode → ms); ``kills``: array of structs.
    """
    flat = sessions.drop("world_times", "kills")
    worlds = sessions.select("id", "user_uuid", "server_uuid", F.explode("world_times").alias("world_name", "w"))
    modes = [F.coalesce(F.col("w.times")[m.upper()], F.lit(0)).alias(f"{m}_time") for m in ("survival", "creative", "adventure", "spectator")]
    kills = sessions.select(F.col("id").alias("session_id"), "server_uuid", F.explode("kills").alias("k"))
    return {
        "sessions": flat,
        "world_times": worlds.select(F.col("id").alias("session_id"), "user_uuid", "server_uuid", "world_name", *modes),
        "kills": kills.select(
            "session_id", "server_uuid", F.col("k.killer.uuid").alias("killer_uuid"), F.col("k.victim.uuid").alias("victim_uuid"),
            F.col("k.weapon").alias("weapon"), F.col("k.date").alias("date"),
        ),
    }


COMMITS = "commits"


def store_sessions(batch: DataFrame, root: str, batch_id: int) -> None:
    """foreachBatch writer of finished sessions; the batch is kept for its three writes, so its state is computed once.

    Last comes the batch's commit: :func:`committed` reads all three tables of a batch or none, also while a batch is
    being written and after one that failed half-way.
    """
    held = batch.persist()
    try:
        for name, table in split_sessions(held).items():
            write_batch(table, os.path.join(root, name), batch_id)
    finally:
        held.unpersist()
    spark = batch.sparkSession
    write_batch(spark.range(1).select(F.lit(batch_id).cast("bigint").alias("committed")), os.path.join(root, COMMITS), batch_id)


def committed(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Rows of a table that :func:`store_sessions` writes, of the committed batches only; folders of others are not read."""
    done = [r.committed for r in spark.read.parquet(os.path.join(root, COMMITS)).select("committed").distinct().collect()]
    return spark.read.parquet(os.path.join(root, name)).where(F.col("batch").isin(done)).drop("batch")


def read_batches(spark: SparkSession, path: str, schema, before: int | None = None) -> DataFrame:
    """Rows of all micro-batches below ``path`` with their ``batch``, only those before batch ``before`` if given."""
    wide = StructType([*schema.fields, StructField("batch", LongType())])
    try:
        rows = spark.read.schema(wide).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], wide)
    return rows if before is None else rows.where(F.col("batch") < before)


def newest_batch(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key of ``read_batches``: that of the newest batch."""
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_r"))
    return newest.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in values])


def upsert_latest(old: DataFrame, new: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Last write wins: the row with the greatest ``order`` per key, the new one on ties."""
    columns = [c for c in old.columns if c not in keys]
    both = old.withColumn("_new", F.lit(0)).unionByName(new.select(*old.columns).withColumn("_new", F.lit(1)))
    newest = F.max_by(F.struct(*columns), F.struct(order, "_new"))
    merged = both.groupBy(*keys).agg(newest.alias("_r"))
    return merged.select(*[F.col(f"_r.{c}").alias(c) if c in columns else F.col(c) for c in old.columns])


def upsert_counts(old: DataFrame, new: DataFrame, keys: Sequence[str], count: str, last: str) -> DataFrame:
    """Counting upsert: counts add up, the last date and the other columns come from the newest row."""
    others = [c for c in old.columns if c not in (*keys, count, last)]
    both = old.unionByName(new.select(*old.columns))
    merged = both.groupBy(*keys).agg(F.sum(count).alias(count), F.max(last).alias(last), *[F.max_by(c, last).alias(c) for c in others])
    return merged.select(*old.columns)


def upsert_registrations(users: DataFrame, seen: DataFrame) -> DataFrame:
    """Users with the smallest register date known; unknown uuids are added.

    ``seen``: (uuid, name, registered) where a fact that arrived before its user has a null name, which
    becomes the uuid until a real one is seen. New rows have a null id.
    """
    first = seen.groupBy("uuid").agg(F.min("registered").alias("_registered"), F.max_by("name", F.when(F.col("name").isNotNull(), F.col("registered"))).alias("_name"))
    merged = users.join(first, "uuid", "full_outer")
    placeholder = (F.col("name") == F.col("uuid")) | F.col("name").isNull()
    name = F.when(placeholder, F.coalesce("_name", "name", "uuid")).otherwise(F.col("name"))
    values = {"name": name, "registered": F.least("registered", "_registered")}
    return merged.select(*[values.get(c, F.col(c)).alias(c) for c in users.columns])


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
