"""Reading the stored tables, whole or in key ranges."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arenalytics.schema import TABLES


class Tables:
    """Attribute access to the tables stored below one folder, read with their declared schemas."""

    def __init__(self, spark: SparkSession, root: str, fmt: str = "parquet"):
        self.spark, self.root, self.fmt = spark, root, fmt

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in TABLES:
            raise AttributeError(name)
        return read_table(self.spark, os.path.join(self.root, name), name, self.fmt)


def read_table(spark: SparkSession, path: str, name: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(TABLES[name]).format(fmt).load(path)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str = "id", partitions: int = 64, **options: str) -> DataFrame:
    """A database table read in parallel ranges of an integer key; the bounds come from the database."""
    bounds = (
        spark.read.format("jdbc").options(url=url, query=f"select min({key}) as lo, max({key}) as hi from {table}", **options).load().first()
    )
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if bounds is None or bounds[0] is None:
        return reader.load()
    return reader.options(
        partitionColumn=key, lowerBound=str(int(bounds[0])), upperBound=str(int(bounds[1]) + 1), numPartitions=str(partitions)
    ).load()


def page(df: DataFrame, after, limit: int, key: str = "id") -> DataFrame:
    """The next ``limit`` rows with a key greater than ``after``."""
    return df.where(F.col(key) > after).orderBy(key).limit(limit)


def with_natural_keys(
    facts: DataFrame, users: DataFrame | None = None, servers: DataFrame | None = None, join_address: DataFrame | None = None
) -> DataFrame:
    """A fact table with user uuid, server uuid and join address in place of the ids."""
    out = facts
    if users is not None:
        out = out.join(users.select(F.col("id").alias("user_id"), F.col("uuid").alias("user_uuid")), "user_id").drop("user_id")
    if servers is not None:
        out = out.join(servers.select(F.col("id").alias("server_id"), F.col("uuid").alias("server_uuid")), "server_id").drop("server_id")
    if join_address is not None:
        out = out.join(join_address.select(F.col("id").alias("join_address_id"), "join_address"), "join_address_id").drop("join_address_id")
    return out


def nicknames_per_user(nicknames: DataFrame) -> DataFrame:
    """(user_uuid, nicknames): every user's nicknames with server and last use, the latest first."""
    order = F.struct((-F.col("last_used")).alias("o"), "nickname", "server_uuid", "last_used")
    listed = nicknames.groupBy(F.col("uuid").alias("user_uuid")).agg(F.sort_array(F.collect_list(order)).alias("n"))
    named = F.transform("n", lambda x: F.struct(x["server_uuid"].alias("server_uuid"), x["nickname"].alias("nickname"), x["last_used"].alias("last_used")))
    return listed.select("user_uuid", named.alias("nicknames"))


def world_names(worlds: DataFrame) -> DataFrame:
    """(server_uuid, world_names): the names of a server's worlds, in order."""
    return worlds.groupBy("server_uuid").agg(F.sort_array(F.collect_set("world_name")).alias("world_names"))


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, sort: str | None = None) -> None:
    """Store a fact as a table bucketed by a join key, so later joins and aggregations on it need no shuffle."""
    writer = df.write.mode("overwrite").format("parquet").bucketBy(buckets, key)
    (writer.sortBy(sort) if sort else writer).saveAsTable(table)
