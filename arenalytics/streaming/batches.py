"""Work done once per micro-batch: metric refresh and plugin changes."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from arenalytics.operators.metrics import Registry
from arenalytics.operators.roster import plugin_changes
from arenalytics.sources.sinks import newest_batch, read_batches, write_batch

PLUGIN = ["server_id", "plugin_name"]


def refresh_metrics(registry: Registry, tables: dict[str, DataFrame], event: str, scope: str = "user", key: str = "user_id"):
    """Writer that re-evaluates the metrics registered for ``event`` for the keys that had it in the batch.

    A key in several batches has a row in each; :func:`refreshed_metrics` reads the newest one.
    """

    def write(batch: DataFrame, batch_id: int, path: str) -> None:
        keys = batch.where(F.col("kind") == event).select(F.col(key).alias("key")).distinct()
        cut = {name: t.join(keys.select(F.col("key").alias(key)), key, "left_semi") if key in t.columns else t for name, t in tables.items()}
        write_batch(registry.evaluate(cut, scope, event), path, batch_id)

    return write


CHANGE = "server_id int, plugin_name string, version string, modified bigint, change string"


def _write_changes(installed: DataFrame, snapshot: DataFrame, now: int, path: str, batch_id: int) -> None:
    """Store the changes that whole snapshots of some servers make; changes of earlier batches count as installed."""
    earlier = newest_batch(read_batches(snapshot.sparkSession, path, StructType.fromDDL(CHANGE), batch_id), PLUGIN)
    base = installed.select(*PLUGIN, "version").join(earlier.select(*PLUGIN), PLUGIN, "left_anti")
    current = base.unionByName(earlier.where(F.col("version").isNotNull()).select(*PLUGIN, "version"))
    seen = current.join(snapshot.select("server_id").distinct(), "server_id", "left_semi")
    write_batch(plugin_changes(seen, snapshot, now), path, batch_id)


def record_plugin_changes(installed: DataFrame, now: int):
    """Writer that stores the change rows between the plugins installed so far and each snapshot.

    A batch must hold whole snapshots of its servers: servers that are not in it are left alone, plugins that its servers no
    longer list are removed. Snapshots that may arrive in parts are for :func:`record_split_snapshots`.
    """

    def write(batch: DataFrame, batch_id: int, path: str) -> None:
        _write_changes(installed, batch.distinct(), now, path, batch_id)

    return write


def record_split_snapshots(installed: DataFrame, now: int):
    """Writer like :func:`record_plugin_changes` for snapshots whose rows come in any number of batches and in any order.

    Rows are (server_id, snapshot, plugins, plugin_name, version): the snapshot's number and how many plugins it lists, at least
    one. Rows wait below ``arrived``; the batch that completes a snapshot writes its changes below ``changes``. Of several snapshots of
    a server that are complete the newest counts, and one that is older than a snapshot already used is left out.
    """

    def write(batch: DataFrame, batch_id: int, path: str) -> None:
        schema = StructType.fromDDL("server_id int, snapshot bigint, plugins bigint, plugin_name string, version string")
        arrived = os.path.join(path, "arrived")
        write_batch(batch.select(*schema.names).distinct(), arrived, batch_id)
        rows = read_batches(batch.sparkSession, arrived, schema, batch_id + 1)
        parts = rows.groupBy("server_id", "snapshot", "plugin_name").agg(F.min("batch").alias("came"), F.max("plugins").alias("plugins"))
        whole = parts.groupBy("server_id", "snapshot").agg(F.count("*").alias("n"), F.max("plugins").alias("size"), F.max("came").alias("done")).where("n >= size")
        newest = whole.groupBy("server_id").agg(F.max("snapshot").alias("snapshot"), F.max_by("done", "snapshot").alias("done"))
        chosen = newest.where(F.col("done") == batch_id).select("server_id", "snapshot")
        listed = rows.join(chosen, ["server_id", "snapshot"]).select(*PLUGIN, "version").distinct()
        _write_changes(installed, listed, now, os.path.join(path, "changes"), batch_id)

    return write


def refreshed_metrics(spark: SparkSession, path: str, schema) -> DataFrame:
    """Metrics written by :func:`refresh_metrics`, the newest row of each plugin, provider and key."""
    return newest_batch(read_batches(spark, path, schema), ["plugin", "provider", "key"])


def preserve_open_sessions(open_rows: DataFrame, root: str, stop_id: int) -> str:
    """Store the sessions ended by a stop; returns the folder they are read from at the next start."""
    folder = os.path.join(root, "preserved")
    write_batch(open_rows, folder, stop_id)
    return folder
