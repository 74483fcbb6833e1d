"""Data-lifecycle and repair jobs. Each returns the repaired table; facts are filtered or remapped by joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arenalytics.functions.ordered import running_total
from arenalytics.functions.windows import length
from arenalytics.operators.join_address import UNKNOWN

# Fixed value: AFK times this close to the session length are treated as equal to it.
AFK_SLACK = 5


def retain_samples(samples, cutoff: int) -> DataFrame:
    """Drop samples older than ``cutoff`` except those that show the server's all-time peak. Only old samples meet the peaks."""
    peaks = samples.groupBy("server_id").agg(F.max("players_online").alias("players_online"))
    old = samples.where(F.col("date") < cutoff).join(peaks, ["server_id", "players_online"], "left_semi")
    return samples.where(F.col("date") >= cutoff).unionByName(old)


def retain_pings(ping, cutoff: int) -> DataFrame:
    return ping.where((F.col("date") >= cutoff) & (F.col("min_ping") >= 0))


def retain_history(history, cutoff: int) -> DataFrame:
    return history.where(F.col("date") >= cutoff)


def unique_user_info(user_info) -> DataFrame:
    """Keep the row with the smallest id per user and server."""
    columns = [c for c in user_info.columns if c not in ("user_id", "server_id")]
    first = user_info.groupBy("user_id", "server_id").agg(F.min_by(F.struct(*columns), F.col("id")).alias("_r"))
    return first.select(*[F.col(f"_r.{c}").alias(c) if c in columns else F.col(c) for c in user_info.columns])


def inactive_users(sessions, cutoff: int) -> DataFrame:
    """Users whose last session ended before ``cutoff``."""
    return sessions.groupBy("user_id").agg(F.max("session_end").alias("_l")).where(F.col("_l") < cutoff).select("user_id")


def without_users(table, users: DataFrame, column: str = "user_id") -> DataFrame:
    return table.join(users.select(F.col(users.columns[0]).alias(column)), column, "left_anti")


def remove_users(tables: dict[str, DataFrame], users: DataFrame, uuids: DataFrame) -> dict[str, DataFrame]:
    """Every table without the given users. Tables are matched on user_id, id (users) or a uuid column."""
    by_uuid = {"kills": ["killer_uuid", "victim_uuid"], "nicknames": ["uuid"]}
    out = {}
    for name, table in tables.items():
        for column in by_uuid.get(name, ["id"] if name == "users" else ["user_id"]):
            table = without_users(table, uuids if name in by_uuid else users, column)
        out[name] = table
    return out


def remove_servers(tables: dict[str, DataFrame], server_ids: Sequence[int]) -> dict[str, DataFrame]:
    """Every table without the rows of the given servers."""
    ids = [int(i) for i in server_ids]
    return {
        name: t.where(~F.col("id" if name == "servers" else "server_id").isin(ids)) if name == "servers" or "server_id" in t.columns else t
        for name, t in tables.items()
    }


def _remapped(table, mapping: DataFrame, column: str) -> DataFrame:
    pairs = mapping.select(F.col("old_id").alias(column), F.col("new_id").alias("_new"))
    order = table.columns
    return table.join(pairs, column, "left").withColumn(column, F.coalesce("_new", column)).select(*order)


def merge_identities(tables: dict[str, DataFrame], mapping: DataFrame) -> dict[str, DataFrame]:
    """Move all rows of ``old_id`` users to ``new_id``; where both have user_info for a server the target's row stays.

    ``mapping`` has (old_id, new_id, old_uuid, new_uuid).
    """
    out = {}
    uuids = mapping.select(F.col("old_uuid").alias("old_id"), F.col("new_uuid").alias("new_id"))
    for name, table in tables.items():
        if name == "users":
            out[name] = without_users(table, mapping.select("old_id"), "id")
        elif name == "user_info":
            olds = mapping.select(F.col("old_id").alias("user_id"), F.lit(1).alias("_moved"))
            moved = table.join(olds, "user_id", "left")
            target = _remapped(moved, mapping, "user_id")
            columns = [c for c in table.columns if c not in ("user_id", "server_id")]
            best = F.min_by(F.struct(*columns), F.struct(F.coalesce("_moved", F.lit(0)), F.col("id")))
            kept = target.groupBy("user_id", "server_id").agg(best.alias("_r"))
            out[name] = kept.select(*[F.col(f"_r.{c}").alias(c) if c in columns else F.col(c) for c in table.columns])
        elif name == "kills":
            out[name] = _remapped(_remapped(table, uuids, "killer_uuid"), uuids, "victim_uuid")
        elif "user_id" in table.columns:
            out[name] = _remapped(table, mapping, "user_id")
        else:
            out[name] = _remapped(table, uuids, "uuid")
    return out


def minimized_register_dates(users, user_info) -> DataFrame:
    """Register date = earliest date on any server when that is earlier or the stored one is 0; 0 on servers is ignored."""
    first = user_info.where(F.col("registered") != 0).groupBy(F.col("user_id").alias("id")).agg(F.min("registered").alias("_min"))
    better = F.col("_min").isNotNull() & ((F.col("registered") > F.col("_min")) | (F.col("registered") == 0))
    return users.join(first, "id", "left").withColumn("registered", F.when(better, F.col("_min")).otherwise(F.col("registered"))).drop("_min").select(*users.columns)


def reset_bad_afk(sessions) -> DataFrame:
    """AFK time that equals the session length becomes 0."""
    bad = F.abs(F.col("afk_time") - length()) < AFK_SLACK
    return sessions.withColumn("afk_time", F.when(bad, F.lit(0).cast("bigint")).otherwise(F.col("afk_time")))


def without_dangling(table, parents: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` exists in the first column of ``parents``."""
    return table.join(parents.select(F.col(parents.columns[0]).alias(column)), column, "left_semi").select(*table.columns)


def new_ids(keys: DataFrame, order: str, first: Column) -> DataFrame:
    """``(order, new_id)``: consecutive ids from ``first`` on in the order of a unique integer column, numbered in parallel."""
    numbered = running_total(keys.select(order), [], order, {"n": F.lit(1).cast("bigint")}, 65536)
    return numbered.select(order, (first + F.col("n") - 1).alias("new_id"))


def numbered(rows: DataFrame, key: str, first: Column) -> DataFrame:
    """``rows`` with consecutive ``new_id`` from ``first``: hash buckets of ``key`` one after the other, by ``key`` within.

    Buckets follow the number of shuffle partitions, so only one count per bucket is ever in one task; keys of one hash
    are told apart by their value.
    """
    buckets = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("_bucket").agg(F.count("*").alias("_n"))
    offsets = counts.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(key)) - 1
    found = dealt.withColumn("_place", place).join(offsets, "_bucket")
    return found.withColumn("new_id", first + F.col("_offset") + F.col("_place")).drop("_bucket", "_place", "_offset")


def _next_id(table: DataFrame, column: str = "id") -> Column:
    return table.agg(F.coalesce(F.max(column).cast("bigint"), F.lit(0)) + 1).scalar()


def corrected_addresses(join_address, sessions) -> tuple[DataFrame, DataFrame]:
    """Cut addresses at NUL, merge them into the clean address (a new one gets a new id) and remap the sessions."""
    clean = F.substring_index("join_address", "\u0000", 1)
    bad = join_address.where(F.col("join_address").contains("\u0000")).select(F.col("id").alias("old_id"), clean.alias("join_address"))
    good = join_address.where(~F.col("join_address").contains("\u0000"))
    missing = bad.join(good.select("join_address"), "join_address", "left_anti").groupBy("join_address").agg(F.min("old_id").cast("bigint").alias("old"))
    ids = new_ids(missing, "old", _next_id(join_address))
    added = missing.join(ids, "old").select(F.col("new_id").cast("int").alias("id"), "join_address")
    table = good.select("id", "join_address").unionByName(added)
    mapping = bad.join(table, "join_address").select("old_id", F.col("id").alias("new_id"))
    return table, _remapped(sessions, mapping, "join_address_id")


def fill_missing_addresses(sessions, join_address, user_info) -> DataFrame:
    """Sessions whose address id is unknown get the address of the user on that server, else "unknown"."""
    known = join_address.select(F.col("id").alias("join_address_id"), F.lit(True).alias("_ok"))
    named = user_info.select("user_id", "server_id", "join_address").join(join_address.select(F.col("id").alias("_of_user"), "join_address"), "join_address").drop("join_address")
    unknown = join_address.where(F.col("join_address") == UNKNOWN).agg(F.min("id")).scalar()
    filled = sessions.join(known, "join_address_id", "left").join(named, ["user_id", "server_id"], "left")
    right = F.when(F.col("_ok"), F.col("join_address_id")).otherwise(F.coalesce("_of_user", unknown))
    return filled.withColumn("join_address_id", right).select(*sessions.columns)


def reconciled_flags(user_info, current: DataFrame, column: str = "banned") -> DataFrame:
    """Set the flag of every row to whether its (user, server) is in the current list."""
    listed = current.select("user_id", "server_id").distinct().withColumn("_now", F.lit(True))
    return user_info.join(listed, ["user_id", "server_id"], "left").withColumn(column, F.coalesce("_now", F.lit(False))).select(*user_info.columns)


def flag_changes(user_info, current: DataFrame, column: str = "banned") -> DataFrame:
    """Only the rows whose flag differs, with the new value."""
    fresh = reconciled_flags(user_info, current, column).select("user_id", "server_id", F.col(column).alias("new"))
    both = user_info.select("user_id", "server_id", F.col(column).alias("old")).join(fresh, ["user_id", "server_id"])
    return both.where(F.col("old") != F.col("new")).select("user_id", "server_id", F.col("new").alias(column))


def id_lookup(target, source, key: str) -> DataFrame:
    """``(old_id, new_id, is_new)`` for every row of ``source``: the target's id of the same natural key, else a new id."""
    known = source.select(F.col("id").alias("old_id"), key).join(target.select(F.col("id").alias("new_id"), key), key, "left")
    missing = known.where(F.col("new_id").isNull()).select(F.col("old_id").cast("bigint").alias("old_id"))
    fresh = new_ids(missing, "old_id", _next_id(target)).withColumn("is_new", F.lit(True))
    matched = known.where(F.col("new_id").isNotNull()).select(
        F.col("old_id").cast("bigint").alias("old_id"), F.col("new_id").cast("bigint").alias("new_id"), F.lit(False).alias("is_new")
    )
    return matched.unionByName(fresh)


def merge_dimension(target, source, key: str) -> tuple[DataFrame, DataFrame]:
    """The target extended by the source's unknown rows, and the id lookup for its facts."""
    lookup = id_lookup(target, source, key)
    added = source.withColumnRenamed("id", "old_id").join(lookup.where("is_new").drop("is_new"), "old_id")
    added = added.drop("old_id").withColumnRenamed("new_id", "id").withColumn("id", F.col("id").cast(target.schema["id"].dataType))
    return target.unionByName(added.select(*target.columns)), lookup.drop("is_new")


def merge_facts(target, source, lookups: dict[str, DataFrame], new_id: bool = False) -> DataFrame:
    """Append the source's facts with every id column of ``lookups`` translated; ``new_id`` renumbers the rows too."""
    moved = source
    for column, lookup in lookups.items():
        moved = _remapped(moved, lookup, column).withColumn(column, F.col(column).cast(target.schema[column].dataType))
    if new_id:
        ids = new_ids(moved.select(F.col("id").alias("_old")), "_old", _next_id(target))
        moved = moved.withColumnRenamed("id", "_old").join(ids, "_old").drop("_old").withColumnRenamed("new_id", "id")
    return target.unionByName(moved.select(*target.columns))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, table in tables.items():
        row = table.agg(F.lit(name).alias("table"), F.count("*").alias("rows"))
        out = row if out is None else out.unionByName(row)
    return out
