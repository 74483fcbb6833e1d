"""Nicknames, allowlist bounces, installed plugins and name search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arenalytics.functions.windows import scope
from arenalytics.operators.joins import latest_rows


def latest_nicknames(nicknames) -> DataFrame:
    """Nickname(s) last used by each user on each server."""
    return latest_rows(nicknames, ["uuid", "server_uuid"], "last_used")


def nicknames_of(nicknames, uuid: str) -> DataFrame:
    return nicknames.where(F.col("uuid") == uuid).orderBy(F.col("last_used").desc())


def nickname_lists(nicknames) -> DataFrame:
    """Comma-separated distinct nicknames per user."""
    distinct = nicknames.select("uuid", "nickname").distinct()
    return distinct.groupBy("uuid").agg(F.array_join(F.sort_array(F.collect_list("nickname")), ",").alias("nicknames"))


def matching_names(users, nicknames, text: str) -> DataFrame:
    """Names of the users whose name or a nickname contains the text, ignoring case."""
    wanted = text.lower()
    by_name = users.where(F.lower("name").contains(wanted)).select("name")
    uuids = nicknames.where(F.lower("nickname").contains(wanted)).select("uuid")
    by_nickname = users.join(uuids, "uuid", "left_semi").select("name")
    return by_name.unionByName(by_nickname).distinct()


GRAM = 3


def name_index(users, nicknames) -> DataFrame:
    """Postings (gram, seen, name): the runs of three characters of every name and nickname in lower case, with the user's name."""
    own = users.select("name", F.lower("name").alias("seen"))
    by_nickname = nicknames.select("uuid", F.lower("nickname").alias("seen")).distinct().join(users.select("uuid", "name"), "uuid")
    texts = own.unionByName(by_nickname.select("name", "seen")).distinct()
    length = F.char_length("seen")
    places = F.when(length >= GRAM, F.sequence(F.lit(1), length - GRAM + 1)).otherwise(F.array(F.lit(1)))
    grams = F.array_distinct(F.transform(places, lambda i: F.substring("seen", i, F.lit(GRAM))))
    return texts.select(F.explode(grams).alias("gram"), "seen", "name")


def write_name_index(users, nicknames, path: str) -> None:
    """Store the postings by gram, so that a search reads the row groups of one gram only."""
    name_index(users, nicknames).repartitionByRange("gram", "seen").sortWithinPartitions("gram").write.parquet(path)


def indexed_names(index: DataFrame, text: str) -> DataFrame:
    """The names of :func:`matching_names` by an index: postings of the text's rarest gram, verified against the whole text.

    The driver sees one count per gram of the text. A text of fewer than three characters has no gram and scans the postings.
    """
    wanted = text.lower()
    grams = sorted({wanted[i : i + GRAM] for i in range(len(wanted) - GRAM + 1)})
    chosen = index
    if grams:
        sizes = {r.gram: r.n for r in index.where(F.col("gram").isin(grams)).groupBy("gram").agg(F.count("*").alias("n")).collect()}
        chosen = index.where(F.col("gram") == min(grams, key=lambda g: (sizes.get(g, 0), g)))
    return chosen.where(F.col("seen").contains(wanted)).select("name").distinct()


def allowlist_bounces(bounces, servers=None) -> DataFrame:
    return scope(bounces, servers).orderBy("name", "uuid", "server_id")


def installed_plugins(plugin_versions) -> DataFrame:
    """The newest version row per server and plugin, without removed plugins (null version)."""
    newest = plugin_versions.groupBy("server_id", "plugin_name").agg(
        F.max_by(F.struct("version", "modified"), F.struct("modified", "id")).alias("m")
    )
    return newest.select("server_id", "plugin_name", "m.version", "m.modified").where(F.col("version").isNotNull())


def plugin_history(plugin_versions, servers=None) -> DataFrame:
    return scope(plugin_versions, servers).orderBy(F.col("modified").desc(), "plugin_name")


def plugin_changes(installed: DataFrame, snapshot: DataFrame, now: int) -> DataFrame:
    """Change rows that turn ``installed`` into ``snapshot``: new and updated versions, null for removed plugins.

    Both hold (server_id, plugin_name, version).
    """
    keys = ["server_id", "plugin_name"]
    before = installed.select(*keys, F.col("version").alias("old"))
    after = snapshot.select(*keys, F.col("version").alias("new"))
    both = before.join(after, keys, "full_outer")
    kind = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "updated")
    return both.select(*keys, F.col("new").alias("version"), F.lit(now).cast("bigint").alias("modified"), kind.alias("change")).where(F.col("change").isNotNull())
