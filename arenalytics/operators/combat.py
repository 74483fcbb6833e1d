"""Kills, deaths, weapons and top lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arenalytics.functions.windows import active, length, overlap, scope, strictly_inside


def kills_between(kills, a, b, servers=None) -> DataFrame:
    return scope(kills, servers).where(F.col("date").between(a, b))


def without_self_kills(kills) -> DataFrame:
    return kills.where(F.col("killer_uuid") != F.col("victim_uuid"))


def kill_count(kills, a, b, servers=None, by=()) -> DataFrame:
    return kills_between(kills, a, b, servers).groupBy(*by).agg(F.count("*").alias("kills"))


def mob_kills_and_deaths(sessions, a, b, servers=None, by=()) -> DataFrame:
    return scope(sessions, servers).where(overlap(a, b)).groupBy(*by).agg(
        F.coalesce(F.sum("mob_kills"), F.lit(0)).alias("mob_kills"), F.coalesce(F.sum("deaths"), F.lit(0)).alias("deaths")
    )


def kills_and_deaths(kills, keys: Sequence[str] = ()) -> DataFrame:
    """Player kills and player deaths per uuid (and ``keys``), each kill counted once on either side."""
    sides = kills.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.col("killer_uuid").alias("uuid"), F.lit(1).alias("k"), F.lit(0).alias("d")),
                F.struct(F.col("victim_uuid").alias("uuid"), F.lit(0).alias("k"), F.lit(1).alias("d")),
            )
        ).alias("s"),
    )
    return sides.groupBy(*keys, F.col("s.uuid").alias("uuid")).agg(F.sum("s.k").alias("kills"), F.sum("s.d").alias("deaths"))


def average_kdr(kills, users, a, b, servers=None, by=("server_id",)) -> DataFrame:
    """Mean kill/death ratio of the known users that have both kills and deaths; 0 without any."""
    both = kills_and_deaths(kills_between(kills, a, b, servers), by).where((F.col("kills") > 0) & (F.col("deaths") > 0))
    known = both.join(users.select("uuid"), "uuid", "left_semi")
    return known.groupBy(*by).agg(F.coalesce(F.avg(F.col("kills") / F.col("deaths")), F.lit(0.0)).alias("kdr"))


def recent_kills(kills, users, n: int, servers=None) -> DataFrame:
    """Newest ``n`` kills with the names of both players; names are looked up for those rows only."""
    newest = scope(kills, servers).orderBy(F.col("date").desc(), F.col("id").desc()).limit(n)
    killer = users.select(F.col("uuid").alias("killer_uuid"), F.col("name").alias("killer_name"))
    victim = users.select(F.col("uuid").alias("victim_uuid"), F.col("name").alias("victim_name"), F.col("registered").alias("victim_registered"))
    return newest.join(killer, "killer_uuid").join(victim, "victim_uuid")


def kills_by(kills, users, side: str) -> DataFrame:
    """All kills (``killer``) or deaths (``victim``) with the other player's name."""
    other = "victim" if side == "killer" else "killer"
    names = users.select(F.col("uuid").alias(f"{other}_uuid"), F.col("name").alias(f"{other}_name"))
    return kills.join(names, f"{other}_uuid")


def top_weapons(kills, a, b, n: int, servers=None, by: Sequence[str] = ()) -> DataFrame:
    """Most used weapons, ties by weapon name. With ``by`` the ``n`` best of each group."""
    counts = kills_between(kills, a, b, servers).groupBy(*by, "weapon").agg(F.count("*").alias("kills"))
    order = [F.col("kills").desc(), F.col("weapon").asc()]
    if not by:
        return counts.orderBy(*order).limit(n)
    ranked = counts.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("place") <= n)


def versus(sessions, kills, users, a=None, b=None) -> DataFrame:
    """Per user: player and mob kills, deaths and both ratios (0 deaths count as 1)."""
    chosen = sessions if a is None else sessions.where(overlap(a, b))
    fought = kills if a is None else kills.where((F.col("date") > a) & (F.col("date") <= b))
    mobs = chosen.groupBy("user_id").agg(F.sum("mob_kills").alias("mob_kills"), F.sum("deaths").alias("deaths"))
    pvp = kills_and_deaths(fought).select("uuid", F.col("kills").alias("player_kills"), F.col("deaths").alias("player_deaths"))
    rows = users.select(F.col("id").alias("user_id"), "uuid").join(mobs, "user_id", "left").join(pvp, "uuid", "left")
    zero = {c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("mob_kills", "deaths", "player_kills", "player_deaths")}
    rows = rows.withColumns(zero).withColumn("mob_deaths", F.col("deaths") - F.col("player_deaths"))

    def per(kind: str):
        return F.col(f"{kind}_kills").cast("double") / F.when(F.col(f"{kind}_deaths") != 0, F.col(f"{kind}_deaths")).otherwise(1)

    return rows.select(
        "user_id", "player_kills", "player_deaths", "mob_kills", "mob_deaths", "deaths",
        per("player").alias("kdr"), per("mob").alias("mob_kdr"),
    )


def time_to_death(kills, users) -> DataFrame:
    """Each kill with the time since the victim registered."""
    victims = users.select(F.col("uuid").alias("victim_uuid"), "registered")
    return kills.join(victims, "victim_uuid").select("id", (F.col("date") - F.col("registered")).alias("since_registered"))


def _top(per_user: DataFrame, users, n: int, offset: int) -> DataFrame:
    best = per_user.orderBy(F.col("score").desc(), F.col("user_id").asc()).offset(offset).limit(n)
    return best.join(users.select(F.col("id").alias("user_id"), "name"), "user_id")


def top_playtime(sessions, users, a, b, servers=None, n=10, offset=0, only_active: bool = False) -> DataFrame:
    """Leaders by playtime of the sessions strictly inside the window. Users are told apart by id, not name."""
    inside = (F.col("session_start") > a) & (F.col("session_end") < b)
    measure = active() if only_active else length()
    per_user = scope(sessions, servers).where(inside).groupBy("user_id").agg(F.sum(measure).alias("score"))
    return _top(per_user, users, n, offset)


def top_killers(kills, users, a, b, servers=None, n=10, offset=0) -> DataFrame:
    counts = scope(kills, servers).where(strictly_inside("date", a, b)).groupBy("killer_uuid").agg(F.count("*").alias("score"))
    ids = users.select(F.col("uuid").alias("killer_uuid"), F.col("id").alias("user_id"))
    return _top(counts.join(ids, "killer_uuid").select("user_id", "score"), users, n, offset)


