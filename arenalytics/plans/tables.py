"""Wide player and server tables. Every fact is reduced to one row per user before it is joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arenalytics.functions.clock import MINUTE, WEEK
from arenalytics.functions.windows import active, clipped, length, overlap, restrict, scope
from arenalytics.operators import samples as tps
from arenalytics.operators import worlds as wld
from arenalytics.operators.activity import DEFAULT_THRESHOLD, _in_week, index_of
from arenalytics.operators.geo import latest_geolocations
from arenalytics.operators.join_address import latest_of_users
from arenalytics.operators.roster import nickname_lists
from arenalytics.operators.sessions import merge_rows


def _weeks(date: int) -> list[Column]:
    return [F.sum(F.when(_in_week(date, w, True), active()).otherwise(0)).alias(f"w{w}") for w in range(3)]


def _session_stats(sessions, date: int, counted: Column | None = None, measure: Column | None = None) -> DataFrame:
    """Last seen, count, active playtime and the three weekly sums per user in one aggregation."""
    counted = F.lit(True) if counted is None else counted
    measure = active() if measure is None else measure
    return sessions.groupBy("user_id").agg(
        F.max(F.when(counted, F.col("session_end"))).alias("last_seen"),
        F.count_if(counted).alias("session_count"),
        F.sum(F.when(counted, measure)).alias("active_playtime"),
        *_weeks(date),
    )


def _ping_stats(ping) -> DataFrame:
    return ping.groupBy("user_id").agg(
        F.avg("avg_ping").alias("avg_ping"), F.max("max_ping").alias("max_ping"), F.min("min_ping").alias("min_ping")
    )


def _finish(rows, user_info, geolocations, ping, nicknames, threshold: int, banned: bool = True) -> DataFrame:
    """Attach the per-user facts of the chosen rows; the facts are cut to those users before they are reduced."""
    ids = rows.select("user_id")
    out = rows
    if banned:
        bans = restrict(user_info.where("banned"), ids).groupBy("user_id").agg(F.lit(True).alias("banned"))
        out = out.join(bans, "user_id", "left")
    nicks = restrict(nicknames, rows.select("uuid"), "uuid")
    return (
        out.join(latest_geolocations(restrict(geolocations, ids)), "user_id", "left")
        .join(_ping_stats(restrict(ping, ids)), "user_id", "left")
        .join(nickname_lists(nicks), "uuid", "left")
        .select(
            "user_id", "uuid", "name", "registered", F.coalesce("banned", F.lit(False)).alias("banned"), "geolocation", "last_seen",
            F.coalesce("session_count", F.lit(0).cast("bigint")).alias("session_count"),
            F.coalesce("active_playtime", F.lit(0).cast("bigint")).alias("active_playtime"),
            index_of([F.col(f"w{w}") for w in range(3)], threshold).alias("activity_index"),
            "min_ping", "max_ping", "avg_ping", "nicknames",
        )
    )


def _people(users) -> DataFrame:
    return users.select(F.col("id").alias("user_id"), "uuid", "name", "registered")


def network_players(users, user_info, sessions, geolocations, ping, nicknames, date: int, n: int, threshold=DEFAULT_THRESHOLD) -> DataFrame:
    """The ``n`` users seen last (ties by id) with ban, geolocation, session, activity, ping and nickname columns."""
    stats = _session_stats(sessions, date)
    rows = _people(users).join(stats, "user_id", "left").orderBy(F.col("last_seen").desc_nulls_last(), "user_id").limit(n)
    return _finish(rows, user_info, geolocations, ping, nicknames, threshold)


def server_players(users, user_info, sessions, geolocations, ping, nicknames, server_id: int, date: int, n: int, threshold=DEFAULT_THRESHOLD) -> DataFrame:
    """The same for the users registered on one server, over its own sessions and pings."""
    here = user_info.where(F.col("server_id") == server_id).select("user_id", "banned")
    stats = _session_stats(sessions.where(F.col("server_id") == server_id), date)
    rows = _people(users).join(here, "user_id").join(stats, "user_id", "left")
    rows = rows.orderBy(F.col("last_seen").desc_nulls_last(), "user_id").limit(n)
    return _finish(rows, user_info, geolocations, ping.where(F.col("server_id") == server_id), nicknames, threshold, banned=False)


def segment_players(users, user_info, sessions, geolocations, ping, nicknames, members, a: int, b: int, servers=None, threshold=DEFAULT_THRESHOLD) -> DataFrame:
    """Table of a user set. Sessions and pings are cut to the view window and servers, the index is that of the network at ``b``."""
    counted = overlap(a, b)
    if servers:
        counted = counted & F.col("server_id").isin(list(servers))
    stats = _session_stats(restrict(sessions, members), b, counted, clipped(a, b) - F.col("afk_time"))
    rows = restrict(_people(users), members).join(stats, "user_id", "left")
    seen = scope(ping, servers).where(F.col("date").between(a, b))
    return _finish(rows, scope(user_info, servers), geolocations, seen, nicknames, threshold)


def per_server_profiles(users, user_info, sessions, kills, world_times, worlds, join_address) -> DataFrame:
    """One row per user and server: flags, sessions, playtime, kills, deaths, world times, last join address."""
    keys = ["user_id", "server_id"]
    sums = sessions.groupBy(*keys).agg(
        F.max("session_end").alias("last_seen"), F.count("*").alias("session_count"), F.sum(length()).alias("playtime"),
        F.sum("mob_kills").alias("mob_kills"), F.sum("deaths").alias("deaths"),
    )
    fought = kills.groupBy("killer_uuid", "server_id").agg(F.count("*").alias("player_kills"))
    ids = users.select(F.col("id").alias("user_id"), F.col("uuid").alias("killer_uuid"))
    modes = world_times.groupBy(*keys).agg(*[F.sum(f"{m}_time").alias(m) for m in wld.MODES])
    addresses = latest_of_users(sessions, join_address, keys).groupBy(*keys).agg(F.min("join_address").alias("join_address"))
    return (
        user_info.select(*keys, "registered", "opped", "banned")
        .join(sums, keys, "left")
        .join(modes, keys, "left")
        .join(addresses, keys, "left")
        .join(fought.join(ids, "killer_uuid").drop("killer_uuid"), keys, "left")
        .withColumn("player_kills", F.coalesce("player_kills", F.lit(0).cast("bigint")))
    )


def user_profiles(users, user_info, sessions, kills, geolocations, ping, nicknames, date: int, threshold=DEFAULT_THRESHOLD) -> DataFrame:
    """One row per user: identity, totals, activity, kills and deaths, favourite server, geolocation, ping."""
    from arenalytics.operators.combat import kills_and_deaths
    from arenalytics.operators.geo import most_recent

    stats = sessions.groupBy("user_id").agg(
        F.max("session_end").alias("last_seen"), F.count("*").alias("session_count"), F.sum(length()).alias("playtime"),
        F.sum("afk_time").alias("afk_time"), F.sum("mob_kills").alias("mob_kills"), F.sum("deaths").alias("deaths"), *_weeks(date),
    )
    flags = user_info.groupBy("user_id").agg(F.max("opped").alias("operator"), F.max("banned").alias("banned"), F.count("*").alias("servers"))
    pvp = kills_and_deaths(kills).select("uuid", F.col("kills").alias("player_kills"), F.col("deaths").alias("player_deaths"))
    return (
        users.select(F.col("id").alias("user_id"), "uuid", "name", "registered", "times_kicked")
        .join(flags, "user_id", "left")
        .join(stats, "user_id", "left")
        .join(wld.favourite_server(sessions).withColumnRenamed("server_id", "favourite_server"), "user_id", "left")
        .join(most_recent(geolocations), "user_id", "left")
        .join(_ping_stats(ping), "user_id", "left")
        .join(pvp, "uuid", "left")
        .join(nickname_lists(nicknames), "uuid", "left")
        .withColumn("activity_index", index_of([F.col(f"w{w}") for w in range(3)], threshold))
        .drop("w0", "w1", "w2")
        .fillna(0, ["player_kills", "player_deaths"])
    )


def server_list(servers, user_info, sessions, samples, now: int, threshold: float, gap: int = 3 * MINUTE) -> DataFrame:
    """Game servers with totals, weekly uniques and new users, peaks, mean TPS, spikes, down-time and online status."""
    week = now - WEEK
    people = user_info.groupBy("server_id").agg(
        F.countDistinct(F.when(F.col("registered") <= now, F.col("user_id"))).alias("players"),
        F.count_if(F.col("registered").between(week, now)).alias("new_players"),
    )
    unique = sessions.where((F.col("session_end") <= now) & (F.col("session_start") >= week)).groupBy("server_id").agg(
        F.countDistinct("user_id").alias("unique_players")
    )
    in_week = F.col("date").between(week, now)
    found = tps.peaks(samples, now)
    peaks = found.select(
        "server_id", "last_peak_date", "last_peak_players", "best_peak_date", "best_peak_players",
        F.when(F.col("newest_date") >= now - gap, F.col("newest_players")).alias("online"),
    )
    mean = samples.where(in_week & (F.col("tps") >= 0)).groupBy("server_id").agg(F.avg("tps").alias("avg_tps"))
    window = {"7d": WEEK}
    steps = tps.step_numbers(samples, now, threshold, window)
    steps = steps.select("server_id", F.col("low_tps_spikes_7d").alias("low_tps_spikes"), F.col("server_downtime_7d").alias("downtime"))
    running = tps.current_uptime(samples, now, gap).withColumnRenamed("uptime", "current_uptime")
    columns = [
        "players", "new_players", "unique_players", "last_peak_date", "last_peak_players", "best_peak_date", "best_peak_players",
        "avg_tps", "online", "low_tps_spikes", "downtime", "current_uptime",
    ]
    merged = merge_rows([people, unique, peaks, mean, steps, running], ["server_id"], columns)
    game = servers.where(~F.col("is_proxy")).select(F.col("id").alias("server_id"), "uuid", "name")
    counts = ["players", "new_players", "unique_players", "low_tps_spikes", "downtime"]
    return game.join(merged, "server_id", "left").fillna(0, counts)
