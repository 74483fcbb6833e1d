"""Session counts, playtime, AFK time, lengths and listings.

``by`` lists grouping columns (none = one row for the whole network), ``servers`` limits the scope.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arenalytics.functions.clock import day, hour
from arenalytics.functions.stats import grouped_quantile, int_ratio, ratio
from arenalytics.functions.windows import active, clipped, contained, length, overlap, restrict, scope, start_in


def _group(df: DataFrame, by: Sequence[str]):
    return df.groupBy(*by)


def session_count(sessions: DataFrame, a: int, b: int, servers=None, by: Sequence[str] = ()) -> DataFrame:
    return _group(scope(sessions, servers).where(start_in(a, b)), by).agg(F.count("*").alias("sessions"))


def session_count_per_day(sessions, a, b, offset=0, servers=None, by=()) -> DataFrame:
    chosen = scope(sessions, servers).where(start_in(a, b))
    return chosen.groupBy(*by, day("session_start", offset).alias("date")).agg(F.count("*").alias("sessions"))


def playtime(sessions, a, b, servers=None, by=()) -> DataFrame:
    """Playtime and session count of the sessions overlapping the window, cut at its edges."""
    return _group(scope(sessions, servers).where(overlap(a, b)), by).agg(
        F.coalesce(F.sum(clipped(a, b)), F.lit(0)).alias("playtime"), F.count("*").alias("sessions")
    )


def playtime_with_network_total(sessions, a, b, servers=None) -> DataFrame:
    """Per-server rows and the network row (null server) in one aggregation."""
    chosen = scope(sessions, servers).where(overlap(a, b)).select("server_id", clipped(a, b).alias("p"))
    return chosen.rollup("server_id").agg(F.sum("p").alias("playtime"), F.count("*").alias("sessions"))


def playtime_per_day(sessions, a, b, offset=0, servers=None, by=()) -> DataFrame:
    chosen = scope(sessions, servers).where(contained(a, b))
    return chosen.groupBy(*by, day("session_start", offset).alias("date")).agg(F.sum(length()).alias("playtime"))


def average_playtime_per_day(sessions, a, b, offset=0, servers=None, by=()) -> DataFrame:
    """Days without sessions do not count."""
    return _group(playtime_per_day(sessions, a, b, offset, servers, by), by).agg(F.avg("playtime").alias("average_playtime"))


def average_playtime_per_player(sessions, a, b, servers=None, by=()) -> DataFrame:
    per_user = scope(sessions, servers).where(overlap(a, b)).groupBy(*by, "user_id").agg(F.sum(clipped(a, b)).alias("p"))
    return _group(per_user, by).agg(F.avg("p").alias("average_playtime"))


def average_afk_per_player(sessions, a, b, servers=None, by=()) -> DataFrame:
    per_user = scope(sessions, servers).where(overlap(a, b)).groupBy(*by, "user_id").agg(F.sum("afk_time").alias("p"))
    return _group(per_user, by).agg(F.avg("p").alias("average_afk"))


def afk_time(sessions, a, b, servers=None, by=()) -> DataFrame:
    """AFK total (not cut at the window) and its share of the session time."""
    total = F.coalesce(F.sum("afk_time"), F.lit(0))
    return _group(scope(sessions, servers).where(overlap(a, b)), by).agg(
        total.alias("afk_time"), ratio(total, F.coalesce(F.sum(length()), F.lit(0))).alias("afk_share")
    )


def active_playtime(sessions, a, b, servers=None, by=()) -> DataFrame:
    return _group(scope(sessions, servers).where(overlap(a, b)), by).agg(
        F.coalesce(F.sum(clipped(a, b) - F.col("afk_time")), F.lit(0)).alias("active_playtime")
    )


def last_seen(sessions, servers=None, by=("user_id",)) -> DataFrame:
    return _group(scope(sessions, servers), by).agg(F.max("session_end").alias("last_seen"))


def earliest_start(sessions, servers=None, by=()) -> DataFrame:
    return _group(scope(sessions, servers), by).agg(F.coalesce(F.min("session_start"), F.lit(-1)).alias("earliest_start"))


def users_played_between(sessions, a, b, servers=None) -> DataFrame:
    return scope(sessions, servers).where(overlap(a, b)).select("user_id").distinct()


def users_last_seen_between(sessions, a, b, servers=None) -> DataFrame:
    return last_seen(sessions, servers).where(F.col("last_seen").between(a, b)).select("user_id")


def summary_of_players(sessions, users, a, b, servers=None) -> DataFrame:
    """Totals and per-player means of a user set; the set's own size is the denominator, −1 when it is empty.

    The set contributes rows of its own to the one aggregation, so no scalar has to be joined.
    """
    chosen = restrict(scope(sessions, servers).where(start_in(a, b)), users).select(
        F.lit(0).alias("player"),
        clipped(a, b).alias("p"),
        (clipped(a, b) - F.col("afk_time")).alias("act"),
        F.lit(1).alias("s"),
    )
    members = users.select(F.col(users.columns[0]).alias("user_id")).distinct().select(
        F.lit(1).alias("player"), F.lit(0).cast("bigint").alias("p"), F.lit(0).cast("bigint").alias("act"), F.lit(0).alias("s")
    )
    sums = chosen.unionByName(members).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("player", "p", "act", "s")]
    )
    n, p, act, s = (F.col(c) for c in ("player", "p", "act", "s"))
    return sums.select(
        p.alias("total_playtime"),
        int_ratio(p, n, -1).alias("average_playtime"),
        (p - act).alias("total_afk_playtime"),
        int_ratio(p - act, n, -1).alias("average_afk_playtime"),
        act.alias("total_active_playtime"),
        int_ratio(act, n, -1).alias("average_active_playtime"),
        s.alias("total_sessions"),
        int_ratio(s, n, -1).alias("average_sessions"),
        int_ratio(p, s, -1).alias("average_session_length"),
    )


def latest_sessions(sessions, n: int, servers=None) -> DataFrame:
    """Per server every session that starts at or after the n-th latest start (ties kept).

    The hours that can hold the newest ``n`` are found on hourly counts first, and sessions are ranked within their
    hour, so no task sees all sessions of a server.
    """
    chosen = scope(sessions, servers)
    newest = F.col("session_start").desc()
    hours = chosen.withColumn("_hour", hour("session_start"))
    later = Window.partitionBy("server_id").orderBy(F.col("_hour").desc()).rowsBetween(Window.unboundedPreceding, -1)
    wanted = (
        hours.groupBy("server_id", "_hour")
        .agg(F.count("*").alias("_c"))
        .select("server_id", "_hour", F.coalesce(F.sum("_c").over(later), F.lit(0)).alias("_before"))
        .where(F.col("_before") < n)
    )
    rank = F.col("_before") + F.rank().over(Window.partitionBy("server_id", "_hour").orderBy(newest))
    kept = hours.join(wanted, ["server_id", "_hour"]).withColumn("_rank", rank).where(F.col("_rank") <= n)
    return kept.select(*sessions.columns)


def sessions_between(sessions, a, b, servers=None, users=None, limit: int | None = None) -> DataFrame:
    """Listing of sessions starting in ``[a, b]``, newest first; all of them unless a ``limit`` is asked for."""
    chosen = restrict(scope(sessions, servers), users).where(F.col("session_start").between(a, b))
    ordered = chosen.orderBy(F.col("session_start").desc(), F.col("id").desc())
    return ordered if limit is None else ordered.limit(limit)


def sessions_of_user(sessions, user_id: int) -> DataFrame:
    return sessions.where(F.col("user_id") == user_id).orderBy(F.col("session_start").desc(), F.col("id").desc())


def light_scan(sessions, users, servers, a, b, scope_servers=None) -> DataFrame:
    """Sessions with natural keys and without nested children."""
    names = users.select(F.col("id").alias("user_id"), F.col("uuid").alias("user_uuid"), F.col("name").alias("user_name"), "registered")
    places = servers.select(F.col("id").alias("server_id"), F.col("uuid").alias("server_uuid"), F.col("name").alias("server_name"))
    chosen = scope(sessions, scope_servers).where(F.col("session_start").between(a, b))
    return chosen.join(names, "user_id").join(places, "server_id").select(
        "id", "user_uuid", "user_name", "registered", "server_uuid", "server_name",
        "session_start", "session_end", "mob_kills", "deaths", "afk_time",
    )


def merge_rows(frames: list[DataFrame], by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Combine frames that hold one row per ``by`` and different columns, without a join."""
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.unionByName(frame, allowMissingColumns=True)
    return merged.groupBy(*by).agg(*[F.max(c).alias(c) for c in columns])


def length_stats(sessions, by=()) -> DataFrame:
    """Longest, mean and exact median session length; −1, 0 and −1 when there is none."""
    lengths = sessions.select(*by, length().alias("len"))
    basic = _group(lengths, by).agg(F.max("len").alias("longest"), F.avg("len").cast("bigint").alias("average"))
    median = grouped_quantile(lengths, list(by), "len", into="median")
    merged = merge_rows([basic, median], by, ["longest", "average", "median"])
    return merged.select(
        *by,
        F.coalesce("longest", F.lit(-1)).alias("longest"),
        F.coalesce("average", F.lit(0)).alias("average"),
        F.coalesce("median", F.lit(-1.0)).alias("median"),
    )


def activity_block(sessions, now: int, windows: dict[str, int]) -> DataFrame:
    """Per user, for each named look-back: playtime, active and AFK time, mean and median length, counts.

    ``windows`` maps a suffix to its length, e.g. ``{"30d": 30 * DAY, "7d": 7 * DAY}``.
    """
    widest = now - max(windows.values())
    chosen = sessions.where(overlap(widest, now))

    def inside(span: int) -> Column:
        return overlap(now - span, now)

    aggs, names = [], []
    for tag, span in windows.items():
        aggs += [
            F.sum(F.when(inside(span), length()).otherwise(0)).alias(f"playtime_{tag}"),
            F.sum(F.when(inside(span), active()).otherwise(0)).alias(f"active_playtime_{tag}"),
            F.sum(F.when(inside(span), F.col("afk_time")).otherwise(0)).alias(f"afk_time_{tag}"),
            F.coalesce(F.avg(F.when(inside(span), length())).cast("bigint"), F.lit(0)).alias(f"average_session_length_{tag}"),
            F.count(F.when(inside(span), 1)).alias(f"session_count_{tag}"),
            F.sum(F.when(inside(span), F.col("mob_kills")).otherwise(0)).alias(f"mob_kill_count_{tag}"),
            F.sum(F.when(inside(span), F.col("deaths")).otherwise(0)).alias(f"death_count_{tag}"),
        ]
        names += [
            f"{n}_{tag}"
            for n in (
                "playtime", "active_playtime", "afk_time", "average_session_length", "session_count", "mob_kill_count", "death_count",
            )
        ]
    frames = [chosen.groupBy("user_id").agg(*aggs)]
    medians = []
    for tag, span in windows.items():
        into = f"median_session_length_{tag}"
        lengths = chosen.where(inside(span)).select("user_id", length().alias("len"))
        frames.append(grouped_quantile(lengths, ["user_id"], "len", into=into))
        medians.append(into)
    merged = merge_rows(frames, ["user_id"], names + medians)
    return merged.withColumns({m: F.coalesce(m, F.lit(-1.0)) for m in medians})


def session_length_average(sessions, a, b, servers=None, by=()) -> DataFrame:
    """Clipped playtime over session count, 0 without sessions."""
    sums = playtime(sessions, a, b, servers, by)
    return sums.select(*by, int_ratio(F.col("playtime"), F.col("sessions")).alias("average_length"))


def unique_users(sessions, by=()) -> DataFrame:
    return _group(sessions, by).agg(F.countDistinct("user_id").alias("users"))


def latest_and_previous(sessions) -> DataFrame:
    """Start and id of the newest and the second newest finished session of every user.

    Two rows per user survive the map side, so a user with very many sessions is not gathered.
    """
    order = Window.partitionBy("user_id").orderBy(F.col("session_start").desc(), F.col("id").desc())
    top = sessions.select("user_id", "id", "session_start", F.row_number().over(order).alias("n")).where(F.col("n") <= 2)
    return top.groupBy("user_id").agg(
        F.max(F.when(F.col("n") == 1, F.col("id"))).alias("latest_id"),
        F.max(F.when(F.col("n") == 1, F.col("session_start"))).alias("latest_start"),
        F.max(F.when(F.col("n") == 2, F.col("id"))).alias("previous_id"),
        F.max(F.when(F.col("n") == 2, F.col("session_start"))).alias("previous_start"),
    )


def per_server_breakdown(sessions, user_kills: DataFrame | None = None) -> DataFrame:
    """Per user and server: counts, playtime, AFK, longest and median length, kills, deaths, last seen."""
    keys = ["user_id", "server_id"]
    lengths = sessions.select(*keys, length().alias("len"))
    sums = sessions.groupBy(*keys).agg(
        F.count("*").alias("session_count"),
        F.sum(length()).alias("playtime"),
        F.sum("afk_time").alias("afk_time"),
        F.max(length()).alias("longest_session_length"),
        F.sum("mob_kills").alias("mob_kills"),
        F.sum("deaths").alias("deaths"),
        F.max("session_end").alias("last_seen"),
    )
    median = grouped_quantile(lengths, keys, "len", into="session_median")
    return sums.join(median, keys)


def online_at(sessions, instant: int, servers=None) -> DataFrame:
    inside = (F.col("session_start") < instant) & (F.col("session_end") > instant)
    return scope(sessions, servers).where(inside).select("user_id").distinct()


def played_between(sessions, a, b) -> DataFrame:
    """Users with a session that starts or ends inside the closed window."""
    edge = F.col("session_start").between(a, b) | F.col("session_end").between(a, b)
    return sessions.where(edge).select("user_id").distinct()
