"""KPI catalogue: named values of a window, a server scope and optionally each user.

KPIs of one group share one aggregation. A table of many KPIs shares more: all that come from sessions are made of one cell table,
a row per user and server, and all that follow a server's samples through time of one step summary, a row per server. A single
KPI reads only what it needs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arenalytics.functions.clock import MINUTE
from arenalytics.functions.days import count_days, day_words, distinct_days, marked_days, merged_days, per_day
from arenalytics.functions.ordered import step_totals
from arenalytics.functions.stats import ratio
from arenalytics.functions.windows import active, clipped, contained, length, overlap, scope, start_in
from arenalytics.operators import activity, combat, players, samples, worlds
from arenalytics.operators.sessions import average_playtime_per_day, merge_rows

ALL = ("PLAYER", "SERVER", "NETWORK")
NO_PLAYER = ("SERVER", "NETWORK")
ONLY_SERVER = ("SERVER",)
# Fixed value: samples below this TPS count as low.
LOW_TPS = 18.0


@dataclass(frozen=True)
class Scope:
    """Window ``[a, b]``, server ids (none = network), and whether values are wanted per user."""

    a: int
    b: int
    servers: tuple[int, ...] = ()
    per_user: bool = False
    offset: int = 0
    threshold: int = activity.DEFAULT_THRESHOLD
    low_tps: float = LOW_TPS
    now: int | None = None

    @property
    def by(self) -> list[str]:
        return ["user_id"] if self.per_user else []

    @property
    def level(self) -> str:
        return "PLAYER" if self.per_user else ("SERVER" if self.servers else "NETWORK")


@dataclass(frozen=True)
class Group:
    names: tuple[str, ...]
    allowed: tuple[str, ...]
    compute: Callable[[object, Scope], DataFrame]


def _session_sums(t, s: Scope) -> DataFrame:
    chosen = scope(t.sessions, s.servers).where(overlap(s.a, s.b) | start_in(s.a, s.b))
    inside = overlap(s.a, s.b)
    total = F.coalesce(F.sum(F.when(inside, clipped(s.a, s.b))), F.lit(0))
    count = F.count_if(inside)
    afk = F.coalesce(F.sum(F.when(inside, F.col("afk_time"))), F.lit(0))
    return chosen.groupBy(*s.by).agg(
        afk.alias("AFK_TIME"),
        F.coalesce(F.sum(F.when(inside, F.col("deaths"))), F.lit(0)).alias("DEATHS"),
        F.coalesce(F.sum(F.when(inside, F.col("mob_kills"))), F.lit(0)).alias("MOB_KILLS"),
        total.alias("PLAYTIME"),
        F.count_if(start_in(s.a, s.b)).alias("SESSION_COUNT"),
        F.floor(ratio(total, count)).alias("SESSION_LENGTH_AVERAGE"),
    )


def _afk_share(t, s: Scope) -> DataFrame:
    chosen = scope(t.sessions, s.servers).where(overlap(s.a, s.b))
    return chosen.agg(ratio(F.coalesce(F.sum("afk_time"), F.lit(0)), F.coalesce(F.sum(length()), F.lit(0))).alias("AFK_TIME_PERCENTAGE"))


def _per_day(t, s: Scope) -> DataFrame:
    mean = average_playtime_per_day(t.sessions, s.a, s.b, s.offset, s.servers, s.by)
    return mean.select(*s.by, F.col("average_playtime").cast("bigint").alias("PLAYTIME_PER_DAY_AVERAGE"))


def _per_user(t, s: Scope) -> DataFrame:
    chosen = scope(t.sessions, s.servers).where(overlap(s.a, s.b))
    contained = (F.col("session_end") <= s.b) & (F.col("session_start") >= s.a)
    users = chosen.groupBy("user_id").agg(F.sum(clipped(s.a, s.b)).alias("p"), F.max(contained).alias("inside"))
    return users.agg(
        F.coalesce(F.avg("p").cast("bigint"), F.lit(0)).alias("PLAYTIME_PER_PLAYER_AVERAGE"), F.count_if("inside").alias("UNIQUE_PLAYERS_COUNT")
    )


def _unique_average(t, s: Scope) -> DataFrame:
    mean = players.average_unique_players(t.sessions, s.a, s.b, s.offset, s.servers)
    return mean.select(F.coalesce(F.col("average_players").cast("bigint"), F.lit(0)).alias("UNIQUE_PLAYERS_AVERAGE"))


def _registrations(t, s: Scope) -> tuple[DataFrame, str]:
    return (t.user_info, "user_id") if s.servers else (t.users, "id")


def _new(t, s: Scope) -> DataFrame:
    table, user = _registrations(t, s)
    chosen = players.registered_between(table, s.a, s.b, s.servers)
    per_day = chosen.groupBy(((F.col("registered") + s.offset) - F.pmod(F.col("registered") + s.offset, F.lit(86_400_000))).alias("d")).agg(
        F.countDistinct(user).alias("u"), F.count("*").alias("n")
    )
    return per_day.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("NEW_PLAYERS"), F.coalesce(F.avg("u").cast("bigint"), F.lit(0)).alias("NEW_PLAYERS_AVERAGE")
    )


def _retention(t, s: Scope) -> DataFrame:
    """Retained new players; the number of new players is NEW_PLAYERS."""
    return players.retained_players(t.user_info, t.sessions, s.a, s.b, s.servers).withColumnRenamed("players", "NEW_PLAYER_RETENTION")


def _regular(t, s: Scope) -> DataFrame:
    date = min(s.b, s.now) if s.now is not None else s.b
    base = activity.base_users(t.users, t.user_info, s.servers, None if not s.servers else date)
    base = base.where(F.col("registered") <= date)
    index = activity.activity_index(t.sessions, base, date, s.threshold, s.servers)
    return activity.count_within(index, *activity.REGULAR_RANGE).withColumnRenamed("players", "REGULAR_PLAYERS")


def _kills(t, s: Scope) -> DataFrame:
    if s.per_user:
        ids = t.users.select(F.col("id").alias("user_id"), F.col("uuid").alias("killer_uuid"))
        counts = combat.kill_count(t.kills, s.a, s.b, s.servers, ["killer_uuid"])
        return counts.join(ids, "killer_uuid").select("user_id", F.col("kills").alias("PLAYER_KILLS"))
    return combat.kill_count(t.kills, s.a, s.b, s.servers).withColumnRenamed("kills", "PLAYER_KILLS")


def _load(t, s: Scope) -> DataFrame:
    """Every KPI of the samples' metrics from one scan."""
    block = samples.sample_block(t.samples, s.a, s.b, s.low_tps, s.servers)
    return block.select(
        F.col("average_chunks_loaded").cast("bigint").alias("CHUNKS_AVERAGE"),
        F.when(F.col("average_cpu_usage") != -1, F.col("average_cpu_usage") / 100).alias("CPU_AVERAGE"),
        F.col("average_entities").cast("bigint").alias("ENTITIES_AVERAGE"),
        F.col("average_mspt_average").alias("MSPT_AVERAGE"),
        F.col("average_mspt_jitter_avg").alias("MSPT_JITTER_AVERAGE"),
        F.col("max_jitter").alias("MSPT_JITTER_MAX"),
        F.col("max_mspt_95th").alias("MSPT_MAX_95TH"),
        F.col("low_average_mspt").alias("MSPT_AVERAGE_LOW_TPS"),
        F.col("low_max_mspt_95th").alias("MSPT_MAX_95TH_LOW_TPS"),
        F.col("chunks_per_player").cast("bigint").alias("CHUNKS_PER_PLAYER"),
        F.when(F.col("cpu_per_player") != -1, F.col("cpu_per_player") / 100).alias("CPU_IMPACT_PER_PLAYER"),
        F.col("entities_per_chunk").alias("ENTITIES_PER_CHUNK"),
        F.col("mspt_per_chunk").alias("MSPT_IMPACT_PER_CHUNK"),
        F.col("mspt_per_player").alias("MSPT_IMPACT_PER_PLAYER"),
        F.col("max_disk").alias("DISK_MAX"),
        F.col("min_disk").alias("DISK_MIN"),
        F.col("average_players_online").alias("PLAYERS_ONLINE_AVERAGE"),
        F.col("average_ram_usage").cast("bigint").alias("RAM_AVERAGE"),
        F.col("average_tps").alias("TPS_AVERAGE"),
    )


def _proxies(t):
    return t.servers.where("is_proxy").select(F.col("id").alias("server_id"))


def _uptime(t, s: Scope) -> DataFrame:
    """Of the given servers, of the proxies when none is given; per server, then summed."""
    r = samples.up_and_down_time(t.samples, s.a, s.b, s.servers or _proxies(t))
    return r.agg(F.coalesce(F.sum("uptime"), F.lit(0)).alias("UPTIME"), F.coalesce(F.sum("downtime"), F.lit(0)).alias("DOWNTIME"))


def _occupied(t, s: Scope) -> DataFrame:
    r = samples.occupied_time(t.samples, s.a, s.b, s.servers)
    return r.agg(F.coalesce(F.sum("occupied"), F.lit(0)).alias("SERVER_OCCUPIED"))


def _game_servers(t):
    return t.servers.where(~F.col("is_proxy")).select(F.col("id").alias("server_id"))


def _spikes(t, s: Scope) -> DataFrame:
    r = samples.low_tps_spikes(t.samples, s.low_tps, s.a, s.b, s.servers or _game_servers(t))
    return r.agg(F.coalesce(F.sum("spikes"), F.lit(0)).alias("TPS_LOW_SPIKES"))


def _online(t, s: Scope) -> DataFrame:
    """Sum of the newest player counts that are at most two minutes old."""
    now = s.now if s.now is not None else s.b
    recent = t.samples.where(F.col("date") > now - 2 * MINUTE)
    newest = samples.peaks(scope(recent, s.servers or _proxies(t)))
    return newest.agg(F.sum(F.when(F.col("newest_date") > now - 2 * MINUTE, F.col("newest_players"))).alias("PLAYERS_ONLINE"))


def _peak(t, s: Scope) -> DataFrame:
    if s.servers:
        peak = samples.peak_players(t.samples, s.a, s.b, s.servers, by=())
    else:
        peak = samples.network_peak(t.samples, s.a, s.b, _proxies(t))
    return peak.select(F.col("players_online").alias("PLAYERS_ONLINE_PEAK"))


def _current_uptime(t, s: Scope) -> DataFrame:
    now = s.now if s.now is not None else s.b
    return samples.current_uptime(t.samples, now, servers=s.servers or _proxies(t)).agg(F.max("uptime").alias("UPTIME_CURRENT"))


# The names of KPIs.
GROUPS = [
    Group(("AFK_TIME", "DEATHS", "MOB_KILLS", "PLAYTIME", "SESSION_COUNT", "SESSION_LENGTH_AVERAGE"), ALL, _session_sums),
    Group(("AFK_TIME_PERCENTAGE",), NO_PLAYER, _afk_share),
    Group(("PLAYTIME_PER_DAY_AVERAGE",), ALL, _per_day),
    Group(("PLAYTIME_PER_PLAYER_AVERAGE", "UNIQUE_PLAYERS_COUNT"), NO_PLAYER, _per_user),
    Group(("UNIQUE_PLAYERS_AVERAGE",), NO_PLAYER, _unique_average),
    Group(("NEW_PLAYERS", "NEW_PLAYERS_AVERAGE"), NO_PLAYER, _new),
    Group(("NEW_PLAYER_RETENTION",), NO_PLAYER, _retention),
    Group(("REGULAR_PLAYERS",), NO_PLAYER, _regular),
    Group(("PLAYER_KILLS",), ALL, _kills),
    Group(
        (
            "CHUNKS_AVERAGE", "CPU_AVERAGE", "ENTITIES_AVERAGE", "MSPT_AVERAGE", "MSPT_JITTER_AVERAGE", "MSPT_JITTER_MAX", "MSPT_MAX_95TH",
            "MSPT_AVERAGE_LOW_TPS", "MSPT_MAX_95TH_LOW_TPS", "CHUNKS_PER_PLAYER", "CPU_IMPACT_PER_PLAYER", "ENTITIES_PER_CHUNK",
            "MSPT_IMPACT_PER_CHUNK", "MSPT_IMPACT_PER_PLAYER",
        ),
        NO_PLAYER, _load,
    ),
    Group(("DISK_MAX", "DISK_MIN", "PLAYERS_ONLINE_AVERAGE", "RAM_AVERAGE", "TPS_AVERAGE"), ONLY_SERVER, _load),
    Group(("UPTIME", "DOWNTIME"), NO_PLAYER, _uptime),
    Group(("SERVER_OCCUPIED",), NO_PLAYER, _occupied),
    Group(("TPS_LOW_SPIKES",), NO_PLAYER, _spikes),
    Group(("PLAYERS_ONLINE",), NO_PLAYER, _online),
    Group(("PLAYERS_ONLINE_PEAK",), NO_PLAYER, _peak),
    Group(("UPTIME_CURRENT",), NO_PLAYER, _current_uptime),
]
BY_NAME = {name: group for group in GROUPS for name in group.names}


def check(name: str, s: Scope) -> Group | None:
    """The group of a KPI; ValueError when the KPI is unknown or not defined at this level."""
    allowed = BREAKDOWNS[name][0] if name in BREAKDOWNS else BY_NAME[name].allowed if name in BY_NAME else None
    if allowed is None:
        raise ValueError(f"unknown KPI {name}")
    if s.level not in allowed or (s.per_user and "PLAYER" not in allowed):
        raise ValueError(f"{name} is not defined for {s.level.lower()} scope")
    return BY_NAME.get(name)


MOST_WORDS = 32
"""Integers at most that mark days; a window of over five years counts its days apart."""


def _session_cells(t, s: Scope) -> DataFrame:
    """Every KPI of the sessions in one row, from one read of them.

    A cell holds the sums of a user on a server, the weeks of the activity index, and the days played as bits; cells meet the
    registrations on that server, users their register date.
    """
    half, date = s.b - (s.b - s.a) // 2, min(s.b, s.now) if s.now is not None else s.b
    inside, whole = overlap(s.a, s.b), contained(s.a, s.b)
    in_weeks = (F.col("session_end") >= date - 3 * activity.WEEK) & (F.col("session_start") <= date)
    chosen = scope(t.sessions, s.servers).where(inside | start_in(s.a, s.b) | in_weeks)
    weeks = [F.sum(F.when(activity._in_week(date, w, True), active()).otherwise(0)).alias(f"w{w}") for w in range(3)]
    sums = {
        "afk": F.when(inside, F.col("afk_time")), "deaths": F.when(inside, F.col("deaths")), "mobs": F.when(inside, F.col("mob_kills")), "played": F.when(inside, clipped(s.a, s.b)),
        "n": F.when(inside, 1), "starts": F.when(start_in(s.a, s.b), 1), "full": F.when(inside, length()), "daily": F.when(whole, length()),
    }
    cells = chosen.groupBy("user_id", "server_id").agg(
        *[F.sum(c).alias(n) for n, c in sums.items()], *weeks, *marked_days(whole, "session_start", s.a, s.b, s.offset, "d"), F.max(whole).alias("inside"), F.max(contained(half, s.b)).alias("late")
    )
    fresh = players.registered_between(t.user_info, s.a, s.b, s.servers).select("user_id", "server_id").distinct().withColumn("fresh", F.lit(True))
    seen = cells.join(fresh, ["user_id", "server_id"], "left").withColumn("stayed", F.coalesce(F.col("fresh") & F.col("late"), F.lit(False)))
    users = seen.groupBy("user_id").agg(
        *[F.sum(n).alias(n) for n in (*sums, "w0", "w1", "w2")], *merged_days(s.a, s.b, "d"), F.max("inside").alias("inside"), F.max("stayed").alias("stayed")
    )
    base = activity.base_users(t.users, t.user_info, s.servers, date).select("user_id", F.lit(True).alias("known"))
    index = activity.index_of([F.col(f"w{w}") for w in range(3)], s.threshold)
    low, high = activity.REGULAR_RANGE
    regular = F.coalesce(F.col("known"), F.lit(False)) & (index >= low) & (index < high)
    total = lambda n: F.coalesce(F.sum(n), F.lit(0))
    days = distinct_days(s.a, s.b, "d")
    return users.join(base, "user_id", "left").agg(
        total("afk").alias("AFK_TIME"), total("deaths").alias("DEATHS"), total("mobs").alias("MOB_KILLS"), total("played").alias("PLAYTIME"),
        total("starts").alias("SESSION_COUNT"), F.floor(ratio(total("played"), total("n"))).alias("SESSION_LENGTH_AVERAGE"),
        ratio(total("afk"), total("full")).alias("AFK_TIME_PERCENTAGE"), per_day(F.sum("daily"), days).alias("PLAYTIME_PER_DAY_AVERAGE"),
        F.coalesce(F.avg("played").cast("bigint"), F.lit(0)).alias("PLAYTIME_PER_PLAYER_AVERAGE"), F.count_if("inside").alias("UNIQUE_PLAYERS_COUNT"),
        F.coalesce(per_day(F.sum(count_days(s.a, s.b, "d")), days), F.lit(0)).alias("UNIQUE_PLAYERS_AVERAGE"), F.count_if("stayed").alias("NEW_PLAYER_RETENTION"), F.count_if(regular).alias("REGULAR_PLAYERS"),
    )


def _step_cells(t, s: Scope) -> DataFrame:
    """Every KPI that follows a server's samples through time in one row, from one read of them."""
    now, gap = s.now if s.now is not None else s.b, samples.DOWN_GAP

    def length_of(p, c):
        return F.when((p["date"] >= s.a) & (c["date"] <= s.b), c["date"] - p["date"])

    def entered(p, c):
        first = p.isNull() | (p["date"] < s.a) | (p["tps"] >= s.low_tps)
        return F.when(c["date"].between(s.a, s.b) & (c["tps"] > 0) & (c["tps"] < s.low_tps) & first, 1)

    sums = {
        "up": lambda p, c: F.when(length_of(p, c) <= samples.UP_GAP, length_of(p, c)),
        "down": lambda p, c: F.when(length_of(p, c) >= gap, length_of(p, c)),
        "spikes": entered,
    }
    start = {"start": lambda p, c: F.when(p.isNull() | (c["date"] - p["date"] > gap), c["date"])}
    busy = {"occupied": (lambda c: c["players"] > 0, lambda p, c: F.when(length_of(p, c) < gap, length_of(p, c)))}
    state = {"tps": F.min("tps"), "players": F.max("players_online")}
    found = step_totals(scope(t.samples, s.servers), ["server_id"], "date", sums, start, state, among=busy)
    if s.servers:
        found = found.withColumns({"proxy": F.lit(True), "game": F.lit(True)})
    else:
        kinds = t.servers.select(F.col("id").alias("server_id"), F.col("is_proxy").alias("proxy"), (~F.col("is_proxy")).alias("game"))
        found = found.join(kinds, "server_id", "left")
    total = lambda n, of: F.coalesce(F.sum(F.when(F.col(of), F.col(n))), F.lit(0))
    alive = F.col("proxy") & (F.lit(now) - F.col("last") <= gap)
    return found.agg(
        total("up", "proxy").alias("UPTIME"), total("down", "proxy").alias("DOWNTIME"), F.coalesce(F.sum("occupied"), F.lit(0)).alias("SERVER_OCCUPIED"),
        total("spikes", "game").alias("TPS_LOW_SPIKES"), F.max(F.when(alive, F.lit(now) - F.col("start"))).alias("UPTIME_CURRENT"),
        F.sum(F.when(F.col("proxy") & (F.col("last") > now - 2 * MINUTE), F.col("final.players"))).alias("PLAYERS_ONLINE"),
    )


SHARED = {
    _session_cells: (_session_sums, _afk_share, _per_day, _per_user, _unique_average, _retention, _regular),
    _step_cells: (_uptime, _occupied, _spikes, _online, _current_uptime),
}
"""The groups that one cell table makes; it stands in for two or more of them."""


def _sharing(by_source: dict[Callable, list[str]], s: Scope) -> dict[Callable, list[str]]:
    out = dict(by_source)
    if s.per_user or day_words(s.a, s.b) > MOST_WORDS:
        return out
    for cells, groups in SHARED.items():
        held = [g for g in groups if g in out]
        if len(held) > 1:
            out[cells] = [name for g in held for name in out.pop(g)]
    return out


def kpi_value(t, name: str, s: Scope) -> DataFrame:
    """The value of one KPI, a row per user when ``per_user`` is set."""
    group = check(name, s)
    return group.compute(t, s).select(*s.by, F.col(name).cast("double").alias("value"))


def kpi_table(t, s: Scope, names: Sequence[str] | None = None) -> DataFrame:
    """Long rows ``(kpi, value)`` (with user_id per user) of the named KPIs, by default all that are defined at this level."""
    wanted = list(names) if names is not None else [n for n, g in BY_NAME.items() if s.level in g.allowed]
    by_source: dict[Callable, list[str]] = {}
    for name in wanted:
        by_source.setdefault(check(name, s).compute, []).append(name)
    out = None
    for compute, chosen in _sharing(by_source, s).items():
        pairs = ", ".join(f"'{n}', cast({n} as double)" for n in chosen)
        part = compute(t, s).selectExpr(*s.by, f"stack({len(chosen)}, {pairs}) as (kpi, value)")
        out = part if out is None else out.unionByName(part)
    return out


def _world_totals(t, s: Scope) -> DataFrame:
    return worlds.world_totals(t.world_times, t.worlds, t.sessions, s.a, s.b, s.servers, s.by)


def _best_of(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """The category with the greatest time above 0 (first name on ties) out of the total time."""
    best = F.min_by(F.struct("category", "time"), F.struct(-F.col("time"), F.col("category")))
    return rows.groupBy(*by).agg(best.alias("m"), F.sum("time").alias("total")).where(F.col("m.time") > 0).select(*by, "m.category", "m.time", "total")


def _most_active_world(t, s: Scope) -> DataFrame:
    return _best_of(worlds.total_per_world(_world_totals(t, s), s.by).select(*s.by, F.col("world_name").alias("category"), F.col("total").alias("time")), s.by)


def _most_active_mode(t, s: Scope) -> DataFrame:
    return _best_of(worlds.by_mode(_world_totals(t, s), s.by).select(*s.by, F.col("mode").alias("category"), "time"), s.by)


def _world_pie(t, s: Scope) -> DataFrame:
    pie = worlds.world_pie(_world_totals(t, s), by=s.by)
    return pie.select(*s.by, F.col("name").alias("category"), F.col("total").alias("time"))


def _server_pie(t, s: Scope) -> DataFrame:
    played = scope(t.sessions, s.servers).where(overlap(s.a, s.b)).groupBy(*s.by, "server_id").agg(F.sum(clipped(s.a, s.b)).alias("time"))
    names = t.servers.select(F.col("id").alias("server_id"), F.col("name").alias("category"))
    return played.join(names, "server_id").select(*s.by, "category", "time")


BREAKDOWNS = {
    "MOST_ACTIVE_GAME_MODE": (ALL, _most_active_mode),
    "MOST_ACTIVE_WORLD": (ALL, _most_active_world),
    "SERVER_PIE": (ALL, _server_pie),
    "WORLD_PIE": (ALL, _world_pie),
}


def kpi_breakdown(t, name: str, s: Scope) -> DataFrame:
    """KPIs with a value per category (world, mode, server)."""
    check(name, s)
    return BREAKDOWNS[name][1](t, s)


def occupied_out_of_uptime(t, s: Scope) -> DataFrame:
    """Occupied time, up-time and their ratio (−1 without up-time)."""
    up = samples.up_and_down_time(t.samples, s.a, s.b, s.servers).select("server_id", "uptime")
    busy = samples.occupied_time(t.samples, s.a, s.b, s.servers)
    both = merge_rows([up, busy], ["server_id"], ["uptime", "occupied"])
    sums = both.agg(F.coalesce(F.sum("occupied"), F.lit(0)).alias("occupied"), F.coalesce(F.sum("uptime"), F.lit(0)).alias("uptime"))
    return sums.withColumn("share", ratio(F.col("occupied"), F.col("uptime"), -1.0))


def with_open_sessions(stored: DataFrame, open_sessions: DataFrame, now: int) -> DataFrame:
    """Stored sessions plus the still open ones, ended provisionally at ``now``."""
    provisional = open_sessions.where(F.col("session_start") <= now).withColumn("session_end", F.lit(now).cast("bigint"))
    return stored.unionByName(provisional, allowMissingColumns=True)
