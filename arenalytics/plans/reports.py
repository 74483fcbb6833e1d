"""Composite reports. All windows of a part are conditional aggregates of one pass; parts of different kinds read a fact again.

``by`` is ``["server_id"]`` for one row per server or ``[]`` for the whole network.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arenalytics.functions.clock import DAY, MINUTE, MONTH, WEEK, bucket, day
from arenalytics.functions.days import count_days, distinct_days, marked_days, per_day
from arenalytics.functions.stats import grouped_quantile, int_ratio, ratio, trend_columns
from arenalytics.functions.windows import active, clipped, contained, length, overlap, start_in
from arenalytics.operators import activity as act
from arenalytics.operators import combat, geo, join_address, joins, ping, series, worlds
from arenalytics.operators import samples as tps
from arenalytics.operators.sessions import merge_rows

Windows = dict[str, tuple[int, int]]


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


# Online activity


def online_windows(now: int) -> Windows:
    return {
        "30d": (now - MONTH, now), "before": (now - MONTH, now - MONTH // 2), "after": (now - MONTH // 2, now),
        "7d": (now - WEEK, now), "24h": (now - DAY, now),
    }


def _session_numbers(sessions, windows: Windows, offset: int, by: Sequence[str]) -> DataFrame:
    """Uniques, per-day means, playtime and session counts of every window from one row per user, whose days are bits."""
    lo, hi = min(a for a, _ in windows.values()), max(b for _, b in windows.values())
    sums = []
    for t, (a, b) in windows.items():
        sums += [
            *marked_days(contained(a, b), "session_start", a, b, offset, f"days_{t}_"),
            F.sum(F.when(overlap(a, b), clipped(a, b)).otherwise(0)).alias(f"play_{t}"),
            F.count_if(start_in(a, b)).alias(f"n_{t}"),
            F.sum(F.when(contained(a, b), length()).otherwise(0)).alias(f"len_{t}"),
        ]
    users = sessions.where(overlap(lo, hi)).groupBy(*by, "user_id").agg(*sums)
    found = []
    for t, (a, b) in windows.items():
        name = f"days_{t}_"
        own, every = count_days(a, b, name), distinct_days(a, b, name)
        found += [
            F.count_if(own > 0).alias(f"unique_players_{t}"), _zero(F.sum(f"play_{t}")).alias(f"playtime_{t}"), _zero(F.sum(f"n_{t}")).alias(f"sessions_{t}"),
            _zero(per_day(F.sum(own), every)).alias(f"unique_players_avg_{t}"), _zero(per_day(F.sum(f"len_{t}"), every)).alias(f"playtime_avg_{t}"),
        ]
    return users.groupBy(*by).agg(*found)


def _new_numbers(registrations, windows: Windows, offset: int, by: Sequence[str]) -> DataFrame:
    lo, hi = min(a for a, _ in windows.values()), max(b for _, b in windows.values())
    days = (
        registrations.where(F.col("registered").between(lo, hi))
        .groupBy(*by, day("registered", offset).alias("date"))
        .agg(*[F.count_if(F.col("registered").between(a, b)).alias(f"n_{t}") for t, (a, b) in windows.items()])
    )
    return days.groupBy(*by).agg(
        *[_zero(F.sum(f"n_{t}")).alias(f"new_players_{t}") for t in windows],
        *[_zero(F.avg(F.when(F.col(f"n_{t}") > 0, F.col(f"n_{t}"))).cast("bigint")).alias(f"new_players_avg_{t}") for t in windows],
    )


def _retention_numbers(user_info, sessions, windows: Windows, now: int, threshold: int) -> DataFrame:
    """Retained new players of the 30- and 7-day windows and the predicted ones of the last day, per server."""
    keys = ["server_id", "user_id"]
    halves = {t: b - (b - a) // 2 for t, (a, b) in windows.items()}
    lo = min(now - 3 * WEEK, *halves.values())
    sums = (
        sessions.where((F.col("session_end") >= lo) & (F.col("session_start") <= now))
        .groupBy(*keys)
        .agg(
            *[F.sum(F.when(act._in_week(now, w, True), active()).otherwise(0)).alias(f"w{w}") for w in range(3)],
            *[F.max(contained(halves[t], now)).alias(f"late_{t}") for t in ("30d", "7d")],
        )
    )
    rows = (
        user_info.where(F.col("registered").between(windows["30d"][0], now))
        .select(*keys, "registered")
        .join(sums, keys, "left")
        .withColumn("index", act.index_of([F.col(f"w{w}") for w in range(3)], threshold))
        .withColumns({f"late_{t}": F.coalesce(f"late_{t}", F.lit(False)) for t in ("30d", "7d")})
    )

    def fresh(t):
        return F.col("registered").between(*windows[t])

    centres = rows.groupBy("server_id").agg(
        F.avg(F.when(F.col("late_30d"), F.col("index"))).alias("stay"), F.avg(F.when(~F.col("late_30d"), F.col("index"))).alias("go")
    )
    near = act.index_distance(F.col("index"), F.col("stay")) < act.index_distance(F.col("index"), F.col("go"))
    return rows.join(centres, "server_id").groupBy("server_id").agg(
        F.count_if(fresh("30d") & F.col("late_30d")).alias("new_players_retention_30d"),
        F.count_if(fresh("7d") & F.col("late_7d")).alias("new_players_retention_7d"),
        F.count_if(fresh("24h") & near).alias("new_players_retention_24h"),
    )


def online_activity_numbers(sessions, user_info, now: int, threshold: int = act.DEFAULT_THRESHOLD, offset: int = 0) -> DataFrame:
    """Uniques, new and retained players, playtime and sessions of 30 d, 7 d and 24 h with half-month trends, per server."""
    windows = online_windows(now)
    by = ["server_id"]
    frames = [
        _session_numbers(sessions, windows, offset, by), _new_numbers(user_info, windows, offset, by),
        _retention_numbers(user_info, sessions, windows, now, threshold),
    ]
    measures = ["unique_players", "unique_players_avg", "new_players", "new_players_avg", "playtime", "playtime_avg", "sessions"]
    columns = [f"{m}_{t}" for m in measures for t in windows] + [f"new_players_retention_{t}" for t in ("30d", "7d", "24h")]
    merged = merge_rows(frames, by, columns).fillna(0, columns)
    for t in windows:
        merged = merged.withColumn(f"session_length_avg_{t}", int_ratio(F.col(f"playtime_{t}"), F.col(f"sessions_{t}")))
    shown = [f"{m}_{t}" for m in [*measures, "session_length_avg"] for t in ("30d", "7d", "24h")]
    trends = [c for m in [*measures, "session_length_avg"] for c in trend_columns(m, F.col(f"{m}_before"), F.col(f"{m}_after"))]
    percents = [
        ratio(F.col(f"new_players_retention_{t}"), F.col(f"new_players_{t}"), -1.0).alias(f"new_players_retention_{t}_perc") for t in ("30d", "7d", "24h")
    ]
    plain = [F.col(c) for c in shown if c != "playtime_avg_24h"] + [F.col("playtime_24h").alias("playtime_avg_24h")]
    return merged.select("server_id", *plain, *[F.col(f"new_players_retention_{t}") for t in ("30d", "7d", "24h")], *percents, *trends)


def online_activity_insights(sessions, user_info, samples, now: int, month: int = MONTH, match: int = 500) -> DataFrame:
    """First-session lengths, joins that found nobody online and players online at first joins, with trends, per server.

    A session within ``match`` ms of the register date is the user's first one.
    """
    start, half = now - month, now - month // 2
    recent = sessions.where(F.col("session_start").between(start, now))
    dates = user_info.where(F.col("registered").between(start, now)).select("user_id", "server_id", "registered")
    sampled = samples.where(F.col("date").between(start, now))
    online = joins.online_on(sampled, recent.select("server_id", F.col("session_start").alias("date")))
    sets = F.filter(
        F.array(
            F.lit("all"), F.when(overlap(start, half), F.lit("before")), F.when(overlap(half, now), F.lit("after"))
        ),
        lambda x: x.isNotNull(),
    )
    rows = (
        recent.join(dates, ["user_id", "server_id"], "left")
        .withColumn("first", F.coalesce(F.abs(F.col("registered") - F.col("session_start")) < match, F.lit(False)))
        .join(online.withColumnRenamed("date", "session_start"), ["server_id", "session_start"], "left")
        .select("server_id", "first", "players_online", length().alias("len"), F.explode(sets).alias("part"))
    )
    alone = F.col("players_online") == 0
    keys = ["server_id", "part"]
    sums = rows.groupBy(*keys).agg(
        _zero(F.avg(F.when(F.col("first"), F.col("len"))).cast("bigint")).alias("first_session_length_avg"),
        F.count_if(alone).alias("lone_joins"),
        F.count_if(alone & F.col("first")).alias("lone_new_joins"),
        F.coalesce(F.avg(F.when(F.col("first"), F.col("players_online"))), F.lit(0.0)).alias("players_first_join_avg"),
    )
    medians = grouped_quantile(rows.where("first"), keys, "len", into="median").select(*keys, F.col("median").cast("bigint").alias("first_session_length_median"))
    long = sums.join(medians, keys, "left").fillna(-1, ["first_session_length_median"])
    names = ["first_session_length_avg", "first_session_length_median", "lone_joins", "lone_new_joins", "players_first_join_avg"]
    wide = long.groupBy("server_id").agg(
        *[F.max(F.when(F.col("part") == p, F.col(n))).alias(f"{n}_{p}") for n in names for p in ("all", "before", "after")]
    )
    empty = {"first_session_length_median": -1}
    filled = wide.select("server_id", *[F.coalesce(f"{n}_{p}", F.lit(empty.get(n, 0))).alias(f"{n}_{p}") for n in names for p in ("all", "before", "after")])
    return filled.select(
        "server_id",
        *[F.col(f"{n}_all").alias(n) for n in names],
        *[c for n in names for c in trend_columns(n, F.col(f"{n}_before"), F.col(f"{n}_after"))],
    )


# Overviews


def last_days(sessions, user_info, samples, now: int, low_tps: float, span: int = WEEK, offset: int = 0) -> DataFrame:
    """Uniques, new and retained players, mean TPS, spikes and down-time of the last days per server."""
    window = {"7d": (now - span, now)}
    by = ["server_id"]
    half = now - span // 2
    retained = (
        user_info.where(F.col("registered").between(now - span, now))
        .join(sessions.where(contained(half, now)).select("user_id", "server_id"), ["user_id", "server_id"], "left_semi")
        .groupBy(*by)
        .agg(F.countDistinct("user_id").alias("new_players_retention"))
    )
    mean = tps.dated(samples, now - span, now).groupBy(*by).agg(F.avg(F.when(F.col("tps") >= 0, F.col("tps"))).alias("average_tps"))
    frames = [
        _session_numbers(sessions, window, offset, by), _new_numbers(user_info, window, offset, by), retained, mean,
        tps.step_numbers(samples, now, low_tps, {"7d": span}),
    ]
    counts = ["unique_players_7d", "unique_players_avg_7d", "new_players_7d", "new_players_retention", "low_tps_spikes_7d", "server_downtime_7d"]
    merged = merge_rows(frames, by, [*counts, "average_tps"]).fillna(0, counts)
    return merged.select(
        "server_id", F.col("unique_players_7d").alias("unique_players"), F.col("unique_players_avg_7d").alias("unique_players_day"),
        F.col("new_players_7d").alias("new_players"), "new_players_retention",
        ratio(F.col("new_players_retention"), F.col("new_players_7d"), -1.0).alias("new_players_retention_perc"),
        F.coalesce("average_tps", F.lit(-1.0)).alias("average_tps"), F.col("low_tps_spikes_7d").alias("low_tps_spikes"),
        F.col("server_downtime_7d").alias("downtime"),
    )


def _regulars(registrations, sessions, dates: dict[str, int], threshold: int, by: Sequence[str]) -> DataFrame:
    """Regular players at several dates from one aggregation of the sessions."""
    keys = [*by, "user_id"]
    lo, hi = min(dates.values()) - 3 * WEEK, max(dates.values())
    sums = (
        sessions.where((F.col("session_end") >= lo) & (F.col("session_start") <= hi))
        .groupBy(*keys)
        .agg(*[F.sum(F.when(act._in_week(d, w, True), active()).otherwise(0)).alias(f"{t}{w}") for t, d in dates.items() for w in range(3)])
    )
    rows = registrations.select(*keys, "registered").join(sums, keys, "left")
    lo_i, hi_i = act.REGULAR_RANGE

    def regular(t, d):
        index = act.index_of([F.col(f"{t}{w}") for w in range(3)], threshold)
        return (F.col("registered") <= d) & (index >= lo_i) & (index < hi_i)

    return rows.groupBy(*by).agg(*[F.count_if(regular(t, d)).alias(f"regular_{t}") for t, d in dates.items()])


def totals(sessions, registrations, kills, samples, now: int, threshold: int, by: Sequence[str] = ("server_id",), gap: int = 3 * MINUTE) -> DataFrame:
    """All-time numbers: players, regulars, peaks, playtime, sessions, kills, deaths, current up-time."""
    people = registrations.groupBy(*by).agg(F.countDistinct("user_id").alias("total_players"))
    played = sessions.where(overlap(0, now)).groupBy(*by).agg(
        F.sum(clipped(0, now)).alias("playtime"), F.count_if(start_in(0, now)).alias("sessions"),
        F.sum("mob_kills").alias("mob_kills"), F.sum("deaths").alias("deaths"),
    )
    fought = combat.kill_count(kills, 0, now, by=by).withColumnRenamed("kills", "player_kills")
    peaks = tps.peaks(samples, now, by=by).drop("newest_date").withColumnRenamed("newest_players", "online_players")
    up = tps.current_uptime(samples, now, gap).groupBy(*by).agg(F.max("uptime").alias("current_uptime"))
    regular = _regulars(registrations, sessions, {"players": now}, threshold, by)
    counts = ["total_players", "regular_players", "playtime", "sessions", "mob_kills", "deaths", "player_kills"]
    columns = [*counts, "best_peak_date", "best_peak_players", "last_peak_date", "last_peak_players", "online_players", "current_uptime"]
    merged = merge_rows([people, played, fought, peaks, up, regular], by, columns).fillna(0, counts)
    return merged.withColumn("player_playtime", int_ratio(F.col("playtime"), F.col("total_players"))).withColumn(
        "session_length_avg", int_ratio(F.col("playtime"), F.col("sessions"))
    )


def weeks(sessions, registrations, kills, now: int, threshold: int, by: Sequence[str] = ("server_id",)) -> DataFrame:
    """This week against the one before, with trends."""
    windows = {"before": (now - 2 * WEEK, now - WEEK), "after": (now - WEEK, now)}
    played = _session_numbers(sessions, windows, 0, by)
    extra = []
    for t, (a, b) in windows.items():
        extra += [
            F.sum(F.when(overlap(a, b), F.col("mob_kills")).otherwise(0)).alias(f"mob_kills_{t}"),
            F.sum(F.when(overlap(a, b), F.col("deaths")).otherwise(0)).alias(f"deaths_{t}"),
        ]
    mobs = sessions.where(overlap(now - 2 * WEEK, now)).groupBy(*by).agg(*extra)
    new = _new_numbers(registrations, windows, 0, by)
    fought = kills.where(F.col("date").between(now - 2 * WEEK, now)).groupBy(*by).agg(
        *[F.count_if(F.col("date").between(a, b)).alias(f"player_kills_{t}") for t, (a, b) in windows.items()]
    )
    regular = _regulars(registrations, sessions, {"before": now - WEEK, "after": now}, threshold, by)
    names = ["unique_players", "new_players", "regular", "playtime", "sessions", "player_kills", "mob_kills", "deaths"]
    columns = [f"{n}_{t}" for n in names for t in windows]
    merged = merge_rows([played, mobs, new, fought, regular], by, columns).fillna(0, columns)
    for t in windows:
        merged = merged.withColumn(f"average_playtime_{t}", int_ratio(F.col(f"playtime_{t}"), F.col(f"unique_players_{t}"))).withColumn(
            f"session_length_{t}", int_ratio(F.col(f"playtime_{t}"), F.col(f"sessions_{t}"))
        )
    shown = [n for n in names if n != "playtime"] + ["average_playtime", "session_length"]
    return merged.select(
        *by, *[F.col(f"{n}_{t}") for n in shown for t in windows],
        *[c for n in shown for c in trend_columns(n, F.col(f"{n}_before"), F.col(f"{n}_after"))],
    )


def playerbase(sessions, registrations, now: int, threshold: int = act.DEFAULT_THRESHOLD, by: Sequence[str] = ("server_id",), month: int = MONTH) -> DataFrame:
    """Players, regulars, playtime and AFK a month ago and now; new → regular and regular → inactive with trends.

    ``registrations`` has the ``by`` columns, user_id and registered. One aggregation per (by, user) serves everything.
    """
    keys = [*by, "user_id"]
    before, half = now - month, now - month // 2
    dates = {"now": now, "half": half, "then": before}
    windows = {"then": (now - 2 * month, before), "now": (before, now)}
    lo = min(now - 2 * month, before - 3 * WEEK)
    sums = []
    for t, d in dates.items():
        sums += [F.sum(F.when(act._in_week(d, w, True), active()).otherwise(0)).alias(f"{t}{w}") for w in range(3)]
    for t, (a, b) in windows.items():
        sums += [
            F.sum(F.when(overlap(a, b), clipped(a, b))).alias(f"play_{t}"),
            F.sum(F.when(overlap(a, b), F.col("afk_time"))).alias(f"afk_{t}"),
            F.sum(F.when(contained(a, b), length())).alias(f"len_{t}"),
            F.sum(F.when(contained(a, b), F.col("afk_time"))).alias(f"rafk_{t}"),
            F.count_if(contained(a, b)).alias(f"cnt_{t}"),
        ]
    per_user = sessions.where((F.col("session_end") >= lo) & (F.col("session_start") <= now)).groupBy(*keys).agg(*sums)
    rows = registrations.select(*keys, "registered").join(per_user, keys, "full_outer")
    rows = rows.withColumns({f"i_{t}": act.index_of([F.col(f"{t}{w}") for w in range(3)], threshold) for t in dates})
    known = F.col("registered").isNotNull()

    def regular(t):
        lo_i, hi_i = act.REGULAR_RANGE
        return known & (F.col(f"i_{t}") >= lo_i) & (F.col(f"i_{t}") < hi_i)

    def inactive(t):
        lo_i, hi_i = act.INACTIVE_RANGE
        return (F.col(f"i_{t}") >= lo_i) & (F.col(f"i_{t}") < hi_i)

    def fresh(a, b, t):
        return F.col("registered").between(a, b) & (F.col(f"i_{t}") >= act.REGULAR)

    aggs = []
    for t, d in (("then", before), ("now", now)):
        of_regulars = regular(t) & (F.col(f"cnt_{t}") > 0)
        aggs += [
            F.count_if(F.col("registered") <= d).alias(f"total_players_{t}"),
            F.count_if(regular(t) & (F.col("registered") <= d)).alias(f"regular_players_{t}"),
            _zero(F.avg(f"play_{t}").cast("bigint")).alias(f"playtime_avg_{t}"),
            _zero(F.avg(f"afk_{t}").cast("bigint")).alias(f"afk_avg_{t}"),
            _zero(F.avg(F.when(of_regulars, F.col(f"len_{t}"))).cast("bigint")).alias(f"regular_playtime_avg_{t}"),
            _zero((F.sum(F.when(of_regulars, F.col(f"len_{t}"))) / F.sum(F.when(of_regulars, F.col(f"cnt_{t}")))).cast("bigint")).alias(f"regular_session_avg_{t}"),
            _zero(F.avg(F.when(of_regulars, F.col(f"rafk_{t}"))).cast("bigint")).alias(f"regular_afk_avg_{t}"),
        ]
    aggs += [
        F.count_if(fresh(before, now, "now")).alias("new_to_regular"),
        F.count_if(fresh(before, half, "half")).alias("new_to_regular_before"),
        F.count_if(fresh(half, now, "now")).alias("new_to_regular_after"),
        F.count_if(regular("then") & inactive("now")).alias("regular_to_inactive"),
        F.count_if(regular("then") & inactive("half")).alias("regular_to_inactive_before"),
        F.count_if(regular("half") & inactive("now")).alias("regular_to_inactive_after"),
    ]
    out = rows.groupBy(*by).agg(*aggs)
    for t in ("then", "now"):
        out = out.withColumn(f"afk_{t}", ratio(F.col(f"afk_avg_{t}"), F.col(f"playtime_avg_{t}"))).withColumn(
            f"regular_afk_{t}", ratio(F.col(f"regular_afk_avg_{t}"), F.col(f"regular_playtime_avg_{t}"))
        )
    pairs = ["total_players", "regular_players", "playtime_avg", "afk", "regular_playtime_avg", "regular_session_avg", "regular_afk"]
    return out.select(
        *by, *[f"{n}_{t}" for n in pairs for t in ("then", "now")],
        *[c for n in pairs for c in trend_columns(n, F.col(f"{n}_then"), F.col(f"{n}_now"))],
        "new_to_regular", "regular_to_inactive",
        *trend_columns("new_to_regular", F.col("new_to_regular_before"), F.col("new_to_regular_after")),
        *trend_columns("regular_to_inactive", F.col("regular_to_inactive_before"), F.col("regular_to_inactive_after")),
    )


def performance(samples, now: int, low_tps: float) -> DataFrame:
    """Performance numbers and low-TPS insights per server."""
    return tps.performance_numbers(samples, now, low_tps).join(tps.low_tps_insights(samples, now - MONTH, now, low_tps), "server_id", "left")


def network_performance(samples, now: int, low_tps: float, windows=tps.WINDOWS) -> DataFrame:
    """Averages and spikes over the pooled samples; up- and down-time per server, summed and averaged over the servers."""
    pooled = tps.sample_numbers(samples, now, (), windows).drop(*[f"{c}_{t}" for t in windows for c in ("max_disk", "min_disk")])
    names = [f"{c}_{t}" for t in windows for c in tps.GAP_COLUMNS]
    spikes = [f"low_tps_spikes_{t}" for t in windows]
    # Servers with a single sample have no gap but count in the mean.
    steps = tps.pooled_steps(samples, now, low_tps, windows)
    steps = steps.select(*spikes, *names, *[int_ratio(F.col(n), F.col("servers")).alias(f"avg_{n}") for n in names])
    return merge_rows([pooled, steps], [], [*pooled.columns, *steps.columns])


def combat_overview(kills, sessions, users, now: int) -> DataFrame:
    """Kills, deaths and ratios in total, 30 and 7 days, and the three top weapons of 30 days, per server."""
    by = ["server_id"]
    windows = {"total": (0, now), "30d": (now - MONTH, now), "7d": (now - WEEK, now)}

    def dated(a, b):
        return F.col("date").between(a, b)

    counts = kills.where(F.col("date") <= now).groupBy(*by).agg(
        *[F.count_if(dated(a, b)).alias(f"player_kills_{t}") for t, (a, b) in windows.items()]
    )
    sides = kills.where(F.col("date") <= now).select(
        *by, "date",
        F.explode(F.array(F.struct(F.col("killer_uuid").alias("uuid"), F.lit(1).alias("k"), F.lit(0).alias("d")), F.struct(F.col("victim_uuid").alias("uuid"), F.lit(0).alias("k"), F.lit(1).alias("d")))).alias("s"),
    )
    fighters = sides.groupBy(*by, F.col("s.uuid").alias("uuid")).agg(
        *[F.sum(F.when(dated(a, b), F.col(f"s.{c}")).otherwise(0)).alias(f"{c}_{t}") for t, (a, b) in windows.items() for c in ("k", "d")]
    )
    known = fighters.join(users.select("uuid"), "uuid", "left_semi")
    ratios = known.groupBy(*by).agg(
        *[
            F.coalesce(F.avg(F.when((F.col(f"k_{t}") > 0) & (F.col(f"d_{t}") > 0), F.col(f"k_{t}") / F.when(F.col(f"d_{t}") != 0, F.col(f"d_{t}")))), F.lit(0.0)).alias(f"player_kdr_{t}")
            for t in windows
        ]
    )
    mobs = sessions.where(overlap(0, now)).groupBy(*by).agg(
        *[
            F.sum(F.when(overlap(a, b), F.col(c)).otherwise(0)).alias(f"{c}_{t}")
            for t, (a, b) in windows.items()
            for c in ("mob_kills", "deaths")
        ]
    )
    top = combat.top_weapons(kills, now - MONTH, now, 3, by=by).groupBy(*by).agg(
        *[F.max(F.when(F.col("place") == i, F.col("weapon"))).alias(f"weapon_{i}") for i in (1, 2, 3)]
    )
    whole = [f"{c}_{t}" for t in windows for c in ("player_kills", "mob_kills", "deaths")]
    merged = merge_rows([counts, ratios, mobs, top], by, [*whole, *[f"player_kdr_{t}" for t in windows], "weapon_1", "weapon_2", "weapon_3"]).fillna(0, whole)
    for t in windows:
        merged = merged.withColumn(f"mob_deaths_{t}", F.col(f"deaths_{t}") - F.col(f"player_kills_{t}")).withColumn(
            f"mob_kdr_{t}", F.col(f"mob_kills_{t}").cast("double") / F.when(F.col(f"mob_deaths_{t}") != 0, F.col(f"mob_deaths_{t}")).otherwise(1)
        )
    return merged


def sessions_overview(sessions, samples, world_times, now: int, month: int = MONTH) -> DataFrame:
    """Occupied share of the up-time, AFK share of the playtime and most used mode per server."""
    a, by = now - month, ["server_id"]
    up = tps.up_and_down_time(samples, a, now, exclusive=True).select("server_id", "uptime")
    busy = tps.occupied_time_by_sample(samples, a, now)
    played = sessions.where(overlap(a, now)).groupBy(*by).agg(F.sum(clipped(a, now)).alias("playtime"), F.sum("afk_time").alias("afk_time"))
    modes = worlds.mode_totals(world_times, sessions, a, now, by=by)
    top = F.greatest(*[F.col(m) for m in worlds.MODES])
    best = worlds.most_used_mode(modes, by).join(modes.select("server_id", top.alias("mode_time")), "server_id")
    merged = merge_rows([up, busy, played, best], by, ["uptime", "occupied", "playtime", "afk_time", "mode", "mode_time"])
    merged = merged.fillna(0, ["uptime", "occupied", "playtime", "afk_time"])
    return merged.select(
        "server_id", "occupied", ratio(F.col("occupied"), F.col("uptime"), -1.0).alias("occupied_perc"), "playtime", "afk_time",
        ratio(F.col("afk_time"), F.col("playtime"), -1.0).alias("afk_perc"), "mode",
        ratio(F.when(F.col("mode").isNotNull(), F.col("mode_time")).otherwise(-1), F.col("playtime"), -1.0).alias("mode_perc"),
    )


def network_sessions_overview(sessions, now: int, month: int = MONTH) -> DataFrame:
    a = now - month
    played = sessions.where(overlap(a, now)).agg(_zero(F.sum(clipped(a, now))).alias("playtime"), _zero(F.sum("afk_time")).alias("afk_time"))
    return played.withColumn("afk_perc", ratio(F.col("afk_time"), F.col("playtime"), -1.0))


def network_players(sessions, users, now: int) -> DataFrame:
    """Unique and new players of the network in 1, 7 and 30 days."""
    windows = {"1d": (now - DAY, now), "7d": (now - WEEK, now), "30d": (now - MONTH, now)}
    unique = _session_numbers(sessions, windows, 0, [])
    new = _new_numbers(users, windows, 0, [])
    columns = [f"{n}_players_{t}" for n in ("unique", "new") for t in windows]
    return merge_rows([unique, new], [], columns).fillna(0, columns)


# Series


def unique_and_new_series(sessions, registrations, a: int, now: int, width: int = DAY, offset: int = 0, by: Sequence[str] = ("server_id",)) -> DataFrame:
    """Unique and new players per bucket as ``(by…, kind, date, players)``, 0 in empty buckets up to ``now``."""
    unique = sessions.where(contained(a, now)).groupBy(*by, bucket("session_start", width, offset).alias("date")).agg(F.countDistinct("user_id").alias("players"))
    new = registrations.where(F.col("registered").between(a, now)).groupBy(*by, bucket("registered", width, offset).alias("date")).agg(F.count("*").alias("players"))
    both = unique.withColumn("kind", F.lit("unique")).unionByName(new.withColumn("kind", F.lit("new")))
    return series.fill_missing(both, [*by, "kind"], "date", "players", width, now)


def calendar(sessions, registrations, now: int, span: int = 730 * DAY, offset: int = 0, by: Sequence[str] = ("server_id",)) -> DataFrame:
    """Per day: unique and new players, playtime and sessions as ``(by…, date, kind, value)``, zero values dropped."""
    a = now - span
    users = (
        sessions.where(contained(a, now) | start_in(a, now))
        .groupBy(*by, day("session_start", offset).alias("date"), "user_id")
        .agg(
            F.max(contained(a, now)).alias("inside"), F.sum(F.when(contained(a, now), length()).otherwise(0)).alias("p"), F.count_if(start_in(a, now)).alias("n"),
        )
    )
    days = users.groupBy(*by, "date").agg(F.count_if("inside").alias("unique"), F.sum("p").alias("playtime"), F.sum("n").alias("sessions"))
    new = registrations.where(F.col("registered").between(a, now)).groupBy(*by, day("registered", offset).alias("date")).agg(F.count("*").alias("new"))
    merged = merge_rows([days, new], [*by, "date"], ["unique", "playtime", "sessions", "new"])
    long = merged.selectExpr(*by, "date", "stack(4, 'unique', unique, 'new', new, 'playtime', playtime, 'sessions', sessions) as (kind, value)")
    return long.where(F.col("value") > 0)


def player_calendar(sessions, users, kills, offset: int = 0) -> DataFrame:
    """Per user: register day, sessions and playtime per day, each session as an interval, each kill as five minutes."""
    none = F.lit(None).cast("bigint")
    registered = users.select(F.col("id").alias("user_id"), F.lit("registered").alias("kind"), F.col("registered").alias("value"), (F.col("registered") + offset).alias("start"), none.alias("end"))
    days = sessions.groupBy("user_id", day("session_start", offset).alias("start")).agg(F.count("*").alias("sessions"), F.sum(length()).alias("playtime"))
    per_day = days.selectExpr("user_id", "start", "stack(2, 'sessions', sessions, 'playtime', playtime) as (kind, value)").withColumn("end", none)
    spans = sessions.select("user_id", F.lit("session").alias("kind"), length().alias("value"), (F.col("session_start") + offset).alias("start"), (F.col("session_end") + offset).alias("end"))
    ids = users.select(F.col("id").alias("user_id"), F.col("uuid").alias("killer_uuid"))
    deaths = kills.join(ids, "killer_uuid").select("user_id", F.lit("kill").alias("kind"), none.alias("value"), F.col("date").alias("start"), (F.col("date") + 5 * MINUTE).alias("end"))
    return registered.unionByName(per_day).unionByName(spans).unionByName(deaths)


def server_graphs(t, a: int, b: int, offset: int = 0) -> dict[str, DataFrame]:
    """The graph data of a server page: geolocation bars and map, ping, punch card, server pie, join addresses per day."""
    counts = geo.counts(t.geolocations)
    played = t.sessions.where(overlap(a, b)).groupBy("server_id").agg(F.sum(clipped(a, b)).alias("playtime"))
    return {
        "geolocation_bars": geo.top(counts),
        "geolocation_map": geo.with_codes(counts, t.country_codes),
        "ping": ping.rollup(t.ping.where(F.col("date").between(a, b)), by=["server_id"]),
        "punch_card": series.punch_card(t.sessions.where(F.col("session_start").between(a, b)), offset, ["server_id"]),
        "server_pie": played,
        "join_addresses": join_address.per_day(t.sessions, t.join_address, a, b, offset, by=["server_id"]),
    }


def ping_table(ping_rows, geolocations, by: Sequence[str] = ()) -> DataFrame:
    """Ping per geolocation in alphabetical order."""
    return ping.by_geolocation(ping_rows, geolocations, by=by).orderBy(*by, "geolocation")
