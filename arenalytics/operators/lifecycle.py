"""From raw player and server events to sessions, AFK time, world times and minute samples (batch form).

Events: ``(event_id, user_id, server_id, kind, date, world, mode)`` with kind join, switch, leave, world,
action or afk. Events of one instant are ordered by event_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arenalytics.functions.clock import DAY, MINUTE, bucket
from arenalytics.functions.ordered import carry_forward, interval_sums, with_next, with_previous
from arenalytics.functions.stats import grouped_quantile, ranked_percentile
from arenalytics.functions.windows import valid_ping

# AFK threshold, match window of a first session, tick clock limits.
AFK_THRESHOLD = 3 * MINUTE
FIRST_SESSION_MS = 15_000
SECOND_NS = 1_000_000_000
STALL_NS = 20 * SECOND_NS
STARTS = ["join", "switch"]


def _state_steps(events: DataFrame) -> DataFrame:
    changes = events.where(F.col("kind").isin(*STARTS, "leave"))
    return with_next(changes, ["user_id"], "date", ["kind"], DAY, ties=["event_id"])


def finished_sessions(events: DataFrame) -> DataFrame:
    """A join or server switch opens a session; the next join, switch or leave ends it. Leaves without a join are ignored."""
    steps = _state_steps(events).where(F.col("kind").isin(STARTS) & F.col("next").isNotNull())
    return steps.select(
        "user_id", "server_id", F.col("date").alias("session_start"), F.col("next.date").alias("session_end"),
        (F.col("next.kind") != "leave").alias("interrupted"),
    )


def open_sessions(events: DataFrame) -> DataFrame:
    steps = _state_steps(events).where(F.col("kind").isin(STARTS) & F.col("next").isNull())
    return steps.select("user_id", "server_id", F.col("date").alias("session_start"))


def close_open_sessions(events: DataFrame, at: int) -> DataFrame:
    """Open sessions ended at ``at``; one that starts later is dropped."""
    return open_sessions(events).where(F.col("session_start") <= at).withColumn("session_end", F.lit(at).cast("bigint"))


def _in_sessions(events: DataFrame, kinds: list[str]) -> DataFrame:
    """Events of the given kinds and the state changes, with the start of the session open after each (null if none)."""
    chosen = events.where(F.col("kind").isin(*STARTS, "leave", *kinds))
    state = F.when(F.col("kind").isin(STARTS), F.struct(F.col("date").alias("start"))).when(
        F.col("kind") == "leave", F.struct(F.lit(None).cast("bigint").alias("start"))
    )
    marked = carry_forward(chosen.withColumn("_state", state), ["user_id"], "date", "_state", DAY, ["event_id"], "_open")
    return marked.withColumn("open_start", F.col("_open.start")).drop("_state", "_open")


def with_exemption(events: DataFrame, exempt: DataFrame | None) -> DataFrame:
    """Add ``exempt``: whether the user's AFK time is not counted at the event's date.

    ``exempt`` lists users by ``user_id``; ``valid_from`` (inclusive) and ``valid_to`` (exclusive) limit an entry in time, null or absent
    for no limit. Entries may overlap. The versions of one user are one row, so an event meets one row at most.
    """
    if exempt is None:
        return events.withColumn("exempt", F.lit(False))
    bounds = [F.col(c) if c in exempt.columns else F.lit(None).cast("bigint").alias(c) for c in ("valid_from", "valid_to")]
    versions = exempt.select("user_id", F.struct(*bounds).alias("v")).groupBy("user_id").agg(F.collect_set("v").alias("_versions"))

    def holds(v: Column) -> Column:
        since = v["valid_from"].isNull() | (F.col("date") >= v["valid_from"])
        return since & (v["valid_to"].isNull() | (F.col("date") < v["valid_to"]))

    return events.join(versions, "user_id", "left").withColumn("exempt", F.coalesce(F.exists("_versions", holds), F.lit(False))).drop("_versions")


def afk_times(events: DataFrame, threshold: int = AFK_THRESHOLD, exempt: DataFrame | None = None) -> DataFrame:
    """AFK per session: idle gaps of at least ``threshold`` before an action or the leave.

    After an AFK command the time from the command on counts, without the threshold. A gap that ends while its user is exempt
    (see :func:`with_exemption`) adds nothing, and neither does a command given then. Who is exempt without limits has no rows.
    """
    if exempt is not None and not {"valid_from", "valid_to"} & set(exempt.columns):
        events = events.join(exempt.select("user_id"), "user_id", "left_anti")
    rows = with_exemption(_in_sessions(events, ["action", "afk"]), exempt)
    rows = rows.withColumn("kind", F.when(F.col("exempt") & (F.col("kind") == "afk"), "still").otherwise(F.col("kind")))
    steps = with_previous(rows, ["user_id"], "date", ["kind", "open_start"], DAY, ties=["event_id"])
    gap = F.col("date") - F.col("prev.date")
    idle = F.when(F.col("exempt"), 0).when(F.col("prev.kind") == "afk", gap).when(gap >= threshold, gap).otherwise(0)
    ending = F.col("kind").isin("action", "leave") & F.col("prev.open_start").isNotNull()
    return steps.where(ending).groupBy("user_id", F.col("prev.open_start").alias("session_start")).agg(F.sum(idle).alias("afk_time"))


def event_counters(events: DataFrame) -> DataFrame:
    """Mob kills and deaths per session, from events of these kinds while it is open; sessions without any are absent."""
    rows = _in_sessions(events, ["mob_kill", "death"]).where(F.col("open_start").isNotNull() & F.col("kind").isin("mob_kill", "death"))
    count = lambda kind: F.count(F.when(F.col("kind") == kind, 1)).cast("int")
    return rows.groupBy("user_id", F.col("open_start").alias("session_start")).agg(
        count("mob_kill").alias("mob_kills"), count("death").alias("deaths")
    )


def world_times(events: DataFrame) -> DataFrame:
    """Time per session, world and mode: each change credits the time since to what was current before."""
    rows = _in_sessions(events, ["world"])
    steps = with_next(rows, ["user_id"], "date", (), DAY, ties=["event_id"])
    spent = steps.where(F.col("open_start").isNotNull() & F.col("next").isNotNull())
    return spent.groupBy("user_id", F.col("open_start").alias("session_start"), "world", "mode").agg(
        F.sum(F.abs(F.col("next.date") - F.col("date"))).alias("time")
    )


def session_counters(sessions: DataFrame, kills: DataFrame, users: DataFrame) -> DataFrame:
    """Player kills per session id; sessions without one are absent."""
    ids = users.select(F.col("id").alias("user_id"), F.col("uuid").alias("killer_uuid"))
    fought = kills.join(ids, "killer_uuid").select("user_id", "server_id", "date")
    sums = interval_sums(fought, sessions, ["user_id", "server_id"], "date", {"player_kills": F.lit(1).cast("bigint")}, "id", "session_start", "session_end", DAY)
    return sums.where(F.col("player_kills") > 0)


def with_first_flag(sessions: DataFrame, registrations: DataFrame) -> DataFrame:
    """Mark sessions that start within 15 s of the user's register date."""
    dates = registrations.select("user_id", "registered")
    near = F.abs(F.col("session_start") - F.col("registered")) < FIRST_SESSION_MS
    return sessions.join(dates, "user_id", "left").withColumn("first_session", F.coalesce(near, F.lit(False))).drop("registered")


def tick_tps(pulses: DataFrame, ns: str = "ns") -> DataFrame:
    """``(server_id, ns, tps, weight)`` from the time between pulses.

    TPS = 20 s / gap with the gap at least 1 s; each full 20 s stall adds a 0 sample. The zero samples of one gap
    are one row with their number as weight, so a long outage stays one row.
    """
    steps = with_previous(pulses.select("server_id", ns).distinct(), ["server_id"], ns, (), 3600 * SECOND_NS)
    gap = F.greatest(F.col(ns) - F.col(f"prev.{ns}"), F.lit(SECOND_NS).cast("bigint"))
    stalls = F.greatest(F.ceil(gap / STALL_NS) - 1, F.lit(0))
    rest = gap - stalls * STALL_NS
    samples = F.array(
        F.struct((F.lit(float(STALL_NS)) / rest).alias("tps"), F.lit(1).cast("bigint").alias("weight")),
        F.struct(F.lit(0.0).alias("tps"), stalls.cast("bigint").alias("weight")),
    )
    return steps.where(F.col("prev").isNotNull()).select("server_id", ns, F.explode(samples).alias("s")).select(
        "server_id", ns, "s.tps", "s.weight"
    ).where(F.col("weight") > 0)


def minute_tps(ticks: DataFrame, ns: str = "ns") -> DataFrame:
    """Weighted mean TPS per server and minute."""
    at = F.floor(F.col(ns) / 1_000_000)
    return ticks.groupBy("server_id", bucket(at, MINUTE).alias("date")).agg(
        (F.sum(F.col("tps") * F.col("weight")) / F.sum("weight")).alias("tps")
    )


def newest_first(date: str, tie: str) -> Column:
    """Order by date, then by a tie column, as one decimal: a fixed-width buffer keeps max_by on hash aggregation."""
    return F.col(date).cast("decimal(15,0)") * F.lit(str(10**19)).cast("decimal(20,0)") + F.col(tie).cast("decimal(19,0)")


def minute_rollup(pulses: DataFrame) -> DataFrame:
    """Samples per server and minute from raw pulses ``(server_id, date, id, tps, players, cpu, ram, entities, chunks, disk, mspt)``.

    Mean TPS, CPU and RAM, most players, mean and 95th tick time, mean and largest change between neighbouring
    ticks, newest entity, chunk and disk values. The row is dated at the start of its minute.
    """
    keys = ["server_id", "minute"]
    rows = pulses.withColumn("minute", bucket("date", MINUTE))
    newest = newest_first("date", "id")
    base = rows.groupBy(*keys).agg(
        F.avg(F.when(F.col("tps") >= 0, F.col("tps"))).alias("tps"),
        F.max("players").alias("players_online"),
        F.avg("cpu").alias("cpu_usage"),
        F.avg("ram").cast("bigint").alias("ram_usage"),
        F.max_by("entities", newest).alias("entities"),
        F.max_by("chunks", newest).alias("chunks_loaded"),
        F.max_by("disk", newest).alias("free_disk_space"),
        F.avg(F.when(F.col("mspt") > 0, F.col("mspt"))).alias("mspt_average"),
    )
    ticks = rows.where(F.col("mspt") > 0)
    top = ranked_percentile(ticks, keys, "mspt", 0.95, width=64, into="mspt_95th")
    steps = with_previous(ticks.select(*keys, "date", "id", "mspt"), keys, "date", ["mspt"], MINUTE, ties=["id"])
    change = F.abs(F.col("mspt") - F.col("prev.mspt")).cast("double")
    jitter = steps.groupBy(*keys).agg(F.avg(change).alias("mspt_jitter_avg"), F.max(change).alias("mspt_jitter_max"))
    return base.join(top, keys, "left").join(jitter, keys, "left").withColumnRenamed("minute", "date")


def ping_rollup(pings: DataFrame, width: int = MINUTE) -> DataFrame:
    """Per user, server and window: last date, lowest and highest value in range (−1 without one), median of all values."""
    keys = ["user_id", "server_id", "bucket"]
    rows = pings.withColumn("bucket", bucket("date", width))
    ok = F.when(valid_ping("value"), F.col("value"))
    base = rows.groupBy(*keys).agg(
        F.max("date").alias("date"), F.coalesce(F.min(ok), F.lit(-1)).alias("min_ping"), F.coalesce(F.max(ok), F.lit(-1)).alias("max_ping")
    )
    median = grouped_quantile(rows, keys, "value", width=256, into="m").select(*keys, F.col("m").cast("int").cast("double").alias("avg_ping"))
    return base.join(median, keys).drop("bucket")
