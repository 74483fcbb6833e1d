"""Cohorts, retention curves and retention prediction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arenalytics.functions.clock import DAY, HOUR, MONTH, WEEK
from arenalytics.functions.ordered import last_known, running_total
from arenalytics.functions.windows import active, length
from arenalytics.operators.activity import DEFAULT_THRESHOLD, index_distance, index_of

STEPS = {"hours": HOUR, "days": DAY, "weeks": WEEK, "months": MONTH}


def retention_base(registrations: DataFrame, sessions: DataFrame, keys=("user_id",)) -> DataFrame:
    """Per user (and server): register date, last seen, playtime, and how long after registering they were seen.

    ``registrations`` has the keys and ``registered``.
    """
    played = sessions.groupBy(*keys).agg(F.max("session_end").alias("last_seen"), F.sum(length()).alias("playtime"))
    return registrations.select(*keys, "registered").join(played, list(keys)).withColumn(
        "time_difference", F.col("last_seen") - F.col("registered")
    )


def registered_after(base: DataFrame, start: int) -> DataFrame:
    return base.where(F.col("registered") > start)


def cohort(kind: str, registered: str = "registered") -> Column:
    """Cohort name of a register date: none, days, weeks, months or years (UTC). Week = ceil(day of year / 7)."""
    at = F.timestamp_millis(F.col(registered))
    if kind == "days":
        return F.date_format(at, "yyyy-MM-dd")
    if kind == "weeks":
        return F.concat(F.year(at).cast("string"), F.lit("-week-"), F.ceil(F.dayofyear(at) / 7).cast("string"))
    if kind == "months":
        return F.date_format(at, "yyyy-MM")
    if kind == "years":
        return F.year(at).cast("string")
    return F.when(F.col(registered).isNotNull(), F.lit("all"))


def by_address_group(base: DataFrame, addresses: DataFrame, groups: DataFrame) -> DataFrame:
    """Cohorts by join-address group; a user is in every group that lists their address.

    ``addresses``: (user_id, join_address), ``groups``: (cohort, join_address).
    """
    return base.join(addresses, "user_id").join(groups, "join_address").drop("join_address")


def _counted(base: DataFrame, last_step: Column) -> DataFrame:
    """Users per cohort and last step on which they count."""
    return base.groupBy("cohort", last_step.cast("bigint").alias("step")).agg(F.count("*").alias("n"))


def _curve(counts: DataFrame) -> DataFrame:
    """``(cohort, step, players, percent)`` from :func:`_counted`, where step −1 means "on no step".

    The counts are summed from the far end; the series ends with its first empty step.
    """
    sizes = counts.groupBy("cohort").agg(F.sum("n").alias("size"), F.max("step").alias("top")).where(F.col("top") >= 0)
    spine = sizes.select("cohort", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("top") + 1)).alias("step"), F.lit(0).cast("bigint").alias("n"))
    totals = running_total(counts.unionByName(spine), ["cohort"], "step", {"players": "n"}, 1024, reverse=True)
    out = totals.where(F.col("step") >= 0).join(sizes.drop("top"), "cohort")
    return out.select("cohort", "step", "players", (F.col("players") * 100.0 / F.col("size")).alias("percent"))


def curve_by_time(base: DataFrame, step: int = DAY) -> DataFrame:
    """Users still seen more than ``i · step`` after registering."""
    return _curve(_counted(base, F.ceil(F.col("time_difference") / step) - 1))


def curve_by_playtime(base: DataFrame, step: int = HOUR) -> DataFrame:
    """Users who played longer than ``i · step``."""
    return _curve(_counted(base, F.ceil(F.col("playtime") / step) - 1))


def _origins(base: DataFrame, step: int) -> DataFrame:
    """First calendar step of each cohort."""
    return base.groupBy("cohort").agg(F.floor(F.min("registered") / step).alias("first"))


def curve_by_date(base: DataFrame, now: int, step: int = DAY) -> DataFrame:
    """Users last seen on or after each date, from the first register date of the cohort to ``now``."""
    origins = _origins(base, step)
    counts = _counted(base, F.floor(F.col("last_seen") / step)).join(origins, "cohort")
    curve = _curve(counts.select("cohort", (F.col("step") - F.col("first")).alias("step"), "n")).join(origins, "cohort")
    date = (F.col("first") + F.col("step")) * step
    return curve.select("cohort", date.alias("date"), "players", "percent").where(F.col("date") < now)


def alive_by_date(base: DataFrame, now: int, step: int = DAY) -> DataFrame:
    """Users registered on or before and last seen on or after each date.

    A series ends with the second of two empty dates in a row after its first user.
    """
    came, left = F.ceil(F.col("registered") / step), F.floor(F.col("last_seen") / step)
    change = F.array(F.struct(came.alias("step"), F.lit(1).alias("n")), F.struct((left + 1).alias("step"), F.lit(-1).alias("n")))
    changes = (
        base.where(came <= left)
        .select("cohort", F.explode(change).alias("c"))
        .groupBy("cohort", "c.step")
        .agg(F.sum("c.n").alias("n"))
    )
    sizes = base.groupBy("cohort").agg(F.count("*").alias("size"), F.floor(F.min("registered") / step).alias("first"))
    last = F.lit((now - 1) // step).cast("bigint")
    spine = sizes.where(F.col("first") <= last).select(
        "cohort", F.explode(F.sequence("first", last)).alias("step"), F.lit(0).cast("bigint").alias("n")
    )
    totals = running_total(changes.unionByName(spine), ["cohort"], "step", {"players": "n"}, 1024)
    points = totals.where(F.col("step") <= last).join(sizes.drop("first"), "cohort")
    along = Window.partitionBy("cohort").orderBy("step")
    ends = (
        (F.col("players") == 0)
        & (F.lag("players").over(along) == 0)
        & (F.max("players").over(along.rowsBetween(Window.unboundedPreceding, 0)) > 0)
    )
    whole = Window.partitionBy("cohort")
    return (
        points.withColumn("_end", ends)
        .withColumn("_stop", F.min(F.when(F.col("_end"), F.col("step"))).over(whole))
        .withColumn("_top", F.max("players").over(whole))
        .where((F.col("_top") > 0) & (F.col("_stop").isNull() | (F.col("step") <= F.col("_stop"))))
        .select("cohort", (F.col("step") * step).alias("date"), "players", (F.col("players") * 100.0 / F.col("size")).alias("percent"))
    )


def retained_in_both_halves(users: DataFrame, sessions: DataFrame, after: int, before: int) -> DataFrame:
    """Users who played in both halves of ``[max(after, registered), before]``."""
    start = F.greatest(F.lit(after), F.col("registered"))
    half = start + F.floor((F.lit(before) - start) / 2)
    early = (F.col("session_end") >= start) & (F.col("session_start") <= half)
    late = (F.col("session_end") >= half) & (F.col("session_start") <= before)
    seen = sessions.join(users.select(F.col("id").alias("user_id"), "registered"), "user_id")
    return seen.groupBy("user_id").agg(F.max(early).alias("e"), F.max(late).alias("l")).where("e and l").select("user_id")


def home_servers(sessions: DataFrame) -> DataFrame:
    """``(user_id, server_id)`` of each user's first session; of several at one instant the one with the smallest id."""
    return sessions.groupBy("user_id").agg(F.min_by("server_id", F.struct("session_start", "id")).alias("server_id"))


def first_day_features(users: DataFrame, sessions: DataFrame, samples: DataFrame, threshold: int = DEFAULT_THRESHOLD) -> DataFrame:
    """Per user: activity index one day after registering, players online when they registered, retained or not.

    Retained = played in both halves of the first 30 days. The online count is that of the server on which the user first
    played (−1 unknown).
    """
    people = users.select(F.col("id").alias("user_id"), "registered")
    at = F.col("registered") + DAY
    half = F.col("registered") + MONTH // 2

    def overlaps(lo: Column, hi: Column) -> Column:
        return (F.col("session_end") >= lo) & (F.col("session_start") <= hi)

    sums = (
        sessions.join(people, "user_id")
        .groupBy("user_id")
        .agg(
            *[F.sum(F.when(overlaps(at - (w + 1) * WEEK, at - w * WEEK), active()).otherwise(0)).alias(f"w{w}") for w in range(3)],
            (
                F.max(overlaps(F.col("registered"), half)) & F.max(overlaps(half, F.col("registered") + MONTH))
            ).alias("retained"),
        )
    )
    online = samples.groupBy("server_id", "date").agg(F.max_by("players_online", "id").alias("players_online"))
    homes = people.join(home_servers(sessions), "user_id", "left")
    asked = homes.where(F.col("server_id").isNotNull()).select("server_id", F.col("registered").alias("date"))
    known = last_known(online, asked, ["server_id"], "date", "players_online").select("server_id", F.col("date").alias("registered"), "players_online")
    return (
        homes.join(sums, "user_id", "left")
        .join(known, ["server_id", "registered"], "left")
        .select(
            "user_id",
            "registered",
            index_of([F.col(f"w{w}") for w in range(3)], threshold).alias("activity_index"),
            F.coalesce(F.col("players_online"), F.lit(-1)).cast("double").alias("online_on_join"),
            F.coalesce("retained", F.lit(False)).alias("retained"),
        )
    )


def likely_retained(features: DataFrame, candidates: DataFrame, date_limit: int) -> DataFrame:
    """Candidates nearer to the mean of the retained users than to that of the others.

    Users registered after ``date_limit`` do not shape the means. Distance = 2·|Δindex| + |Δonline| / 10.
    """
    known = features.where(F.col("registered") <= date_limit)
    centres = known.agg(
        F.struct(
            *[
                F.avg(F.when(F.col("retained") == flag, F.col(c))).alias(f"{c}_{int(flag)}")
                for flag in (True, False)
                for c in ("activity_index", "online_on_join")
            ]
        ).alias("c")
    ).scalar()

    def distance(flag: int) -> Column:
        online, centre = F.col("online_on_join"), centres[f"online_on_join_{flag}"]
        return F.abs(centres[f"activity_index_{flag}"] - F.col("activity_index")) * 2 + F.when(
            (online != -1) & (centre != -1), F.abs(centre - online) / 10
        ).otherwise(0)

    return candidates.where(distance(1) < distance(0)).select("user_id")


def predicted_retained(new_indexes: DataFrame, averages: DataFrame) -> DataFrame:
    """How many new players' index is nearer (in log distance) to the retained than to the other mean.

    ``averages`` is the one row of :func:`arenalytics.operators.activity.retained_index_averages`.
    """
    both = averages.select(F.struct("retained", "non_retained")).scalar()
    nearer = index_distance(F.col("activity_index"), both["retained"]) < index_distance(F.col("activity_index"), both["non_retained"])
    return new_indexes.agg(F.count_if(nearer).alias("players"))
