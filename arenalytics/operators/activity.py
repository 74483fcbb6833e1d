"""Activity index: a 0–5 score from the active playtime of the last three weeks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arenalytics.functions.clock import WEEK
from arenalytics.functions.windows import active, contained, length, restrict, scope

# Group limits and the range of "regular" players.
VERY_ACTIVE, ACTIVE, REGULAR, IRREGULAR = 3.75, 3.0, 2.0, 1.0
REGULAR_RANGE = (2.0, 5.1)
INACTIVE_RANGE = (-0.1, 1.0)
GROUPS = ["Very Active", "Active", "Regular", "Irregular", "Inactive"]
DEFAULT_THRESHOLD = 30 * 60_000


def _in_week(date: int, week: int, closed: bool) -> Column:
    lo, hi = date - (week + 1) * WEEK, date - week * WEEK
    starts = F.col("session_start") <= hi if closed else F.col("session_start") < hi
    return (F.col("session_end") >= lo) & starts


def weekly_active(sessions: DataFrame, date: int, weeks: int = 3, closed: bool = True, keys=("user_id",)) -> DataFrame:
    """``w0 … w{n-1}``: active playtime per user of each week before ``date``, in one aggregation.

    A session across a week edge counts fully in both weeks.
    """
    oldest = date - weeks * WEEK
    starts = F.col("session_start") <= date if closed else F.col("session_start") < date
    return (
        sessions.where((F.col("session_end") >= oldest) & starts)
        .groupBy(*keys)
        .agg(*[F.sum(F.when(_in_week(date, w, closed), active()).otherwise(0)).alias(f"w{w}") for w in range(weeks)])
    )


def index_of(weeks: list[Column], threshold: int) -> Column:
    terms = [1 / (F.lit(math.pi / 2) * (F.coalesce(w.cast("double"), F.lit(0.0)) / threshold) + 1) for w in weeks]
    return F.lit(5.0) - F.lit(5.0) * ((terms[0] + terms[1] + terms[2]) / 3)


def base_users(users: DataFrame, user_info: DataFrame | None, servers, date: int | None) -> DataFrame:
    """``(user_id, registered)``: of the network, or of the servers with the earliest register date there."""
    if user_info is not None and servers:
        base = scope(user_info, servers).groupBy("user_id").agg(F.min("registered").alias("registered"))
    else:
        base = users.select(F.col("id").alias("user_id"), "registered")
    return base if date is None else base.where(F.col("registered") <= date)


def activity_index(
    sessions: DataFrame, base: DataFrame, date: int, threshold: int = DEFAULT_THRESHOLD, servers=None, closed: bool = True
) -> DataFrame:
    """``(user_id, activity_index)`` for every row of ``base``; users without sessions score 0."""
    weeks = weekly_active(scope(sessions, servers), date, closed=closed)
    return base.join(weeks, "user_id", "left").select(
        "user_id", index_of([F.col("w0"), F.col("w1"), F.col("w2")], threshold).alias("activity_index")
    )


def activity_index_per_server(
    sessions: DataFrame, user_info: DataFrame, date: int, threshold: int = DEFAULT_THRESHOLD, closed: bool = True
) -> DataFrame:
    """The index of every user on every server they registered on."""
    weeks = weekly_active(sessions, date, closed=closed, keys=("user_id", "server_id"))
    base = user_info.select("user_id", "server_id").distinct()
    return base.join(weeks, ["user_id", "server_id"], "left").select(
        "server_id", "user_id", index_of([F.col("w0"), F.col("w1"), F.col("w2")], threshold).alias("activity_index")
    )


def activity_group(index: str | Column = "activity_index") -> Column:
    c = F.col(index) if isinstance(index, str) else index
    return (
        F.when(c >= VERY_ACTIVE, "Very Active")
        .when(c >= ACTIVE, "Active")
        .when(c >= REGULAR, "Regular")
        .when(c >= IRREGULAR, "Irregular")
        .otherwise("Inactive")
    )


def group_counts(indexes: DataFrame) -> DataFrame:
    return indexes.groupBy(activity_group().alias("activity_group")).agg(F.count(F.lit(1)).alias("players"))


def within(indexes: DataFrame, above: float, below: float) -> DataFrame:
    return indexes.where((F.col("activity_index") >= above) & (F.col("activity_index") < below))


def count_within(indexes: DataFrame, above: float, below: float) -> DataFrame:
    return within(indexes, above, below).agg(F.count(F.lit(1)).alias("players"))


def regular_players(indexes: DataFrame) -> DataFrame:
    return within(indexes, *REGULAR_RANGE)


def _regular_sessions(sessions: DataFrame, indexes: DataFrame, a: int, b: int, servers) -> DataFrame:
    chosen = scope(sessions, servers).where(contained(a, b))
    return restrict(chosen, regular_players(indexes).select("user_id"))


def playtime_per_regular(sessions, indexes, a, b, servers=None) -> DataFrame:
    per_user = _regular_sessions(sessions, indexes, a, b, servers).groupBy("user_id").agg(F.sum(length()).alias("playtime"))
    return per_user.agg(F.avg("playtime").alias("average_playtime"))


def session_length_of_regulars(sessions, indexes, a, b, servers=None) -> DataFrame:
    return _regular_sessions(sessions, indexes, a, b, servers).agg(F.avg(length()).alias("average_length"))


def afk_per_regular(sessions, indexes, a, b, servers=None) -> DataFrame:
    per_user = _regular_sessions(sessions, indexes, a, b, servers).groupBy("user_id").agg(F.sum("afk_time").alias("afk"))
    return per_user.agg(F.avg("afk").alias("average_afk"))


def new_turned_regular(sessions, base, a, b, threshold=DEFAULT_THRESHOLD, servers=None, closed=True) -> DataFrame:
    """Users registered in ``[a, b]`` whose index at ``b`` is regular or better."""
    fresh = base.where(F.col("registered").between(a, b))
    return activity_index(sessions, fresh, b, threshold, servers, closed).where(F.col("activity_index") >= REGULAR).agg(
        F.count(F.lit(1)).alias("players")
    )


def regular_turned_inactive(sessions, base, start, end, threshold=DEFAULT_THRESHOLD, servers=None, closed=True) -> DataFrame:
    """Users regular at ``start`` and inactive at ``end``.

    Both indexes come from one pass: each date contributes its own three conditional sums.
    """
    chosen = scope(sessions, servers).where(
        (F.col("session_end") >= min(start, end) - 3 * WEEK) & (F.col("session_start") <= max(start, end))
    )
    sums = chosen.groupBy("user_id").agg(
        *[
            F.sum(F.when(_in_week(d, w, closed), active()).otherwise(0)).alias(f"{tag}{w}")
            for tag, d in (("s", start), ("e", end))
            for w in range(3)
        ]
    )
    both = base.join(sums, "user_id", "left").select(
        "user_id",
        index_of([F.col(f"s{w}") for w in range(3)], threshold).alias("index_start"),
        index_of([F.col(f"e{w}") for w in range(3)], threshold).alias("index_end"),
    )
    lo, hi = REGULAR_RANGE
    ilo, ihi = INACTIVE_RANGE
    return both.where(
        (F.col("index_start") >= lo) & (F.col("index_start") < hi) & (F.col("index_end") >= ilo) & (F.col("index_end") < ihi)
    ).agg(F.count(F.lit(1)).alias("players"))


def index_of_new_players(sessions, base, a, b, threshold=DEFAULT_THRESHOLD, servers=None, closed=True) -> DataFrame:
    fresh = base.where(F.col("registered").between(a, b))
    return activity_index(sessions, fresh, b, threshold, servers, closed)


def retained_users(base: DataFrame, sessions: DataFrame, a: int, b: int, servers=None) -> DataFrame:
    """Ids registered in ``[a, b]`` with a session inside the second half of the window."""
    half = b - (b - a) // 2
    fresh = base.where(F.col("registered").between(a, b))
    late = scope(sessions, servers).where(contained(half, b)).select("user_id")
    return fresh.join(late, "user_id", "left_semi").select("user_id")


def retained_index_averages(sessions, base, a, b, threshold=DEFAULT_THRESHOLD, servers=None, closed=True) -> DataFrame:
    """Mean index at ``b`` of the new players who were retained and of those who were not, in one row."""
    half = b - (b - a) // 2
    fresh = base.where(F.col("registered").between(a, b))
    chosen = scope(sessions, servers).where((F.col("session_end") >= min(b - 3 * WEEK, half)) & (F.col("session_start") <= b))
    sums = chosen.groupBy("user_id").agg(
        *[F.sum(F.when(_in_week(b, w, closed), active()).otherwise(0)).alias(f"w{w}") for w in range(3)],
        F.max(contained(half, b)).alias("late"),
    )
    scored = fresh.join(sums, "user_id", "left").select(
        index_of([F.col("w0"), F.col("w1"), F.col("w2")], threshold).alias("i"), F.coalesce("late", F.lit(False)).alias("late")
    )
    return scored.agg(
        F.avg(F.when(F.col("late"), F.col("i"))).alias("retained"),
        F.avg(F.when(~F.col("late"), F.col("i"))).alias("non_retained"),
    )


def weekly_indexes(
    sessions: DataFrame, base: DataFrame, now: int, weeks_back: int = 8, threshold: int = DEFAULT_THRESHOLD, closed: bool = False
) -> DataFrame:
    """``(date, user_id, activity_index)`` at now, now − 1 week, … in one aggregation.

    The dates are a week apart, so neighbouring indexes share their weekly sums: ``weeks_back + 3`` sums per
    user serve all dates, and the rows are expanded after the aggregation.
    """
    total = weeks_back + 3
    weeks = weekly_active(sessions, now, total, closed)
    wide = base.join(weeks, "user_id", "left")
    points = F.array(
        *[
            F.struct(
                F.lit(now - k * WEEK).cast("bigint").alias("date"),
                index_of([F.col(f"w{k + i}") for i in range(3)], threshold).alias("activity_index"),
            )
            for k in range(weeks_back + 1)
        ]
    )
    return (
        wide.select("user_id", "registered", F.explode(points).alias("p"))
        .where(F.col("registered") <= F.col("p.date"))
        .select("p.date", "user_id", "p.activity_index")
    )


def weekly_group_counts(sessions, base, now, weeks_back=8, threshold=DEFAULT_THRESHOLD, closed=False) -> DataFrame:
    return (
        weekly_indexes(sessions, base, now, weeks_back, threshold, closed)
        .groupBy("date", activity_group().alias("activity_group"))
        .agg(F.count(F.lit(1)).alias("players"))
    )


def group_stack(counts: DataFrame) -> DataFrame:
    """One column per group, 0 where a date has no player of the group."""
    return counts.groupBy("date").pivot("activity_group", GROUPS).agg(F.sum("players")).fillna(0, GROUPS)


def active_users(indexes: DataFrame, limit: float) -> DataFrame:
    return indexes.where(F.col("activity_index") >= limit).select("user_id")


def index_distance(a: str | Column, b: str | Column) -> Column:
    return F.abs(F.log(a) - F.log(b))
