"""The result pages of a segment: player table, weekly activity, geolocations, session summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arenalytics.functions.clock import MONTH, WEEK
from arenalytics.functions.windows import restrict, scope
from arenalytics.operators import activity, geo
from arenalytics.operators.sessions import summary_of_players
from arenalytics.plans.tables import segment_players


def segment_view(t, members: DataFrame, a: int, b: int, servers=None, threshold: int = activity.DEFAULT_THRESHOLD) -> dict[str, DataFrame]:
    """``members`` is a one-column DataFrame of user ids; it stays distributed in all four parts."""
    base = restrict(t.users.select(F.col("id").alias("user_id"), "registered"), members)
    weeks = (b - max(a, b - 2 * MONTH)) // WEEK
    return {
        "players": segment_players(t.users, t.user_info, t.sessions, t.geolocations, t.ping, t.nicknames, members, a, b, servers, threshold),
        "activity": activity.weekly_group_counts(scope(t.sessions, servers), base, b, weeks, threshold, closed=True),
        "geolocation": geo.counts(t.geolocations, members),
        "sessions": summary_of_players(t.sessions, members, a, b, servers),
    }
