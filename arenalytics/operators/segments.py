"""Ad-hoc player segments: a list of filters whose user sets are intersected step by step.

Every filter contributes rows ``(user_id, step)``; one aggregation turns them into a bit per step, and step
sizes and members come from the running AND of the bits. Ids never leave the cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arenalytics.functions.windows import scope
from arenalytics.operators import activity, geo, join_address, metrics, sessions

FOREVER = 2**63 - 1


@dataclass(frozen=True)
class Filter:
    kind: str
    parameters: dict[str, Any] = field(default_factory=dict)

    def selected(self) -> list[str]:
        return list(self.parameters.get("selected", []))


class EveryoneSelected(Exception):
    """The filter selects all of its options, so it is skipped."""


def parse_time(date: str, time: str, offset: int = 0) -> int:
    """``dd/MM/yyyy`` and ``kk:mm`` (hours 1–24) in a zone with a fixed offset, as epoch ms."""
    try:
        hours, minutes = (int(p) for p in time.split(":"))
        day = datetime.strptime(date, "%d/%m/%Y").replace(tzinfo=timezone.utc)
    except ValueError as error:
        raise ValueError("expected a date dd/MM/yyyy and a time kk:mm") from error
    moment = day + timedelta(hours=hours % 24, minutes=minutes)
    return int(moment.timestamp() * 1000) - offset


def _instant(f: Filter, date: str = "date", time: str = "time") -> int:
    """The instant that two parameters name, in the zone whose ``offset`` from UTC, in ms, is a parameter as well (none: UTC)."""
    return parse_time(f.parameters[date], f.parameters[time], f.parameters.get("offset", 0))


def _range(f: Filter) -> tuple[int, int]:
    p = f.parameters
    after = _instant(f, "afterDate", "afterTime") if p.get("afterDate") and p.get("afterTime") else 0
    before = _instant(f, "beforeDate", "beforeTime") if p.get("beforeDate") and p.get("beforeTime") else FOREVER
    return after, before


def range_options(users: DataFrame, now: int) -> DataFrame:
    """Bounds offered for date filters: first register date and now."""
    return users.agg(F.coalesce(F.min("registered"), F.lit(now)).alias("after")).withColumn("before", F.lit(now).cast("bigint"))


def _servers(t, f: Filter) -> DataFrame | None:
    names = f.parameters.get("servers")
    return t.servers.where(F.col("name").isin(list(names))).select(F.col("id").alias("server_id")) if names else None


def _flag(t, f: Filter, column: str, yes: str, no: str) -> DataFrame:
    chosen = f.selected()
    if yes in chosen and no in chosen:
        raise EveryoneSelected
    wanted = yes in chosen
    if not wanted and no not in chosen:
        return t.user_info.where(F.lit(False)).select("user_id")
    return t.user_info.where(F.col(column) == wanted).select("user_id")


def _all_players(t, f):
    return t.users.select(F.col("id").alias("user_id"))


def _activity(t, f):
    chosen = f.selected()
    if set(activity.GROUPS) <= set(chosen):
        raise EveryoneSelected
    p = f.parameters
    date = _instant(f) if f.kind == "activityIndexOn" else p["now"]
    base = t.users.select(F.col("id").alias("user_id"), "registered")
    index = activity.activity_index(t.sessions, base, date, p.get("threshold", activity.DEFAULT_THRESHOLD))
    return index.where(activity.activity_group().isin(chosen)).select("user_id")


def _geolocations(t, f):
    """Names or country codes; codes are looked up in the (name, code) table."""
    wanted = t.spark.createDataFrame([(s,) for s in f.selected()], "selected string")
    codes = t.country_codes.select(F.col("code").alias("selected"), "name")
    names = wanted.join(codes, "selected", "left").select(F.lower(F.coalesce("name", "selected")).alias("place")).distinct()
    used = t.geolocations.select("user_id", F.lower("geolocation").alias("place"))
    return used.join(names, "place", "left_semi").select("user_id")


def _last_seen(t, f):
    return sessions.users_last_seen_between(t.sessions, *_range(f), _servers(t, f))


def _played(t, f):
    return sessions.users_played_between(t.sessions, *_range(f), _servers(t, f))


def _played_on(t, f):
    instant = _instant(f)
    return sessions.users_played_between(t.sessions, instant, instant, _servers(t, f))


def _played_on_server(t, f):
    names = t.servers.where(F.col("name").isin(f.selected())).select(F.col("id").alias("server_id"))
    return scope(t.user_info, names).select("user_id")


def _registered(t, f):
    after, before = _range(f)
    servers = _servers(t, f)
    if servers is None:
        return t.users.where(F.col("registered").between(after, before)).select(F.col("id").alias("user_id"))
    return scope(t.user_info, servers).where(F.col("registered").between(after, before)).select("user_id")


def _join_addresses(t, f):
    return join_address.users_with_addresses(t.sessions, t.join_address, f.selected())


def _provider_ids(t, server: str, plugin: str, provider: str) -> DataFrame:
    place = t.servers.where(F.col("name") == server).select(F.col("id").alias("server_id"))
    owner = t.metric_plugins.where(F.col("name") == plugin).join(place, "server_id", "left_semi").select(F.col("id").alias("plugin_id"))
    return t.metric_providers.where(F.col("name") == provider).join(owner, "plugin_id", "left_semi").select("id")


def _boolean_groups(t, f):
    """``server,plugin,provider: true|false`` options, OR-ed; both values of one provider mean "has a value"."""
    wanted: dict[tuple[str, str, str], str] = {}
    for option in f.selected():
        names, value = option.rsplit(":", 1)
        key = tuple(p.strip() for p in names.split(","))
        wanted[key] = "BOTH" if key in wanted else value.strip().upper()
    found = None
    for key, value in wanted.items():
        ids = metrics.users_with_boolean(t.metric_user_values, _provider_ids(t, *key), value)
        found = ids if found is None else found.unionByName(ids)
    return found


def _plugin_groups(t, f):
    p = f.parameters
    return metrics.users_in_groups(t.metric_groups, _provider_ids(t, p["server"], p["plugin"], p["provider"]), f.selected())


# The kinds of filters and their options.
FILTERS: dict[str, Callable[[Any, Filter], DataFrame]] = {
    "allPlayers": _all_players,
    "activityIndexOn": _activity,
    "activityIndexNow": _activity,
    "banned": lambda t, f: _flag(t, f, "banned", "banned", "not_banned"),
    "operators": lambda t, f: _flag(t, f, "opped", "operators", "non_operators"),
    "geolocations": _geolocations,
    "joinAddresses": _join_addresses,
    "lastSeenBetween": _last_seen,
    "playedBetween": _played,
    "playedOn": _played_on,
    "playedOnServer": _played_on_server,
    "pluginsBooleanGroups": _boolean_groups,
    "pluginGroups": _plugin_groups,
    "registeredBetween": _registered,
}


def matching_users(tables, f: Filter) -> DataFrame:
    """Distinct ids selected by one filter."""
    if f.kind not in FILTERS:
        raise ValueError(f"filter kind {f.kind} is not supported")
    return FILTERS[f.kind](tables, f).distinct()


@dataclass(frozen=True)
class Segment:
    """Result of a filter list: one flag column per applied filter and the labels of all steps."""

    flags: DataFrame
    labels: list[tuple[str, int]]

    def _upto(self, n: int) -> Column:
        condition = F.lit(True)
        for i in range(n):
            condition = condition & F.col(f"f{i}")
        return condition

    @property
    def applied(self) -> int:
        return max((n for _, n in self.labels), default=0)

    def members(self) -> DataFrame:
        return self.flags.where(self._upto(self.applied)).select("user_id")

    def path(self) -> DataFrame:
        """``(step, kind, size)`` per filter; the list stops after the first empty step."""
        sizes = F.array(*[F.count_if(self._upto(n)) for _, n in self.labels])
        kinds = F.array(*[F.lit(label) for label, _ in self.labels])
        steps = self.flags.agg(F.arrays_zip(kinds.alias("kind"), sizes.alias("size")).alias("s"), sizes.alias("sizes"))
        rows = steps.select("sizes", F.posexplode("s").alias("step", "r"))
        reached = (F.col("step") == 0) | (F.get("sizes", F.greatest(F.col("step") - 1, F.lit(0))) > 0)
        return rows.where(reached).select((F.col("step") + 1).alias("step"), F.col("r.kind").alias("kind"), F.col("r.size").alias("size"))


def run(tables, filters: Sequence[Filter]) -> Segment:
    """Evaluate the filters over the tables; an empty list selects everyone."""
    everyone = tables.users.select(F.col("id").alias("user_id"))
    labels: list[tuple[str, int]] = []
    marks = None
    applied = 0
    for f in filters or [Filter("allPlayers")]:
        try:
            ids = matching_users(tables, f).select("user_id", F.lit(applied).alias("step"))
        except EveryoneSelected:
            labels.append((f"{f.kind} (skip)", applied))
            continue
        marks = ids if marks is None else marks.unionByName(ids)
        applied += 1
        labels.append((f.kind, applied))
    if marks is None:
        return Segment(everyone, labels)
    bits = marks.groupBy("user_id").agg(*[F.max(F.col("step") == i).alias(f"f{i}") for i in range(applied)])
    flags = everyone.join(bits, "user_id", "left").fillna(False)
    return Segment(flags, labels)


def group_filter_options(groups, providers, plugins, servers) -> DataFrame:
    """The group filters on offer: server, plugin, provider and each group name."""
    names = groups.select("provider_id", "group_name").distinct()
    owner = plugins.select(F.col("id").alias("plugin_id"), F.col("name").alias("plugin"), "server_id")
    place = servers.select(F.col("id").alias("server_id"), F.col("name").alias("server"))
    meta = providers.select(F.col("id").alias("provider_id"), F.col("name").alias("provider"), "plugin_id").join(owner, "plugin_id").join(place, "server_id")
    return names.join(meta, "provider_id").select("server", "plugin", "provider", "group_name")
