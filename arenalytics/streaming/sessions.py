"""Sessions, AFK time, world times and counters from a live event stream, in typed state keyed by user.

Events wait in list state until the watermark has passed them and are then applied in event order, so events that arrive
out of order by less than the delay give the same sessions as the batch form. Events behind the watermark are rows of the
same stream, marked late: what is on time and what is late together are all events. An open session is one value, its
times are map state by (world, mode), of which only the touched entries are written; a batch reads and writes
what is new and what still waits, not the user's history.

Every call to state is a message to Spark and back, far dearer than the step of an event. So users share a key in groups, whose
events travel and wait in packs, lists of the values of many events, and whose open sessions are read together.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from arenalytics.operators.lifecycle import AFK_THRESHOLD, with_exemption
from arenalytics.session import ship_package
from arenalytics.streaming.replay import CLOSING

FIELDS = ["date", "event_id", "kind", "server_id", "world", "mode", "exempt"]
EVENT = "date bigint, event_id bigint, kind string, server_id int, world string, mode int, exempt boolean"
SESSION_FIELDS = ["server", "start", "moved", "commanded", "afk", "world", "mode", "since", "seen", "mob_kills", "deaths"]
SESSION = (
    "server int, start bigint, moved bigint, commanded boolean, afk bigint, world string, mode int, since bigint, seen bigint, "
    "mob_kills int, deaths int"
)
FINISHED = (
    "server_id int, session_start bigint, session_end bigint, afk_time bigint, interrupted boolean, mob_kills int, deaths int, "
    "world_times array<struct<world: string, mode: int, time: bigint>>"
)
OUTPUT = f"user_id bigint, session struct<{FINISHED}>, late struct<{EVENT}>"
GROUPS = 1024
"""Keys that users are dealt out to. The waiting events of a group are in memory at once, so more events need more groups."""
PACK = (
    "user_id array<bigint>, date array<bigint>, event_id array<bigint>, kind array<string>, server_id array<int>, world array<string>, "
    "mode array<int>, exempt array<boolean>"
)
PACK_EVENTS = 100_000
"""Events that a task packs at a time."""
OPEN = f"{SESSION}, worlds array<string>, modes array<int>, spent array<bigint>"
READ_TOGETHER = 16
"""If more users of a group have events to apply, all its open sessions are read in one go."""
USED = ("join", "switch", "leave", "world", "action", "afk", "mob_kill", "death")


def apply_event(session: dict | None, times: dict, event: tuple, threshold: int = AFK_THRESHOLD) -> tuple[dict | None, dict, tuple | None]:
    """Advance one user's open session by one event; returns the session, its times by (world, mode), and a finished row, if any."""
    date, _, kind, server, world, mode, exempt = event
    done = None
    if session is not None:
        if kind in ("action", "leave") and not exempt:
            gap = date - session["moved"]
            session["afk"] += gap if session["commanded"] or gap >= threshold else 0
        if kind in ("join", "switch", "leave", "world"):
            key = (session["world"], session["mode"])
            times[key] = times.get(key, 0) + abs(date - session["since"])
        if kind in ("join", "switch", "leave"):
            ended = (session["server"], session["start"], date, session["afk"], kind != "leave", session["mob_kills"], session["deaths"])
            done = (*ended, [(w, m, t) for (w, m), t in times.items()])
            session, times = None, {}
        elif kind == "world":
            session.update(world=world, mode=mode, since=date)
        elif kind in ("action", "afk"):
            session.update(moved=date, commanded=kind == "afk" and not exempt)
        elif kind == "mob_kill":
            session["mob_kills"] += 1
        elif kind == "death":
            session["deaths"] += 1
    if kind in ("join", "switch"):
        session = {
            "server": server, "start": date, "moved": date, "commanded": False, "afk": 0, "world": world, "mode": mode,
            "since": date, "seen": date, "mob_kills": 0, "deaths": 0,
        }
    if session is not None:
        session["seen"] = date
    return session, times, done


class Sessions(StatefulProcessor):
    """One user's waiting events and open session."""

    def __init__(self, threshold: int, session_timeout: int | None):
        self.threshold, self.session_timeout = threshold, session_timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", SESSION)
        self.times = handle.getMapState("times", "world string, mode int", "time bigint")
        self.waiting = handle.getListState("waiting", EVENT)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        fresh = []
        for row in rows:
            event = tuple(row[f] for f in FIELDS)
            if row["kind"] not in USED:
                continue
            if row["date"] <= watermark:
                yield Row(user_id=key[0], session=None, late=event)
            else:
                fresh.append(event)
        if fresh:
            self.waiting.appendList(fresh)
            self._wake(min(e[0] for e in fresh), watermark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        events = sorted((tuple(e) for e in self.waiting.get()), key=lambda e: e[:2]) if self.waiting.exists() else []
        ready = [e for e in events if e[0] <= watermark]
        rest = events[len(ready):]
        if ready and rest:
            self.waiting.put(rest)
        elif ready:
            self.waiting.clear()
        session = dict(zip(SESSION_FIELDS, self.open.get(), strict=True)) if self.open.exists() else None
        if not ready and (session is None or rest or self.session_timeout is None or session["seen"] + self.session_timeout > watermark):
            if rest:
                self._wake(rest[0][0], watermark)
            return
        stored = session is not None
        times = {tuple(k): v[0] for k, v in self.times.iterator()} if stored else {}
        before, reopened = dict(times), False
        for event in ready:
            session, times, done = apply_event(session, times, event, self.threshold)
            if done:
                reopened = True
                yield Row(user_id=key[0], session=done, late=None)
        if session is not None and not rest and self.session_timeout is not None and session["seen"] + self.session_timeout <= watermark:
            # The leave never came: the session ends with its last event.
            end = (session["seen"], 0, "leave", session["server"], None, None, False)
            session, times, done = apply_event(session, times, end, self.threshold)
            reopened = True
            yield Row(user_id=key[0], session=done, late=None)
        if reopened and stored:
            self.times.clear()
            before = {}
        if session is None:
            self.open.clear()
        else:
            self.open.update(tuple(session[f] for f in SESSION_FIELDS))
            for place, time in times.items():
                if reopened or before.get(place) != time:
                    self.times.updateValue(place, (time,))
        if rest:
            self._wake(rest[0][0], watermark)
        elif session is not None and self.session_timeout is not None:
            self._wake(max(session["seen"] + self.session_timeout, watermark + 1), watermark)

    def _wake(self, at: int, watermark: int) -> None:
        """One timer ahead of the watermark at a time, the earliest; one that is due goes by itself once it has fired."""
        own = [t for t in self.handle.listTimers() if t > watermark]
        if not own or at < min(own):
            for t in own:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(int(at))

    def close(self) -> None:
        pass


class SessionGroups(Sessions):
    """The waiting events and open sessions of a group of users."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "user_id bigint", OPEN)
        self.due = handle.getValueState("due", "date bigint")
        self.waiting = handle.getListState("waiting", PACK)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        fresh = []
        for row in rows:
            for user, *event in zip(row["user_id"], *(row[f] for f in FIELDS), strict=True):
                date, _, kind, *_ = event
                if kind not in USED:
                    continue
                if date <= watermark:
                    yield Row(user_id=user, session=None, late=tuple(event))
                else:
                    fresh.append((user, *event))
        if fresh:
            self.waiting.appendList([pack(fresh)])
            self._wake(min(e[1] for e in fresh), watermark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        ready, rest = defaultdict(list), []
        for held in self.waiting.get() or ():
            for user, *event in zip(*held, strict=True):
                if event[0] <= watermark:
                    ready[user].append(tuple(event))
                else:
                    rest.append((user, *event))
        if ready and rest:
            self.waiting.put([pack(rest)])
        elif ready:
            self.waiting.clear()
        due = self.due.get() if self.session_timeout is not None else None
        due = due[0] if due else None
        # No open session ends before that date, so others than those with events are only looked at from then on.
        ending = due is not None and due <= watermark
        stored = self._stored(ready, ending)
        after, waits = None if ending else due, {e[0] for e in rest}
        for user in {**ready, **stored} if ending else ready:
            session, times = stored.get(user, (None, {}))
            for event in sorted(ready.get(user, ()), key=lambda e: e[:2]):
                session, times, done = apply_event(session, times, event, self.threshold)
                if done:
                    yield Row(user_id=user, session=done, late=None)
            if session is not None and self.session_timeout is not None and user not in waits:
                ends = session["seen"] + self.session_timeout
                if ends <= watermark:
                    # The leave never came: the session ends with its last event.
                    end = (session["seen"], 0, "leave", session["server"], None, None, False)
                    session, times, done = apply_event(session, times, end, self.threshold)
                    yield Row(user_id=user, session=done, late=None)
                else:
                    after = ends if after is None else min(after, ends)
            if session is None and user in stored:
                self.open.removeKey((user,))
            elif session is not None and user in ready:
                places = ([w for w, _ in times], [m for _, m in times], list(times.values()))
                self.open.updateValue((user,), (*[session[f] for f in SESSION_FIELDS], *places))
        if after is None and due is not None:
            self.due.clear()
        elif after != due:
            self.due.update((after,))
        ahead = [e[1] for e in rest] + ([] if after is None else [max(after, watermark + 1)])
        if ahead:
            self._wake(min(ahead), watermark)

    def _stored(self, users, everyone: bool) -> dict:
        """The open sessions, and their times by (world, mode), of some users or of everyone in the group."""
        if everyone or len(users) > READ_TOGETHER:
            found = ((key[0], value) for key, value in self.open.iterator())
        else:
            found = ((user, self.open.getValue((user,))) for user in users)
        sessions = {}
        for user, value in found:
            if value is not None and (everyone or user in users):
                *fields, worlds, modes, spent = value
                sessions[user] = dict(zip(SESSION_FIELDS, fields, strict=True)), dict(zip(zip(worlds, modes, strict=True), spent, strict=True))
        return sessions


def pack(events: list[tuple]) -> tuple:
    """The values of some events, a list per field."""
    return tuple(map(list, zip(*events, strict=True)))


def packed(events: DataFrame, groups: int) -> DataFrame:
    """(group, a list per field) of events: a row per group and task, or per ``PACK_EVENTS`` events."""
    fields = ["user_id", *FIELDS]

    def by_group(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grouped = pa.Table.from_batches(held).group_by("group", use_threads=False).aggregate([(f, "list") for f in fields])
        yield from grouped.select(["group", *[f"{f}_list" for f in fields]]).rename_columns(["group", *fields]).to_batches(max_chunksize=100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= PACK_EVENTS:
                yield from by_group(held)
                held, n = [], 0
        if held:
            yield from by_group(held)

    group = F.pmod(F.xxhash64("user_id"), F.lit(groups)).cast("int").alias("group")
    return events.select(group, *fields).mapInArrow(run, f"group int, {PACK}")


def live_rows(
    events: DataFrame, delay: str = "10 minutes", threshold: int = AFK_THRESHOLD, session_timeout: int | None = 24 * 3_600_000,
    exempt: DataFrame | None = None, groups: int | None = GROUPS,
) -> DataFrame:
    """(user_id, session, late) of a stream of events (columns as in the batch form): finished sessions and late events.

    ``exempt`` lists users whose AFK time isn't counted, with ``valid_from`` and ``valid_to`` if it holds versions. State is kept
    by ``groups`` of users, by single users without; a stream goes on with the number that it was started with. Start the
    stream with :func:`arenalytics.streaming.replay.drain` or with its ``TYPED_STATE`` settings.
    """
    ship_package(events.sparkSession)
    used = events.where(F.col("kind").isin(*USED, CLOSING))
    timed = with_exemption(used, exempt).withColumn("at", F.timestamp_millis("date")).withWatermark("at", delay)
    # Without the watermark's own column Spark drops no late row; they are told apart by their date.
    if groups:
        return packed(timed, groups).groupBy("group").transformWithState(SessionGroups(threshold, session_timeout), OUTPUT, "Append", "EventTime")
    keyed = timed.select("user_id", *FIELDS).groupBy("user_id")
    return keyed.transformWithState(Sessions(threshold, session_timeout), OUTPUT, "Append", "EventTime")


def finished(rows: DataFrame) -> DataFrame:
    """The finished sessions among the rows of :func:`live_rows`."""
    return rows.where("session is not null").select("user_id", "session.*")


def late_events(rows: DataFrame) -> DataFrame:
    """The events that came behind the watermark, among the rows of :func:`live_rows`."""
    return rows.where("late is not null").select("user_id", "late.*")


def as_world_times(sessions: DataFrame) -> DataFrame:
    """The nested world times as rows (user, session start, world, mode, time)."""
    return sessions.select("user_id", "session_start", F.inline("world_times"))
