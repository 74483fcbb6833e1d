"""Streams equal the batch form, also with late arrivals, lost leaves and repeated batches."""

import random

import pytest
from pyspark.sql import functions as F

from arenalytics.operators import lifecycle as life
from arenalytics.operators import metrics, roster
from arenalytics.sources import sinks
from arenalytics.streaming import batches, replay, rollups, sessions
from tests.conftest import tuples

EVENTS = "event_id bigint, user_id bigint, server_id int, kind string, date bigint, world string, mode int"
MINUTE = 60_000


def event_log(seed=5, users=6, n=400):
    r = random.Random(seed)
    kinds = ["join", "leave", "switch", "world", "action", "action", "afk", "mob_kill", "death"]
    log = [(i, r.randrange(users), 1 + r.randrange(3), r.choice(kinds), 10**9 + i * 20_000 + r.randrange(20_000), f"w{r.randrange(2)}", r.randrange(4)) for i in range(n)]
    return log


def as_stream(spark, tmp_path, data, parts):
    folder = tmp_path / "in"
    size = -(-len(data) // parts)
    for i in range(parts):
        chunk = data[i * size:(i + 1) * size]
        spark.createDataFrame(chunk, EVENTS).coalesce(1).write.mode("append").parquet(str(folder))
    return replay.file_stream(spark, str(folder), spark.createDataFrame(data[:1], EVENTS).schema, files_per_batch=1)


def rows_of(spark, stream, **options):
    build = lambda events: sessions.live_rows(events, **options)
    return spark.read.parquet(replay.drain_closed(stream, build, "test"))


def in_disorder(data):
    """The events with a disorder of about three minutes."""
    shuffled = list(data)
    r = random.Random(1)
    for i in range(0, len(shuffled) - 8, 8):
        block = shuffled[i:i + 8]
        r.shuffle(block)
        shuffled[i:i + 8] = block
    return shuffled


def test_live_sessions_equal_batch_when_events_arrive_out_of_order(spark, rows, tmp_path):
    data = event_log()
    found = rows_of(spark, as_stream(spark, tmp_path, in_disorder(data), 4), session_timeout=None)
    done = sessions.finished(found)
    assert sessions.late_events(found).count() == 0
    batch = rows(data, EVENTS)
    assert tuples(done, "user_id", "server_id", "session_start", "session_end", "interrupted") == tuples(life.finished_sessions(batch))
    assert done.count() > 20
    ends = life.finished_sessions(batch).select("user_id", "session_start")
    want = tuples(life.world_times(batch).join(ends, ["user_id", "session_start"]), "user_id", "session_start", "world", "mode", "time")
    assert tuples(sessions.as_world_times(done), "user_id", "session_start", "world", "mode", "time") == want
    afk = {k[:2]: k[2] for k in tuples(life.afk_times(batch), "user_id", "session_start", "afk_time")}
    for user, start, time in tuples(done, "user_id", "session_start", "afk_time"):
        assert afk.get((user, start), 0) == time
    counted = {k[:2]: k[2:] for k in tuples(life.event_counters(batch), "user_id", "session_start", "mob_kills", "deaths")}
    for user, start, *counts in tuples(done, "user_id", "session_start", "mob_kills", "deaths"):
        assert counted.get((user, start), (0, 0)) == tuple(counts)
    assert sum(sum(c) for c in counted.values()) > 20


def test_users_exempt_in_mid_stream(spark, rows, tmp_path):
    data = event_log(seed=8)
    first, last = data[0][4], data[-1][4]
    middle = (first + last) // 2
    versions = [(0, middle, None), (1, None, middle), (2, first, middle), (2, middle - 5, last), (3, None, None), (9, None, None)]
    exempt = rows(versions, "user_id bigint, valid_from bigint, valid_to bigint")
    found = rows_of(spark, as_stream(spark, tmp_path, in_disorder(data), 4), session_timeout=None, threshold=MINUTE, exempt=exempt)
    batch = {k[:2]: k[2] for k in tuples(life.afk_times(rows(data, EVENTS), MINUTE, exempt), "user_id", "session_start", "afk_time")}
    free = {k[:2]: k[2] for k in tuples(life.afk_times(rows(data, EVENTS), MINUTE), "user_id", "session_start", "afk_time")}
    got = {k[:2]: k[2:] for k in tuples(sessions.finished(found), "user_id", "session_start", "session_end", "afk_time")}
    assert {k: v[1] for k, v in got.items()} == {k: batch.get(k, 0) for k in got}
    assert all(v[1] == 0 for k, v in got.items() if k[0] == 3 or k[0] == 0 and k[1] >= middle or k[0] == 1 and v[0] < middle)
    assert all(v[1] == free.get(k, 0) for k, v in got.items() if k[0] in (4, 5) or k[0] == 0 and v[0] < middle)
    assert any(v[1] for k, v in got.items() if k[0] == 0) and any(v[1] for k, v in got.items() if k[0] == 1)


def test_on_time_and_late_events_are_all_events(spark, tmp_path):
    data = event_log(seed=9, n=240)
    step = len(data) // 6
    parts = [data[i:i + step] for i in range(0, len(data), step)]
    moved = [parts[1].pop(3), parts[2].pop(0), parts[2].pop(5), parts[0].pop()]
    parts[4] += moved  # 40 events of 20 s and more, two parts later: far behind ten minutes
    folder = tmp_path / "in"
    for part in parts:
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(str(folder))
    stream = replay.file_stream(spark, str(folder), spark.createDataFrame(data[:1], EVENTS).schema, files_per_batch=1)
    found = rows_of(spark, stream, session_timeout=None)
    late = tuples(sessions.late_events(found), "event_id")
    assert late == sorted((e[0],) for e in moved)
    on_time = [e for e in data if (e[0],) not in late]
    assert tuples(sessions.finished(found), "user_id", "server_id", "session_start", "session_end", "interrupted") == tuples(
        life.finished_sessions(spark.createDataFrame(on_time, EVENTS))
    )


def test_lost_leave_ends_by_timeout(spark, tmp_path):
    data = [(1, 1, 1, "join", 10**9, "w0", 0), (2, 1, 1, "action", 10**9 + MINUTE, "w0", 0), (3, 2, 1, "join", 10**9 + 10**8, "w0", 0), (4, 2, 1, "action", 10**9 + 2 * 10**8, "w0", 0)]
    stream = as_stream(spark, tmp_path, data, 4)
    out = replay.drain(sessions.live_rows(stream, session_timeout=3_600_000), "timeout")
    done = sessions.finished(spark.read.parquet(out))
    assert tuples(done, "user_id", "session_start", "session_end") == [(1, 10**9, 10**9 + MINUTE)]


def test_closing_a_stream_ends_lost_sessions_and_keeps_no_row_of_its_own(spark, tmp_path):
    data = [(1, 1, 1, "join", 10**9, "w0", 0), (2, 1, 1, "action", 10**9 + MINUTE, "w0", 0), (3, None, 1, "join", 10**9, "w0", 0)]
    found = rows_of(spark, as_stream(spark, tmp_path, data, 1), session_timeout=3_600_000)
    ended = {tuple(r) for r in sessions.finished(found).select("user_id", "session_end").collect()}
    assert ended == {(1, 10**9 + MINUTE), (None, 10**9)}
    assert sessions.late_events(found).count() == 0


class Held:
    """State of one key that counts the elements read and written."""

    def __init__(self):
        self.value, self.moved = None, 0

    def exists(self):
        return bool(self.value)

    def get(self):
        self.moved += len(self.value or ())
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def appendList(self, values):
        self.moved += len(values)
        self.value = (self.value or []) + values

    def put(self, values):
        self.moved += len(values)
        self.value = list(values)

    def iterator(self):
        return iter((self.value or {}).items())

    def updateValue(self, key, value):
        self.moved += 1
        self.value = {**(self.value or {}), key: value}


class Handle:
    def __init__(self):
        self.timers, self.now = set(), -1
        self.value, self.map, self.list = Held(), Held(), Held()

    def getValueState(self, *_):
        return self.value

    def getMapState(self, *_):
        return self.map

    def getListState(self, *_):
        return self.list

    def listTimers(self):
        return sorted(self.timers)

    def deleteTimer(self, t):
        self.timers.discard(t)

    def registerTimer(self, t):
        self.timers.add(t)

    def getCurrentWatermarkInMs(self):
        return self.now


def test_work_grows_with_new_events_only():
    """One user of a hundred thousand events in eight batches: each event is read and written in two batches, its own and the next."""
    names = ["date", "event_id", "kind", "server_id", "world", "mode", "exempt"]
    kinds = ["join", "world", "action", "mob_kill", "world", "death", "afk"]
    events = [dict(zip(names, (10**9 + i * 1000, i, kinds[i % 7 if i else 0], 1, f"w|{i % 3}", i % 4, False), strict=True)) for i in range(100_000)]
    for e in events[1:]:
        e["kind"] = "action" if e["kind"] == "join" else e["kind"]
    handle, user = Handle(), sessions.Sessions(180_000, None)
    user.init(handle)
    out, worst = [], 0
    for a in range(0, 100_000, 12_500):
        before = handle.list.moved + handle.map.moved
        out += list(user.handleInputRows((7,), events[a:a + 12_500], handle))
        while handle.timers and min(handle.timers) <= handle.now:
            due = min(handle.timers)
            out += list(user.handleExpiredTimer((7,), handle, None))
            handle.timers.remove(due)
        worst = max(worst, handle.list.moved + handle.map.moved - before)
        handle.now = events[a + 12_499]["date"] - 600_000
    assert worst <= 4.5 * 12_500 and handle.list.moved + handle.map.moved <= 4.5 * 100_000
    assert not out and len(handle.map.value) == 12 and set(k[0] for k in handle.map.value) == {"w|0", "w|1", "w|2"}


def test_groups_of_users_give_what_single_users_give(spark, tmp_path):
    """Lost leaves, late events and users without an id, in one group, few groups and a key a user."""
    data = in_disorder(event_log(seed=12, users=40, n=600))
    data = [(*e[:1], None if e[1] == 7 else e[1], *e[2:]) for e in data]
    data += [(9_000, 3, 1, "join", data[20][4], "w0", 0), (9_001, 50, 1, "join", data[-1][4] + 10**8, "w0", 0)]
    found = []
    for groups in (None, 1, 3):
        got = rows_of(spark, as_stream(spark, tmp_path / str(groups), data, 5), session_timeout=30 * MINUTE, groups=groups)
        found.append(sorted(map(str, got.select("user_id", "late", F.struct("session.*").dropFields("world_times"), F.array_sort("session.world_times")).collect())))
    assert found[0] == found[1] == found[2] and len(found[0]) > 100
    assert any("event_id=9000" in r for r in found[0])


class Counted(Handle):
    """A handle that counts the calls to state, each of which is a message to Spark."""

    def __init__(self):
        super().__init__()
        self.calls = 0

    def __getattribute__(self, name):
        if name in ("listTimers", "deleteTimer", "registerTimer"):
            self.calls += 1
        return super().__getattribute__(name)


def test_calls_to_state_do_not_grow_with_users():
    def calls(users):
        handle, group = Counted(), sessions.SessionGroups(180_000, None)
        group.init(handle)
        for held in (handle.map, handle.list):
            for name in ("get", "put", "clear", "appendList", "iterator", "updateValue"):
                def count(*args, own=getattr(held, name)):
                    handle.calls += 1
                    return own(*args)

                setattr(held, name, count)
        out = []
        for batch in range(3):
            events = [(u, 10**9 + batch * 10**6 + k, 10 * u + k, kind, 1, "w", 0, False) for u in range(users) for k, kind in enumerate(("join", "action", "leave"))]
            row = dict(zip(["user_id", *sessions.FIELDS], map(list, zip(*events, strict=True)), strict=True))
            out += list(group.handleInputRows((0,), [row], handle))
            handle.now = 10**9 + batch * 10**6 + 10
            for due in [t for t in handle.timers if t <= handle.now]:
                out += list(group.handleExpiredTimer((0,), handle, None))
                handle.timers.discard(due)
        assert len(out) == 3 * users
        return handle.calls

    assert calls(2_000) == calls(100) < 40


def run_events(*events, threshold=60_000):
    session, times, rows = None, {}, []
    for i, (kind, date) in enumerate(events):
        session, times, done = sessions.apply_event(session, times, (date, i, kind, 1, "w", 0, False), threshold)
        if done:
            rows.append(done)
    return session, rows


@pytest.mark.parametrize(
    ("events", "afk"),
    [
        ([("join", 0), ("action", 59_999), ("leave", 100_000)], 0),
        ([("join", 0), ("action", 60_000), ("leave", 60_001)], 60_000),
        ([("join", 0), ("action", 10), ("action", 120_010), ("leave", 120_020)], 120_000),
        ([("join", 0), ("afk", 5_000), ("action", 6_000), ("leave", 7_000)], 1_000),
        ([("join", 0), ("leave", 120_000)], 120_000),
    ],
)
def test_afk_rules(rows, events, afk):
    _, done = run_events(*events)
    assert done[0][3] == afk
    log = rows([(i, 1, 1, k, d, "w", 0) for i, (k, d) in enumerate(events)], EVENTS)
    assert life.afk_times(log, 60_000).first()["afk_time"] == afk
    nobody = life.afk_times(log, 60_000, exempt=rows([(1,)], "user_id bigint"))
    assert nobody.collect() == []


def test_leave_without_join_and_open_session():
    session, done = run_events(("leave", 5), ("join", 10), ("join", 20))
    assert [d[1:3] for d in done] == [(10, 20)] and done[0][4] is True and session["start"] == 20


def test_world_times_credit_the_previous_world():
    _, done = run_events(("join", 0), ("world", 10), ("world", 25), ("leave", 40))
    assert done[0][-1] == [("w", 0, 40)]


def test_live_minutes_equal_batch(spark, rows, tmp_path):
    r = random.Random(3)
    schema = "id bigint, server_id int, date bigint, tps double, players int, cpu double, ram bigint, entities int, chunks int, disk bigint, mspt bigint"
    data = [(i, 1 + i % 2, 10**9 + i * 1_700, r.random() * 20 - 1, r.randrange(9), r.random(), r.randrange(100), i, i, i, r.choice([None, 0, 1 + r.randrange(50)])) for i in range(600)]
    data += [(900, 3, 10**9, 1.0, 1, 1.0, 1, 1, 1, 1, None), (901, 4, 10**9, -1.0, 1, 1.0, 1, 1, 1, 1, 5)]
    rows(data, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = replay.file_stream(spark, str(tmp_path / "in"), rows(data[:1], schema).schema)
    done = spark.read.parquet(replay.drain_closed(stream, rollups.live_minutes, "minutes"))
    batch = life.minute_rollup(rows(data, schema))
    assert set(done.columns) == set(batch.columns)
    rounded = lambda frame: frame.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in batch.dtypes])
    assert sorted(map(str, rounded(done).collect())) == sorted(map(str, rounded(batch).collect()))


def test_tick_clock(rows):
    s = 10**9
    ticks = life.tick_tps(rows([(1, t) for t in (0, s // 2, s + s // 2, 42 * s + s // 2)], "server_id int, ns bigint"))
    got = tuples(ticks, "ns", "tps", "weight")
    # Half a second counts as one; 41 s is two zero samples and a rest of one second.
    assert got == [(s // 2, 20.0, 1), (s + s // 2, 20.0, 1), (42 * s + s // 2, 0.0, 2), (42 * s + s // 2, 20.0, 1)]


def test_ping_rollup_out_of_range(rows):
    df = rows([(1, 1, 5, 0), (1, 1, 6, 5000), (1, 1, 7, 10)], "user_id bigint, server_id int, date bigint, value int")
    got = life.ping_rollup(df).first()
    assert (got["date"], got["min_ping"], got["max_ping"], got["avg_ping"]) == (7, 10, 10, 10.0)


def test_repeated_batch_replaces_itself(spark, rows, tmp_path):
    registry = metrics.Registry()

    @registry.metric("number", on=("leave",))
    def visits(tables):
        return tables["sessions"].groupBy(F.col("user_id").alias("key")).agg(F.count("*").alias("value"))

    sessions_ = rows([(1,), (1,), (2,)], "user_id bigint")
    write = batches.refresh_metrics(registry, {"sessions": sessions_}, "leave")
    batch = rows([(1, "leave"), (2, "join")], "user_id bigint, kind string")
    for _ in range(2):
        write(batch, 0, str(tmp_path / "out"))
    assert tuples(spark.read.parquet(str(tmp_path / "out")), "key", "long_value") == [(1, 2)]


def test_installed_after_changes(rows):
    schema = "id bigint, server_id int, plugin_name string, version string, modified bigint"
    df = rows([(1, 1, "a", "1", 5), (2, 1, "a", None, 9), (3, 1, "b", "1", 5)], schema)
    assert tuples(roster.installed_plugins(df), "plugin_name") == [("b",)]


def test_null_modes_and_bars_in_names_stay():
    events = [(0, 1, "join", 1, "w|1", None, False), (10, 2, "world", None, "w", 2, False), (30, 3, "leave", None, None, None, False)]
    session, times, done = None, {}, None
    for event in events:
        session, times, done = sessions.apply_event(session, times, event)
    assert done[-1] == [("w|1", None, 10), ("w", 2, 20)]


def test_newest_batch_wins_and_batches_can_be_repeated(rows, spark, tmp_path):
    schema = rows([], "plugin string, provider string, key bigint, double_value double").schema
    path = str(tmp_path / "metrics")
    for batch, value in ((0, 1.0), (1, 2.0), (1, 3.0)):
        sinks.write_batch(rows([("p", "n", 7, value)], schema), path, batch)
    assert [tuple(r) for r in batches.refreshed_metrics(spark, path, schema).collect()] == [("p", "n", 7, 3.0)]
    assert batches.refreshed_metrics(spark, str(tmp_path / "nothing"), schema).count() == 0


def test_plugin_changes_are_recorded_once(rows, spark, tmp_path):
    path = str(tmp_path / "plugins")
    installed = rows([(1, "a", "1"), (1, "b", "1"), (2, "a", "1")], "server_id int, plugin_name string, version string")
    write = batches.record_plugin_changes(installed, 99)
    snapshot = rows([(1, "a", "2"), (1, "c", "1")], installed.schema)
    for batch in (0, 1, 1):
        write(snapshot, batch, path)
    write(rows([(1, "a", "2"), (1, "b", "5"), (1, "c", "1")], installed.schema), 2, path)
    done = spark.read.parquet(path).select("batch", "plugin_name", "version", "change").collect()
    assert sorted(map(tuple, done)) == [(0, "a", "2", "updated"), (0, "b", None, "removed"), (0, "c", "1", "new"), (2, "b", "5", "new")]


def test_split_snapshots_wait_until_they_are_whole(spark, rows, tmp_path):
    path = str(tmp_path / "plugins")
    installed = rows([(1, "a", "1"), (1, "b", "1"), (2, "a", "1")], "server_id int, plugin_name string, version string")
    schema = "server_id int, snapshot bigint, plugins bigint, plugin_name string, version string"
    write = batches.record_split_snapshots(installed, 99)
    parts = [
        [(1, 5, 2, "a", "2"), (2, 5, 1, "a", "1")], [(1, 5, 2, "c", "1"), (1, 5, 2, "a", "2")], [(1, 4, 1, "z", "1")], [(1, 6, 1, "a", "3"), (1, 7, 2, "a", "4")], [(1, 7, 2, "c", "1")],
    ]
    for n, part in enumerate(parts):
        for _ in range(1 + n % 2):
            write(rows(part, schema), n, path)
    done = spark.read.parquet(f"{path}/changes").select("batch", "server_id", "plugin_name", "version", "change").collect()
    assert sorted(map(tuple, done), key=str) == sorted([
        (1, 1, "a", "2", "updated"), (1, 1, "c", "1", "new"), (1, 1, "b", None, "removed"), (3, 1, "a", "3", "updated"), (3, 1, "c", None, "removed"),
        (4, 1, "a", "4", "updated"), (4, 1, "c", "1", "new"),
    ], key=str)


def test_uncommitted_batches_are_not_read(spark, rows, tmp_path):
    root = str(tmp_path / "sessions")
    one = rows([(1, "u", "s", {"w": ({"SURVIVAL": 5},)}, [])], "id bigint, user_uuid string, server_uuid string, world_times map<string, struct<times: map<string, bigint>>>, kills array<struct<killer: struct<uuid: string>, victim: struct<uuid: string>, weapon: string, date: bigint>>")
    sinks.store_sessions(one, root, 0)
    sinks.write_batch(sinks.split_sessions(one)["sessions"], f"{root}/sessions", 1)
    assert spark.read.parquet(f"{root}/sessions").count() == 2 and sinks.committed(spark, root, "sessions").count() == 1
    sinks.store_sessions(one, root, 1)
    assert sinks.committed(spark, root, "sessions").count() == 2 and sinks.committed(spark, root, "world_times").count() == 2
