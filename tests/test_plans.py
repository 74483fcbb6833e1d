"""Segments, KPIs, metrics, sources, sinks, and what the physical plans must not contain."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

import catalog
from arenalytics import schema
from arenalytics.operators import activity, metrics, segments
from arenalytics.operators.segments import Filter
from arenalytics.plans import kpis, queries
from arenalytics.session import shared_folder
from arenalytics.sources import imports, recovery, sinks, tables
from catalog.domain import A, B, Domain
from tests.conftest import tuples

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def domain(spark):
    return Domain(spark, SMALL)


def plan(frame):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        frame.explain("formatted")
    return out.getvalue()


def test_time_parsing():
    assert segments.parse_time("01/01/2024", "24:00") == 1704067200000
    assert segments.parse_time("01/01/2024", "13:30", offset=3_600_000) == 1704067200000 + 12 * 3_600_000 + 30 * 60_000
    with pytest.raises(ValueError):
        segments.parse_time("2024-01-01", "13:30")


def test_unknown_filter_and_empty_list(domain):
    with pytest.raises(ValueError):
        segments.matching_users(domain, Filter("nonsense"))
    everyone = segments.run(domain, [])
    assert everyone.members().count() == domain.users.count()
    assert [tuple(r) for r in everyone.path().collect()] == [(1, "allPlayers", domain.users.count())]


def test_complete_selection_is_skipped(domain):
    run = segments.run(domain, [Filter("activityIndexNow", {"selected": activity.GROUPS, "now": B})])
    assert run.path().first()["kind"] == "activityIndexNow (skip)" and run.members().count() == domain.users.count()


def test_kpi_scope_is_checked(domain):
    with pytest.raises(ValueError, match="server scope|network scope"):
        kpis.kpi_value(domain, "DISK_MAX", kpis.Scope(A, B))
    with pytest.raises(ValueError, match="player"):
        kpis.kpi_value(domain, "UNIQUE_PLAYERS_COUNT", kpis.Scope(A, B, per_user=True))
    with pytest.raises(ValueError, match="unknown"):
        kpis.kpi_value(domain, "NOPE", kpis.Scope(A, B))
    assert len(kpis.BY_NAME) + len(kpis.BREAKDOWNS) == 46


def test_single_kpi_equals_its_table_row(domain):
    s = kpis.Scope(A, B)
    table = dict(tuples(kpis.kpi_table(domain, s, ["PLAYTIME", "SESSION_COUNT"])))
    assert kpis.kpi_value(domain, "PLAYTIME", s).first()["value"] == table["PLAYTIME"]


def test_metric_registry_rejects_unknown_kinds():
    registry = metrics.Registry()
    with pytest.raises(ValueError):
        registry.metric("colour")
    with pytest.raises(ValueError):
        registry.metric("number", scope="planet")
    with pytest.raises(ValueError):
        registry.evaluate({}, "user")


def test_free_sql(spark, rows):
    got = queries.run_sql(spark, "select sum(x) s from {t}", t=rows([(1,), (2,)], "x int"))
    assert got.first()["s"] == 3


def test_recovery_lines(spark, tmp_path):
    lines = [
        "u-1;srv-1;10;20;3;{\"times\":{\"w\":{\"times\":{\"SURVIVAL\":7}}}};{\"kills\":[]};{\"count\": 2};{\"count\": 1};play.a.com;Bob",
        "u-2;srv-1;10;20;3",
        "too;few;fields",
        "u-3;srv-1;ten;20;3;;;;",
    ]
    (tmp_path / "lines.txt").write_text("\n".join(lines))
    got = {r["user_uuid"]: r for r in recovery.read(spark, str(tmp_path)).collect()}
    assert set(got) == {"u-1", "u-2"}
    assert got["u-1"]["world_times"]["w"]["times"]["SURVIVAL"] == 7 and got["u-1"]["mob_kills"] == 2 and got["u-1"]["name"] == "Bob"
    assert got["u-2"]["world_times"] is None


def test_upserts(rows):
    old = rows([("a", 1, 5), ("b", 1, 5)], "k string, v int, at bigint")
    new = rows([("a", 2, 5), ("b", 2, 4), ("c", 9, 1)], "k string, v int, at bigint")
    assert tuples(sinks.upsert_latest(old, new, ["k"], "at"), "k", "v") == [("a", 2), ("b", 1), ("c", 9)]
    people = rows([(1, "a", 50, "Ann", 0)], "id bigint, uuid string, registered bigint, name string, times_kicked int")
    seen = rows([("a", "Other", 40), ("b", None, 7)], "uuid string, name string, registered bigint")
    got = {r["uuid"]: r for r in sinks.upsert_registrations(people, seen).collect()}
    assert (got["a"]["registered"], got["a"]["name"], got["b"]["name"], got["b"]["registered"]) == (40, "Ann", "b", 7)


def test_import_drops_bad_rows(rows):
    ddl = "id bigint, uuid string, registered bigint, name string, times_kicked int"
    users = rows([(4, "a", 50, "Ann", 0)], ddl)
    incoming = rows([(0, "a", 1, "x", 0), (0, "b", 9, "late", 1), (0, "b", 5, "early", 0), (0, None, 5, "x", 0), (0, "c", 0, "x", 0)], ddl)
    got = {r["uuid"]: r for r in imports.import_users(users, incoming).collect()}
    assert set(got) == {"a", "b"} and got["b"]["id"] == 5 and got["b"]["registered"] == 5 and got["b"]["name"] == "late"
    spans = rows([("a", "s", 10, 5), ("a", "s", 10, 20), ("a", "s", 10, 30)], "user_uuid string, server_uuid string, session_start bigint, session_end bigint")
    assert tuples(imports.valid_sessions(spans), "session_end") == [(30,)]


def test_tables_read_with_declared_schema(spark, domain, tmp_path):
    domain.ping.write.parquet(str(tmp_path / "ping"))
    stored = tables.Tables(spark, str(tmp_path)).ping
    assert stored.dtypes == [(f.name, f.dataType.simpleString()) for f in schema.struct("ping")]
    assert stored.count() == domain.ping.count()
    with pytest.raises(AttributeError):
        tables.Tables(spark, str(tmp_path)).nonsense


def test_shared_folder_uses_the_session_setting(spark):
    assert shared_folder(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_filters_and_columns_reach_the_scan(spark, domain, tmp_path):
    from arenalytics.operators import sessions

    domain.sessions.write.parquet(str(tmp_path / "sessions"))
    stored = spark.read.parquet(str(tmp_path / "sessions"))
    text = plan(sessions.playtime(stored, A, B, servers=[1], by=["server_id"]))
    assert "GreaterThanOrEqual(session_end" in text and "LessThanOrEqual(session_start" in text
    read = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert {c.split(":")[0] for c in read.split(",")} == {"server_id", "session_start", "session_end"}
    weekly = plan(activity.weekly_group_counts(stored, domain.users.select(F.col("id").alias("user_id"), "registered"), B, 8))
    assert len(re.findall(r"\(\d+\) Scan parquet", weekly)) == 2  # sessions once, users (derived from events) once


def test_day_layout_prunes_days(spark, domain, tmp_path):
    from arenalytics.sources import layout

    folder = str(tmp_path / "by_day")
    layout.write_by_day(domain.sessions, folder, "session_start")
    window = layout.sessions_overlapping(spark, folder, A, B)
    want = domain.sessions.where((F.col("session_end") >= A) & (F.col("session_start") <= B))
    assert tuples(window, "id") == tuples(want, "id")
    assert re.search(r"PartitionFilters: \[[^\]]*day", plan(window))
    days = layout.read_days(spark, folder, A, A + 1000)
    assert {r[0] for r in days.select(F.floor(F.col("session_start") / 86_400_000)).distinct().collect()} <= {A // 86_400_000}


def test_sized_for():
    from arenalytics.session import sized_for

    big = sized_for(100 * 2**40, 8000)
    assert int(big["spark.sql.shuffle.partitions"]) == 100 * 2**40 // (128 * 2**20)
    assert int(sized_for(2**30, 8)["spark.sql.shuffle.partitions"]) == 16


@pytest.fixture(scope="module")
def on_disk(spark, tmp_path_factory):
    """The derived tables as stored ones, so that a plan shows one scan per read of a table."""
    folder = tmp_path_factory.mktemp("tables")
    stored = Domain(spark, SMALL)
    for name in ("samples", "sessions", "ping", "users", "user_info", "servers", "kills"):
        getattr(Domain(spark, SMALL), name).write.parquet(str(folder / name))
        stored._made[name] = spark.read.parquet(str(folder / name))
    return stored


@pytest.mark.parametrize(
    ("name", "scans", "exchanges"),
    [
        ("tps_6_occupied_time", 1, 2), ("tps_7_uptime", 1, 2), ("tps_8_downtime", 1, 2), ("tps_9_low_tps_spikes", 1, 2),
        ("tps_10_up_and_down_by_sample", 1, 2), ("tps_10_occupied_by_sample", 1, 2), ("tps_10_spikes_by_sample", 1, 2),
        ("tps_18_latest_start", 1, 2), ("tps_19_current_uptime", 1, 2), ("tps_23_performance_numbers", 2, 4),
        ("join_8_ping_per_session", 2, 2), ("join_7b_lonely_joins", 2, 2), ("rep_15_network_performance", 2, 6),
    ],
)
def test_scans_and_exchanges(spark, on_disk, name, scans, exchanges):
    catalog.load()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = plan(catalog.FUNCTIONS[name](on_disk))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(re.findall(r"^\(\d+\) Scan parquet", text, re.MULTILINE)) == scans
    assert len(re.findall(r"^\(\d+\) (?:Reused)?Exchange", text, re.MULTILINE)) <= exchanges


@pytest.mark.parametrize(
    ("name", "most"),
    [("kpi_network", {"sessions": 1, "samples": 3, "user_info": 1, "kills": 1}), ("kpi_servers", {"sessions": 1, "samples": 3, "user_info": 3, "kills": 1}),
     ("rep_3_totals", {"sessions": 3, "samples": 2}), ("tbl_6_server_list", {"sessions": 1, "samples": 4}), ("rep_1_online_activity_numbers", {"sessions": 3})],
)
def test_reads_of_a_fact(spark, on_disk, name, most):
    """Tables of many numbers read each fact a few times, not once a number."""
    catalog.load()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = plan(catalog.FUNCTIONS[name](on_disk))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    reads = {t: len(re.findall(rf"Location: \w+ ?\[[^\]]*/{t}\]", text)) for t in most}
    assert all(0 < reads[t] <= n for t, n in most.items()), reads
