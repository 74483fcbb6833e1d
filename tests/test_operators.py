"""Boundary rows of single operators."""

import math

import pytest
from pyspark.sql import functions as F

from arenalytics.functions import clock, stats
from arenalytics.operators import activity, combat, geo, join_address, joins, metrics, quality, roster, samples, series, sessions
from tests.conftest import tuples

SESSION = "id bigint, user_id bigint, server_id int, session_start bigint, session_end bigint, mob_kills int, deaths int, afk_time bigint, join_address_id int"
SAMPLE = "server_id int, date bigint, id bigint, tps double, players_online int"
WEEK = clock.WEEK


def make_sessions(rows, spans):
    return rows([(i, u, s, a, b, 0, 0, afk, 1) for i, (u, s, a, b, afk) in enumerate(spans)], SESSION)


def test_gap_limits(rows):
    df = rows([(1, d, d, 20.0, 1) for d in (0, 120_000, 300_000, 420_001, 600_000)], SAMPLE)
    closed = samples.up_and_down_time(df, 0, 10**9).first()
    assert (closed["uptime"], closed["downtime"]) == (120_000, 180_000)
    exclusive = samples.up_and_down_time(df, 0, 10**9, exclusive=True).first()
    assert (exclusive["uptime"], exclusive["downtime"]) == (0, 0)
    # 180 000 ms apart starts a new run, so only the other three gaps count.
    assert samples.occupied_time(df, 0, 10**9).first()["occupied"] == 120_000 + 120_001 + 179_999


def test_single_sample_and_no_sample(rows):
    df = rows([(1, 5, 1, 20.0, 1)], SAMPLE)
    assert samples.up_and_down_time(df, 0, 10).collect() == []
    assert samples.peak_players(df, 6, 10).collect() == []
    assert samples.latest_start(df).first()["start"] == 5


def test_spikes(rows):
    values = [20, 5, 5, 20, -1, 5, 0, 5, 20, 5]
    df = rows([(1, i * 60_000, i, float(v), 1) for i, v in enumerate(values)], SAMPLE)
    # SQL form: a low value after −1 or 0 does not open a spike; in-memory form: 0 is low, −1 ends a spike.
    assert samples.low_tps_spikes(df, 10, 0, 10**9).first()["spikes"] == 2
    assert samples.low_tps_spikes_by_sample(df, 10, 0, 10**9).first()["spikes"] == 3


def test_resolution_buckets(rows):
    columns = ["server_id", "date", *samples.METRICS]
    data = [
        (1, 1000, 20.0, 1, 10.0, 1, 1, 1, 1, 5.0, 5.0, 1.0, 1.0),
        (1, 2000, 12.0, 9, 80.0, 1, 1, 1, 1, 80.0, 80.0, 3.0, 3.0),
        (1, 3000, 18.0, 1, 10.0, 1, 1, 1, 1, None, None, None, None),
        (1, 20000, 20.0, 1, 10.0, 1, 1, 1, 1, 12.0, 12.0, 1.0, 1.0),
    ]
    types = ["int", "bigint", "double", "int", "double", "bigint", "int", "int", "bigint", "double", "double", "double", "double"]
    df = rows(data, ", ".join(f"{c} {t}" for c, t in zip(columns, types)))
    got = samples.in_resolution(df, 0, 10**6, 10_000).orderBy("date").collect()
    assert [r["date"] for r in got] == [1000, 20000]
    first = got[0]
    assert (first["mspt_average"], first["tps"], first["cpu_usage"], first["mspt_jitter_avg"], first["players_online"]) == (80.0, 12.0, 80.0, 2.0, 9)


def test_peak_takes_latest_date_on_ties(rows):
    df = rows([(1, 1, 1, 20.0, 7), (1, 9, 2, 20.0, 7), (1, 12, 3, 20.0, 2)], SAMPLE)
    assert tuples(samples.peak_players(df, 0, 100)) == [(1, 9, 7)]


def test_activity_index_formula(rows):
    date, hour = 10 * WEEK, 3_600_000
    spans = [(1, 1, date - hour, date - hour // 2, 0), (1, 1, date - WEEK - hour, date - WEEK - hour + 7_200_000, hour)]
    users = rows([(1, 0), (2, 0)], "user_id bigint, registered bigint")
    got = dict(tuples(activity.activity_index(make_sessions(rows, spans), users, date, hour), "user_id", "activity_index"))
    # The second session crosses the week edge and counts in both weeks: 0.5 h + 1 h and 1 h.
    weeks = [1.5, 1.0, 0.0]
    want = 5 - 5 * sum(1 / (math.pi / 2 * w + 1) for w in weeks) / 3
    assert got[1] == pytest.approx(want) and got[2] == 0.0


def test_week_edges_closed_and_half_open(rows):
    date = 10 * WEEK
    df = make_sessions(rows, [(1, 1, date, date + 1000, 0)])
    base = rows([(1, 0)], "user_id bigint, registered bigint")
    assert activity.activity_index(df, base, date, 1000, closed=True).first()["activity_index"] > 0
    assert activity.activity_index(df, base, date, 1000, closed=False).first()["activity_index"] == 0


def test_group_limits(rows):
    df = rows([(v,) for v in (0.0, 0.999, 1.0, 2.0, 3.0, 3.75, 5.0)], "activity_index double")
    got = [r["g"] for r in df.select("activity_index", activity.activity_group().alias("g")).orderBy("activity_index").collect()]
    assert got == ["Inactive", "Inactive", "Irregular", "Regular", "Active", "Very Active", "Very Active"]


def test_empty_length_stats(rows):
    empty = make_sessions(rows, [(1, 1, 0, 10, 0)]).where("id > 5")
    assert tuple(sessions.length_stats(empty).first()) == (-1, 0, -1.0)


def test_summary_of_an_empty_set(rows):
    df = make_sessions(rows, [(1, 1, 0, 10, 0)])
    nobody = rows([(1,)], "user_id bigint").where("user_id > 5")
    got = sessions.summary_of_players(df, nobody, 0, 100).first()
    assert got["average_playtime"] == -1 and got["average_session_length"] == -1 and got["total_sessions"] == 0


@pytest.mark.parametrize("n", [2, 3, 1001])
def test_latest_sessions_keep_ties(rows, n):
    df = make_sessions(rows, [(1, 1, t, t + 1, 0) for t in (10, 20, 20, 7_300_000, 7_300_000, 7_300_001)])
    starts = sorted(r["session_start"] for r in sessions.latest_sessions(df, n).collect())
    assert starts == {2: [7_300_000, 7_300_000, 7_300_001], 3: [7_300_000, 7_300_000, 7_300_001]}.get(n, [10, 20, 20, 7_300_000, 7_300_000, 7_300_001])


def test_latest_geolocation_keeps_ties(rows):
    df = rows([(1, "A", 5), (1, "B", 5), (1, "C", 4), (2, "A", 1)], "user_id bigint, geolocation string, last_used bigint")
    assert tuples(geo.counts(df)) == [("A", 2), ("B", 1)]


def test_locate(rows):
    ranges = rows([(16777216, 16777471, "X"), (3232235520, 3232301055, "Private?")], "first bigint, last bigint, country string")
    ips = rows([("1.0.0.7",), ("1.0.1.0",), ("127.0.0.1",), ("10.1.2.3",), ("192.168.0.9",), ("::1",)], "ip string")
    assert dict(tuples(geo.locate(ips, ranges))) == {
        "1.0.0.7": "X", "1.0.1.0": "Not Found", "127.0.0.1": "Local Machine", "10.1.2.3": "Local Private Network",
        "192.168.0.9": "Local Private Network", "::1": "Not Found",
    }


@pytest.mark.parametrize(
    ("raw", "clean", "valid"),
    [
        ("Play.A.com:25565", "play.a.com", True),
        ("a.b.c\u0000proxy", "a.b.c", True),
        ("a.b.cfml3fml", "a.b.cfml3", True),
        ("localhost", "localhost", False),
        ("bad host.com", "bad host.com", False),
        ("blocked.net", "", False),
        (None, "", False),
    ],
)
def test_sanitize(rows, raw, clean, valid):
    df = rows([(raw,)], "a string").select(join_address.sanitize(F.col("a"), [r"blocked\..*"]).alias("c"))
    got = df.select("c", join_address.is_valid(F.col("c")).alias("v")).first()
    assert (got["c"], got["v"]) == (clean, valid)


def test_redaction_needs_a_full_match_and_ignores_the_sample(rows):
    df = rows([(1, "play.a.com"), (2, "xplay.a.com")], "id int, join_address string")
    assert tuples(join_address.redact(df, [r"play\..*"])) == [(1, "unknown"), (2, "xplay.a.com")]
    assert join_address.redact(df, [join_address.SAMPLE_PATTERN]) is df


def test_kdr_needs_both_sides(rows):
    kills = rows([(1, "a", "b", 1, 5), (2, "a", "b", 1, 6), (3, "b", "a", 1, 7), (4, "c", "a", 1, 8)], "id int, killer_uuid string, victim_uuid string, server_id int, date bigint")
    users = rows([("a",), ("b",), ("c",)], "uuid string")
    assert combat.average_kdr(kills, users, 0, 100).first()["kdr"] == pytest.approx((2 / 2 + 1 / 2) / 2)


def test_lonely_joins_before_first_sample(rows):
    df = make_sessions(rows, [(1, 1, 5, 50, 0), (1, 1, 15, 50, 0), (1, 1, 15, 60, 0), (1, 1, 30, 60, 0)])
    states = rows([(1, 10, 1, 20.0, 0), (1, 20, 2, 20.0, 3)], SAMPLE)
    assert joins.lonely_joins(df, states).first()["lonely_joins"] == 2


def test_fill_missing(rows):
    df = rows([(0, 5), (30, 6)], "x bigint, y bigint")
    assert tuples(series.fill_missing(df, [], "x", "y", 10, 50)) == [(0, 5), (10, 0), (20, 0), (30, 6), (40, 0)]


def test_gap_markers(rows):
    df = rows([(1, 0), (1, 180_000), (1, 400_000)], "k int, x bigint")
    assert tuples(series.gap_markers(df, ["k"], "x", every=60_000)) == [(1, 240_000), (1, 300_000), (1, 360_000)]


def test_clock_segments(rows):
    df = make_sessions(rows, [(1, 1, 10, 30, 0), (2, 1, clock.DAY + 20, clock.DAY + 30, 0)])
    assert tuples(series.clock_segments(df)) == [(0, 10, 0), (10, 20, 1), (20, 30, 2)]


def test_punch_card_cells(rows):
    monday = 4 * clock.DAY  # the epoch was a Thursday
    cells = series.punch_card(make_sessions(rows, [(1, 1, monday + 3_600_000, monday + 3_700_000, 0)])).collect()
    assert len(cells) == 168
    assert [(c["day"], c["hour"], c["z"]) for c in cells if c["n"]] == [(0, 1, 14)]


def test_ratio_and_integer_division(rows):
    df = rows([(7, 2), (-7, 2), (7, 0)], "a bigint, b bigint").select(
        stats.ratio(F.col("a"), F.col("b"), -1.0).alias("r"), stats.int_ratio(F.col("a"), F.col("b")).alias("i")
    )
    assert [tuple(r) for r in df.collect()] == [(3.5, 3), (-3.5, -3), (-1.0, 0)]


def test_trend_direction(rows):
    df = rows([(1, 3), (3, 1), (2, 2)], "b bigint, a bigint").select(*stats.trend_columns("x", F.col("b"), F.col("a")))
    assert [tuple(r) for r in df.collect()] == [(2, "+"), (2, "-"), (0, None)]


def test_plugin_changes(rows):
    schema = "server_id int, plugin_name string, version string"
    old = rows([(1, "a", "1"), (1, "b", "1"), (1, "c", "1")], schema)
    new = rows([(1, "a", "1"), (1, "b", "2"), (1, "d", "1")], schema)
    got = roster.plugin_changes(old, new, 9)
    assert {(r["plugin_name"], r["version"], r["change"]) for r in got.collect()} == {("b", "2", "updated"), ("c", None, "removed"), ("d", "1", "new")}


def test_new_ids_are_consecutive(rows):
    df = rows([(7,), (100_000,), (3,), (200_000,)], "old bigint")
    assert tuples(quality.new_ids(df, "old", F.lit(50))) == [(3, 50), (7, 51), (100_000, 52), (200_000, 53)]


def test_afk_reset(rows):
    df = make_sessions(rows, [(1, 1, 0, 100, 97), (1, 1, 0, 100, 95)])
    assert [r["afk_time"] for r in quality.reset_bad_afk(df).orderBy("id").collect()] == [0, 95]


def test_same_name_users_stay_apart(rows):
    users = rows([(1, "x"), (2, "x")], "id bigint, name string")
    df = make_sessions(rows, [(1, 1, 10, 20, 0), (2, 1, 10, 40, 0)])
    top = combat.top_playtime(df, users, 0, 100)
    assert tuples(top, "user_id", "score") == [(1, 10), (2, 30)]


def test_int_ratio_is_exact_beyond_doubles(rows):
    df = rows([(2**60 + 1, 1), (-7, 2), (7, -2), (5, 0)], "a bigint, b bigint")
    got = [r[0] for r in df.select(stats.int_ratio(F.col("a"), F.col("b"), -1)).collect()]
    assert got == [2**60 + 1, -3, -3, -1]


def test_no_servers_means_all(rows):
    df = rows([(1, "a", "u", 1)], "server_id int, name string, uuid string, modified bigint")
    assert roster.allowlist_bounces(df, []).count() == roster.allowlist_bounces(df).count() == 1


def test_hidden_providers_are_left_out(rows):
    providers = rows([(1, "a", 1, "NONE", False), (2, "b", 1, "NONE", True), (3, "c", 1, "NONE", None)], "id int, name string, plugin_id int, format string, hidden boolean")
    plugins = rows([(1, "p", 1)], "id int, name string, server_id int")
    values = rows([(i, 1.0) for i in (1, 2, 3)], "provider_id int, double_value double")
    assert tuples(metrics.double_stats(values, providers, plugins), "provider") == [("a",), ("c",)]
    assert metrics.with_metadata(values, providers, plugins, hidden=True).count() == 3


def test_numbered_rows_are_consecutive_and_unique(rows):
    df = rows([(f"u-{i % 40}", i) for i in range(60)], "uuid string, n int")
    got = quality.numbered(df, "uuid", F.lit(100)).collect()
    assert sorted(r["new_id"] for r in got) == list(range(100, 160))
    assert {(r["uuid"], r["n"]) for r in got} == {(f"u-{i % 40}", i) for i in range(60)}


ADDRESSES = [
    "1.2.3.4", "0.0.0.0", "255.255.255.255", "256.1.1.1", "1.2.3", "::", "::1", "1::", "2001:db8::ff00:42:8329", "2001:0DB8:0000:0000:0000:FF00:0042:8329",
    "::ffff:10.1.2.3", "64:ff9b::192.0.2.33", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "1:2:3:4:5:6:7", "1::2::3", "12345::", "g::1", "", None, "nonsense", "1:2:3:4:5:6:1.2.3.4", ":::",
]


def parsed(text):
    import ipaddress

    try:
        a = ipaddress.ip_address(text or "")
    except ValueError:
        return None
    return int(a) + (0xFFFF << 32 if a.version == 4 else 0)


def test_address_bits(rows):
    from arenalytics.operators import geo

    df = rows([(a,) for a in ADDRESSES], "ip string")
    got = {r.ip: r.b for r in df.select("ip", geo.address_bits(F.col("ip")).alias("b")).collect()}
    assert got == {a: None if parsed(a) is None else f"{parsed(a):0128b}" for a in ADDRESSES}


def test_longest_prefix_of_nested_networks(rows):
    from arenalytics.operators import geo

    networks = [("0.0.0.0/0", "v4"), ("1.0.0.0/8", "one"), ("1.2.0.0/16", "one two"), ("1.2.3.4/32", "host"), ("1.2.3.4", "again"), ("::/0", "all"), ("2001:db8::/32", "docs"),
                ("2001:db8::ff00:0:0/80", "deep"), ("64:ff9b::/96", "nat"), ("bad/8", "x"), ("1.2.3.0/33", "y"), (None, "z")]
    ips = [a for a in ADDRESSES] + ["1.2.9.9", "1.9.9.9", "2001:db8:1::"]
    found = geo.locate_by_prefix(rows([(a,) for a in ips], "ip string"), rows(networks, "cidr string, country string"))
    got = {r.ip: r.country for r in found.collect()}
    assert got["1.2.3.4"] == "again" and got["1.2.9.9"] == "one two" and got["1.9.9.9"] == "one" and got["0.0.0.0"] == "v4"
    assert got["2001:db8::ff00:42:8329"] == "deep" and got["2001:db8:1::"] == "docs" and got["64:ff9b::192.0.2.33"] == "nat" and got["::1"] == "all"
    assert got["nonsense"] == got["256.1.1.1"] == got[None] == "Not Found"
    assert geo.locate_by_prefix(rows([("1.2.3.4",)], "ip string"), rows([], "cidr string, country string")).first()["country"] == "Not Found"


def test_name_index_equals_scan(spark, rows, tmp_path):
    from arenalytics.operators import roster

    users = rows([("u1", "Alice"), ("u2", "bob"), ("u3", "Al"), ("u4", None), ("u5", "ALICIA"), ("u6", "")], "uuid string, name string")
    nicknames = rows([("u2", "the Alien"), ("u2", "x"), ("u3", "li"), ("u9", "alice"), ("u5", None), ("u5", "aaaa")], "uuid string, nickname string")
    roster.write_name_index(users, nicknames, str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    for text in ("ali", "ALIC", "li", "a", "aaaa", "lien", "zzz", "", "bob", "e a"):
        assert tuples(roster.indexed_names(index, text)) == sorted(r for r in tuples(roster.matching_names(users, nicknames, text)) if r[0] is not None)


def test_unique_cells_merge_over_parts_and_bitmaps(rows):
    from arenalytics.operators import players

    data = [(u, 1 + u % 2, h * 3_600_000 + 5, h * 3_600_000 + 10) for u in (0, 1, 2, 32767, 32768, 32769, 100_000) for h in range(0, 400, 1 + u % 5)]
    df = rows(data, "user_id bigint, server_id int, session_start bigint, session_end bigint")
    cells = players.unique_cells(df.limit(50), 0, 10**12).unionByName(players.unique_cells(df, 0, 10**12))
    got = {(r.period, r.date): r.players for r in players.unique_rollup(cells).collect()}
    for name, width in players.PERIODS.items():
        want = {}
        for u, _, s, _ in data:
            want.setdefault((name, s - s % width), set()).add(u)
        assert {k: v for k, v in got.items() if k[0] == name} == {k: len(v) for k, v in want.items()}
