from pyspark.sql import functions as F

from arenalytics.operators import segments as seg
from arenalytics.operators.segments import Filter
from catalog import query
from catalog.activity import GROUP_SQL, all_index_sql
from catalog.domain import A, B, DAY, NOW, T0, THRESHOLD

RANGE = {"afterDate": "08/01/2024", "afterTime": "24:00", "beforeDate": "09/01/2024", "beforeTime": "12:30"}
LO, HI = T0 + 7 * DAY, T0 + 8 * DAY + 12 * 3600000 + 1800000


def _one(name, sql, f):
    @query(name, sql)
    def _(d):
        return seg.matching_users(d, f)


_one("seg_1_all_players", "select id user_id from users", Filter("allPlayers"))
_one(
    "seg_2_activity_on",
    f"select user_id from (select user_id, {GROUP_SQL} g from ({all_index_sql(B, True)}) x) y where g in ('Regular','Irregular')",
    Filter("activityIndexOn", {"selected": ["Regular", "Irregular"], "date": "22/01/2024", "time": "24:00", "threshold": THRESHOLD}),
)
_one(
    "seg_2_activity_now",
    f"select user_id from (select user_id, {GROUP_SQL} g from ({all_index_sql(NOW, True)}) x) y where g='Very Active'",
    Filter("activityIndexNow", {"selected": ["Very Active"], "now": NOW, "threshold": THRESHOLD}),
)
_one("seg_3_banned", "select distinct user_id from user_info where banned", Filter("banned", {"selected": ["banned"]}))
_one("seg_3_not_banned", "select distinct user_id from user_info where not banned", Filter("banned", {"selected": ["not_banned"]}))
_one("seg_4_operators", "select distinct user_id from user_info where opped", Filter("operators", {"selected": ["operators"]}))
_one("seg_5_geolocations", "select distinct user_id from geolocations where geolocation in ('NATION_2','NATION_4')", Filter("geolocations", {"selected": ["nation_2", "C4"]}))
_one(
    "seg_6_join_addresses",
    "select distinct user_id from sessions s join join_address j on j.id=s.join_address_id where join_address='play.a.com'",
    Filter("joinAddresses", {"selected": ["play.a.com"]}),
)
_one(
    "seg_7_last_seen_between",
    f"select user_id from sessions where server_id in (select id from servers where name in ('ASIA','EUROPE')) group by 1 having max(session_end) between {T0 + 26 * DAY} and {T0 + 29 * DAY}",
    Filter("lastSeenBetween", {"servers": ["ASIA", "EUROPE"], "afterDate": "27/01/2024", "afterTime": "24:00", "beforeDate": "30/01/2024", "beforeTime": "24:00"}),
)
_one("seg_8_played_between", f"select distinct user_id from sessions where session_end>={LO} and session_start<={HI}", Filter("playedBetween", RANGE))
_one(
    "seg_9_played_on",
    f"select distinct user_id from sessions where session_end>={B} and session_start<={B}",
    Filter("playedOn", {"date": "22/01/2024", "time": "24:00"}),
)
ZONE = 2 * 3600000 + 1800000
_one("seg_8_played_between_in_zone", f"select distinct user_id from sessions where session_end>={LO - ZONE} and session_start<={HI - ZONE}", Filter("playedBetween", {**RANGE, "offset": ZONE}))
_one("seg_13_registered_in_zone", f"select id user_id from users where registered between {LO + ZONE} and {HI + ZONE}", Filter("registeredBetween", {**RANGE, "offset": -ZONE}))
_one(
    "seg_7_last_seen_in_zone",
    f"select user_id from sessions group by 1 having max(session_end) between {T0 + 26 * DAY - ZONE} and {T0 + 29 * DAY - ZONE}",
    Filter("lastSeenBetween", {"afterDate": "27/01/2024", "afterTime": "24:00", "beforeDate": "30/01/2024", "beforeTime": "24:00", "offset": ZONE}),
)
_one(
    "seg_9_played_on_in_zone",
    f"select distinct user_id from sessions where session_end>={B - ZONE} and session_start<={B - ZONE}",
    Filter("playedOn", {"date": "22/01/2024", "time": "24:00", "offset": ZONE}),
)
_one("seg_10_played_on_server", "select distinct user_id from user_info where server_id=(select id from servers where name='ASIA')", Filter("playedOnServer", {"selected": ["ASIA"]}))
_one(
    "seg_11_boolean_groups",
    """select distinct user_id from metric_user_values v join metric_providers p on p.id=v.provider_id join metric_plugins l on l.id=p.plugin_id join servers s on s.id=l.server_id
 where p.name='provider-0' and ((s.name='ASIA' and l.name='plugin-ASIA' and boolean_value) or (s.name='EUROPE' and l.name='plugin-EUROPE' and boolean_value is not null))""",
    Filter("pluginsBooleanGroups", {"selected": ["ASIA,plugin-ASIA,provider-0: true", "EUROPE,plugin-EUROPE,provider-0: true", "EUROPE,plugin-EUROPE,provider-0: false"]}),
)
_one(
    "seg_12_plugin_groups",
    """select distinct user_id from metric_groups g join metric_providers p on p.id=g.provider_id join metric_plugins l on l.id=p.plugin_id
 where p.name='provider-4' and l.name='plugin-ASIA' and group_name in ('group-2','group-3')""",
    Filter("pluginGroups", {"server": "ASIA", "plugin": "plugin-ASIA", "provider": "provider-4", "selected": ["group-2", "group-3"]}),
)
_one("seg_13_registered_between", f"select id user_id from users where registered between {LO} and {HI}", Filter("registeredBetween", RANGE))
_one(
    "seg_13_registered_on_servers",
    f"select distinct user_id from user_info where registered between {LO} and {HI} and server_id in (select id from servers where name='AFRICA')",
    Filter("registeredBetween", {**RANGE, "servers": ["AFRICA"]}),
)

PIPELINE = [
    Filter("playedBetween", {"afterDate": "08/01/2024", "afterTime": "24:00"}),
    Filter("banned", {"selected": ["banned", "not_banned"]}),
    Filter("operators", {"selected": ["non_operators"]}),
    Filter("geolocations", {"selected": ["NATION_1", "NATION_2", "NATION_3", "NATION_4"]}),
]
F0 = f"(select user_id from sessions where session_end>={LO})"
F1 = "(select user_id from user_info where not opped)"
F2 = "(select user_id from geolocations where geolocation in ('NATION_1','NATION_2','NATION_3','NATION_4'))"


@query("seg_0_members", f"select id user_id from users where id in {F0} and id in {F1} and id in {F2}")
def _(d):
    return seg.run(d, PIPELINE).members()


@query("seg_0_path", f"""select cast(step as int) step, kind, size from (values (1,'playedBetween',(select count(*) from users where id in {F0})),
 (2,'banned (skip)',(select count(*) from users where id in {F0})), (3,'operators',(select count(*) from users where id in {F0} and id in {F1})),
 (4,'geolocations',(select count(*) from users where id in {F0} and id in {F1} and id in {F2}))) v(step, kind, size)""")
def _(d):
    return seg.run(d, PIPELINE).path()


@query("seg_0_path_stops_when_empty", f"""with a as (select id from users where registered>={T0 + 2192 * DAY}), b as (select id from a where id in {F0})
 select cast(1 as int) step, 'registeredBetween' kind, (select count(*) from a) size union all
 select cast(2 as int), 'playedBetween', (select count(*) from b) where (select count(*) from a)>0""")
def _(d):
    nobody = Filter("registeredBetween", {"afterDate": "01/01/2030", "afterTime": "24:00"})
    return seg.run(d, [nobody, *PIPELINE]).path()


@query("seg_12_group_options", """select distinct s.name server, l.name plugin, p.name provider, group_name from metric_groups g join metric_providers p on p.id=g.provider_id
 join metric_plugins l on l.id=p.plugin_id join servers s on s.id=l.server_id""")
def _(d):
    return seg.group_filter_options(d.metric_groups, d.metric_providers, d.metric_plugins, d.servers)


@query("seg_14_range_options", f"select min(registered) as after, cast({NOW} as bigint) as before from users")
def _(d):
    return seg.range_options(d.users, NOW)


@query("seg_15_segment_view", f"""with m as (select id user_id from users where id in {F0} and id in {F1} and id in {F2})
 select 'activity' part, concat(cast(date as varchar),' ',activity_group) as key, count(*) as value from (
 {' union all '.join(f"select {B - k * 7 * DAY} date, {GROUP_SQL} activity_group, user_id from ({all_index_sql(B - k * 7 * DAY, True)}) x{k} where registered<={B - k * 7 * DAY}" for k in range(3))}
 ) y where user_id in (select user_id from m) group by 1, 2
 union all select 'geolocation', geolocation, count(*) from (select user_id, geolocation, rank() over (partition by user_id order by last_used desc) r from geolocations) g
 where r=1 and user_id in (select user_id from m) group by 2
 union all select 'sessions', 'total_sessions', count(*) from sessions where session_start>={A} and session_start<{B} and user_id in (select user_id from m)
 union all select 'players', u.uuid, count(s.id) from users u left join sessions s on s.user_id=u.id and session_end>={A} and session_start<={B}
 where u.id in (select user_id from m) group by 2""")
def _(d):
    from arenalytics.plans.segment_view import segment_view

    view = segment_view(d, seg.run(d, PIPELINE).members(), A, B, threshold=THRESHOLD)
    activity = view["activity"].select(F.lit("activity").alias("part"), F.concat_ws(" ", F.col("date").cast("string"), "activity_group").alias("key"), F.col("players").alias("value"))
    places = view["geolocation"].select(F.lit("geolocation").alias("part"), F.col("geolocation").alias("key"), F.col("users").alias("value"))
    summary = view["sessions"].select(F.lit("sessions").alias("part"), F.lit("total_sessions").alias("key"), F.col("total_sessions").alias("value"))
    players = view["players"].select("uuid", "session_count").distinct().select(F.lit("players").alias("part"), F.col("uuid").alias("key"), F.col("session_count").alias("value"))
    return activity.unionByName(places).unionByName(summary).unionByName(players)
