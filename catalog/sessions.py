from pyspark.sql import functions as F

from arenalytics.functions import windows as W
from arenalytics.operators import sessions as ses
from catalog import query
from catalog.domain import A, B, DAY, NOW

OVER = f"session_end>={A} and session_start<={B}"
STARTS = f"session_start>={A} and session_start<{B}"
INSIDE = f"session_end<={B} and session_start>={A}"
CLIP = f"least(session_end,{B})-greatest(session_start,{A})"
OFF = 2 * 3600000  # a fixed zone offset of two hours
DAYSQL = f"cast(floor((session_start+{OFF})/86400000)*86400000 as bigint)"


@query("flt_1_window_forms", f"""select count(*) filter (where {OVER}) overlapping, count(*) filter (where {STARTS}) starting,
 count(*) filter (where {INSIDE}) contained, count(*) filter (where session_start>{A} and session_start<={B}) after_until,
 count(*) filter (where session_start>{A} and session_start<{B}) strictly from sessions""")
def _(d):
    return d.sessions.agg(
        F.count_if(W.overlap(A, B)).alias("overlapping"),
        F.count_if(W.start_in(A, B)).alias("starting"),
        F.count_if(W.contained(A, B)).alias("contained"),
        F.count_if(W.after_until("session_start", A, B)).alias("after_until"),
        F.count_if(W.strictly_inside("session_start", A, B)).alias("strictly"),
    )


@query("flt_6_scope_game_servers", """select s.server_id, count(*) sessions from sessions s join servers v on v.id=s.server_id
 where not v.is_proxy group by s.server_id""")
def _(d):
    game = d.servers.where(~F.col("is_proxy")).select(F.col("id").alias("server_id"))
    return W.scope(d.sessions, game).groupBy("server_id").agg(F.count(F.lit(1)).alias("sessions"))


@query("flt_7_played_between", f"""select distinct user_id from sessions where session_start between {A} and {A + 6 * 3600000}
 or session_end between {A} and {A + 6 * 3600000}""")
def _(d):
    return ses.played_between(d.sessions, A, A + 6 * 3600000)


@query("flt_10_online_at", f"select distinct user_id from sessions where session_start<{B} and session_end>{B}")
def _(d):
    return ses.online_at(d.sessions, B)


@query("ses_1_session_count", f"select server_id, count(*) sessions from sessions where {STARTS} group by server_id")
def _(d):
    return ses.session_count(d.sessions, A, B, by=["server_id"])


@query("ses_1_session_count_of_player", f"select user_id, count(*) sessions from sessions where {STARTS} and server_id in (2,3) group by user_id")
def _(d):
    return ses.session_count(d.sessions, A, B, servers=[2, 3], by=["user_id"])


@query("ses_2_sessions_per_day", f"select {DAYSQL} date, count(*) sessions from sessions where {STARTS} group by 1")
def _(d):
    return ses.session_count_per_day(d.sessions, A, B, OFF)


@query("ses_3_playtime", f"select cast(sum({CLIP}) as bigint) playtime, count(*) sessions from sessions where {OVER}")
def _(d):
    return ses.playtime(d.sessions, A, B)


@query("ses_4_playtime_and_count_of_player", f"select user_id, cast(sum({CLIP}) as bigint) playtime, count(*) sessions from sessions where {OVER} group by user_id")
def _(d):
    return ses.playtime(d.sessions, A, B, by=["user_id"])


@query("ses_5_playtime_per_server", f"select server_id, cast(sum({CLIP}) as bigint) playtime, count(*) sessions from sessions where {OVER} group by grouping sets ((server_id),())")
def _(d):
    return ses.playtime_with_network_total(d.sessions, A, B)


@query("ses_6_playtime_per_day", f"select server_id, {DAYSQL} date, cast(sum(session_end-session_start) as bigint) playtime from sessions where {INSIDE} group by 1,2")
def _(d):
    return ses.playtime_per_day(d.sessions, A, B, OFF, by=["server_id"])


@query("ses_7_average_playtime_per_day", f"""select avg(p) average_playtime from (select {DAYSQL} dt, sum(session_end-session_start) p
 from sessions where {INSIDE} group by 1) x""", doubles="average_playtime")
def _(d):
    return ses.average_playtime_per_day(d.sessions, A, B, OFF)


@query("ses_8_average_playtime_per_player", f"""select server_id, avg(p) average_playtime from (select server_id, user_id, sum({CLIP}) p
 from sessions where {OVER} group by 1,2) x group by server_id""", doubles="average_playtime")
def _(d):
    return ses.average_playtime_per_player(d.sessions, A, B, by=["server_id"])


@query("ses_9_average_afk_per_player", f"""select avg(p) average_afk from (select user_id, sum(afk_time) p
 from sessions where {OVER} group by 1) x""", doubles="average_afk")
def _(d):
    return ses.average_afk_per_player(d.sessions, A, B)


@query("ses_10_afk_time", f"select user_id, cast(sum(afk_time) as bigint) afk_time from sessions where {OVER} group by user_id")
def _(d):
    return ses.afk_time(d.sessions, A, B, by=["user_id"]).select("user_id", "afk_time")


@query("ses_11_afk_share", f"select server_id, sum(afk_time)/sum(session_end-session_start) afk_share from sessions where {OVER} group by server_id", doubles="afk_share")
def _(d):
    return ses.afk_time(d.sessions, A, B, by=["server_id"]).select("server_id", "afk_share")


@query("ses_12_active_playtime", f"select server_id, cast(sum({CLIP}-afk_time) as bigint) active_playtime from sessions where {OVER} group by server_id")
def _(d):
    return ses.active_playtime(d.sessions, A, B, by=["server_id"])


@query("ses_13_last_seen", "select user_id, server_id, max(session_end) last_seen from sessions group by 1,2")
def _(d):
    return ses.last_seen(d.sessions, by=["user_id", "server_id"])


@query("ses_14_earliest_start", "select min(session_start) earliest_start from sessions where server_id in (2,4)")
def _(d):
    return ses.earliest_start(d.sessions, [2, 4])


@query("ses_15_users_played_between", f"select distinct user_id from sessions where session_end>={A} and session_start<={A + 6 * 3600000} and server_id in (1,2)")
def _(d):
    return ses.users_played_between(d.sessions, A, A + 6 * 3600000, [1, 2])


@query("ses_16_users_last_seen_between", f"""select user_id from sessions group by user_id
 having max(session_end) between {NOW - DAY} and {NOW - DAY // 4}""")
def _(d):
    return ses.users_last_seen_between(d.sessions, NOW - DAY, NOW - DAY // 4)


@query("ses_17_summary_of_players", f"""with m as (select distinct user_id from geolocations where geolocation in ('NATION_1','NATION_2')),
 x as (select coalesce(sum({CLIP}),0) p, coalesce(sum({CLIP}-afk_time),0) a, count(*) s, (select count(*) from m) n from sessions
 where {STARTS} and user_id in (select user_id from m))
 select cast(p as bigint) total_playtime, cast(p//n as bigint) average_playtime, cast(p-a as bigint) total_afk_playtime,
 cast((p-a)//n as bigint) average_afk_playtime, cast(a as bigint) total_active_playtime, cast(a//n as bigint) average_active_playtime,
 s total_sessions, cast(s//n as bigint) average_sessions, cast(p//s as bigint) average_session_length from x""")
def _(d):
    chosen = d.geolocations.where(F.col("geolocation").isin("NATION_1", "NATION_2")).select("user_id").distinct()
    return ses.summary_of_players(d.sessions, chosen, A, B)


@query("ses_18_latest_sessions", """select id, server_id, session_start from sessions s where session_start >= (
 select session_start from (select session_start, row_number() over (order by session_start desc) n from sessions i where i.server_id=s.server_id) q where n=20)""")
def _(d):
    return ses.latest_sessions(d.sessions, 20).select("id", "server_id", "session_start")


@query("ses_18_latest_thousands", """select id, server_id, session_start from (select *, rank() over (partition by server_id order by session_start desc) r from sessions) x where r<=1500""")
def _(d):
    return ses.latest_sessions(d.sessions, 1500).select("id", "server_id", "session_start")


@query("ses_19_sessions_between", f"""select id, user_id, session_start, session_end from sessions where session_start between {A} and {B}
 and server_id in (1,2,3)""")
def _(d):
    return ses.sessions_between(d.sessions, A, B, [1, 2, 3]).select("id", "user_id", "session_start", "session_end")


@query("ses_20_light_scan", f"""select s.id, u.uuid user_uuid, u.name user_name, u.registered, v.uuid server_uuid, v.name server_name,
 session_start, session_end, mob_kills, deaths, afk_time from sessions s join users u on u.id=s.user_id join servers v on v.id=s.server_id
 where session_start between {A} and {B}""")
def _(d):
    return ses.light_scan(d.sessions, d.users, d.servers, A, B)


@query("ses_21_length_stats", """select server_id, max(session_end-session_start) longest, cast(floor(avg(session_end-session_start)) as bigint) average,
 quantile_cont(session_end-session_start, 0.5) median from sessions group by server_id""", doubles="median")
def _(d):
    return ses.length_stats(d.sessions, ["server_id"])


def _block_sql():
    cols = []
    for tag, span in (("30d", 30 * DAY), ("7d", 7 * DAY)):
        f = f"filter (where session_end >= {NOW - span} and session_start <= {NOW})"
        cols.append(
            f"cast(coalesce(sum(session_end-session_start) {f},0) as bigint) playtime_{tag}, "
            f"cast(coalesce(sum(session_end-session_start-afk_time) {f},0) as bigint) active_playtime_{tag}, "
            f"cast(coalesce(sum(afk_time) {f},0) as bigint) afk_time_{tag}, "
            f"cast(floor(coalesce(avg(session_end-session_start) {f},0)) as bigint) average_session_length_{tag}, "
            f"coalesce(quantile_cont(session_end-session_start,0.5) {f},-1) median_session_length_{tag}, "
            f"count(*) {f} session_count_{tag}, cast(coalesce(sum(mob_kills) {f},0) as bigint) mob_kill_count_{tag}, "
            f"cast(coalesce(sum(deaths) {f},0) as bigint) death_count_{tag}"
        )
    return f"select user_id, {', '.join(cols)} from sessions where session_end >= {NOW - 30 * DAY} and session_start <= {NOW} group by user_id"


@query("ses_23_activity_block", _block_sql(), doubles="median_session_length_30d median_session_length_7d")
def _(d):
    return ses.activity_block(d.sessions, NOW, {"30d": 30 * DAY, "7d": 7 * DAY})


@query("ses_24_session_length_average", f"select server_id, cast(sum({CLIP})//count(*) as bigint) average_length from sessions where {OVER} group by server_id")
def _(d):
    return ses.session_length_average(d.sessions, A, B, by=["server_id"])


@query("ses_25_unique_users", "select join_address_id, count(distinct user_id) users from sessions group by join_address_id")
def _(d):
    return ses.unique_users(d.sessions, ["join_address_id"])


@query("ses_26_latest_and_previous", """select user_id, max(id) filter (where n=1) latest_id, max(session_start) filter (where n=1) latest_start,
 max(id) filter (where n=2) previous_id, max(session_start) filter (where n=2) previous_start from (
 select *, row_number() over (partition by user_id order by session_start desc, id desc) n from sessions) x where n<=2 group by user_id""")
def _(d):
    return ses.latest_and_previous(d.sessions)


@query("ses_27_per_server_breakdown", """select user_id, server_id, count(*) session_count, cast(sum(session_end-session_start) as bigint) playtime,
 cast(sum(afk_time) as bigint) afk_time, max(session_end-session_start) longest_session_length, cast(sum(mob_kills) as bigint) mob_kills,
 cast(sum(deaths) as bigint) deaths, max(session_end) last_seen, quantile_cont(session_end-session_start,0.5) session_median
 from sessions group by 1,2""", doubles="session_median")
def _(d):
    return ses.per_server_breakdown(d.sessions)
