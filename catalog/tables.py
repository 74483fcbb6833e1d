from pyspark.sql import functions as F

from arenalytics.plans import tables as tbl
from catalog import query
from catalog.activity import all_index_sql, index_sql
from catalog.domain import A, B, DAY, NOW, THRESHOLD
from catalog.samples import start_sql, window_gap_sql, window_spike_sql

LATEST = "(select user_id, geolocation from (select *, rank() over (partition by user_id order by last_used desc) r from geolocations) x where r=1)"
NICKS = "(select uuid, string_agg(distinct nickname, ',' order by nickname) nicknames from nicknames group by uuid)"


def table_sql(users, banned, stats, index, ping, order="order by last_seen desc nulls last, u.id limit 100"):
    return f"""with b as (select u.*, {banned} banned, last_seen, coalesce(n,0) session_count, cast(coalesce(act,0) as bigint) active_playtime from users u {users}
 left join ({stats}) s on s.user_id=u.id {order})
 select b.id user_id, b.uuid, b.name, b.registered, b.banned, g.geolocation, last_seen, session_count, active_playtime, i.activity_index, min_ping, max_ping, avg_ping, nicknames
 from b left join {LATEST} g on g.user_id=b.id left join ({index}) i on i.user_id=b.id left join ({ping}) p on p.user_id=b.id left join {NICKS} k on k.uuid=b.uuid"""


def stats_sql(measure="session_end-session_start-afk_time", where="true"):
    return f"select user_id, max(session_end) last_seen, count(*) n, sum({measure}) act from sessions where {where} group by 1"


def ping_sql(where="true"):
    return f"select user_id, avg(avg_ping) avg_ping, max(max_ping) max_ping, min(min_ping) min_ping from ping where {where} group by 1"


BANNED = "u.id in (select user_id from user_info where banned)"


@query("tbl_1_network_players", table_sql("", BANNED, stats_sql(), all_index_sql(B, True), ping_sql()), doubles="activity_index avg_ping")
def _(d):
    return tbl.network_players(d.users, d.user_info, d.sessions, d.geolocations, d.ping, d.nicknames, B, 100, THRESHOLD)


SERVER_INDEX = f"""select u.id user_id, 5-5*((coalesce(i.s3,0)+3-coalesce(i.n,0))/3) activity_index from users u
 left join ({index_sql(B, True, 'and server_id=2')}) i on i.user_id=u.id"""


@query("tbl_2_server_players", table_sql("join user_info ui on ui.user_id=u.id and ui.server_id=2", "ui.banned", stats_sql(where="server_id=2"), SERVER_INDEX, ping_sql("server_id=2")), doubles="activity_index avg_ping")
def _(d):
    return tbl.server_players(d.users, d.user_info, d.sessions, d.geolocations, d.ping, d.nicknames, 2, B, 100, THRESHOLD)


@query("tbl_3_segment_players", table_sql(
    "", "u.id in (select user_id from user_info where banned and server_id in (1,2))",
    stats_sql(f"least(session_end,{B})-greatest(session_start,{A})-afk_time", f"session_end>={A} and session_start<={B} and server_id in (1,2)"),
    all_index_sql(B, True), ping_sql(f"date between {A} and {B} and server_id in (1,2)"),
    "where u.id in (select user_id from geolocations where geolocation in ('NATION_1','NATION_2'))"), doubles="activity_index avg_ping")
def _(d):
    members = d.geolocations.where(F.col("geolocation").isin("NATION_1", "NATION_2")).select("user_id").distinct()
    return tbl.segment_players(d.users, d.user_info, d.sessions, d.geolocations, d.ping, d.nicknames, members, A, B, [1, 2], THRESHOLD)


@query("tbl_4_per_server_profiles", """with s as (select user_id, server_id, max(session_end) last_seen, count(*) session_count, cast(sum(session_end-session_start) as bigint) playtime,
 cast(sum(mob_kills) as bigint) mob_kills, cast(sum(deaths) as bigint) deaths from sessions group by 1,2),
 m as (select user_id, server_id, cast(sum(survival_time) as bigint) survival, cast(sum(creative_time) as bigint) creative, cast(sum(adventure_time) as bigint) adventure,
 cast(sum(spectator_time) as bigint) spectator from world_times group by 1,2),
 k as (select u.id user_id, server_id, count(*) n from kills x join users u on u.uuid=x.killer_uuid group by 1,2),
 a as (select user_id, server_id, min(join_address) join_address from (select s.*, rank() over (partition by user_id, server_id order by session_start desc) r from sessions s) x
 join join_address j on j.id=x.join_address_id where r=1 group by 1,2)
 select i.user_id, i.server_id, i.registered, i.opped, i.banned, last_seen, session_count, playtime, mob_kills, deaths, survival, creative, adventure, spectator, a.join_address,
 coalesce(k.n,0) player_kills from user_info i left join s on s.user_id=i.user_id and s.server_id=i.server_id left join m on m.user_id=i.user_id and m.server_id=i.server_id
 left join k on k.user_id=i.user_id and k.server_id=i.server_id left join a on a.user_id=i.user_id and a.server_id=i.server_id""")
def _(d):
    return tbl.per_server_profiles(d.users, d.user_info, d.sessions, d.kills, d.world_times, d.worlds, d.join_address)


@query("tbl_5_user_profiles", f"""with s as (select user_id, max(session_end) last_seen, count(*) session_count, cast(sum(session_end-session_start) as bigint) playtime,
 cast(sum(afk_time) as bigint) afk_time, cast(sum(mob_kills) as bigint) mob_kills, cast(sum(deaths) as bigint) deaths from sessions group by 1),
 f as (select user_id, bool_or(opped) operator, bool_or(banned) banned, count(*) servers from user_info group by 1),
 v as (select user_id, server_id from (select user_id, server_id, row_number() over (partition by user_id order by sum(session_end-session_start) desc, server_id) r from sessions group by 1,2) x where r=1),
 g as (select user_id, geolocation from (select *, row_number() over (partition by user_id order by last_used desc, geolocation desc) r from geolocations) x where r=1),
 k as (select killer_uuid u, count(*) n from kills group by 1), x as (select victim_uuid u, count(*) n from kills group by 1)
 select u.id user_id, u.uuid, u.name, u.registered, u.times_kicked, operator, banned, servers, last_seen, session_count, playtime, afk_time, mob_kills, deaths, v.server_id favourite_server,
 geolocation, avg_ping, max_ping, min_ping, coalesce(k.n,0) player_kills, coalesce(x.n,0) player_deaths, nicknames, activity_index
 from users u left join s on s.user_id=u.id left join f on f.user_id=u.id left join v on v.user_id=u.id left join g on g.user_id=u.id left join ({ping_sql()}) p on p.user_id=u.id
 left join k on k.u=u.uuid left join x on x.u=u.uuid left join {NICKS} n on n.uuid=u.uuid left join ({all_index_sql(B, True)}) i on i.user_id=u.id""", doubles="activity_index avg_ping")
def _(d):
    return tbl.user_profiles(d.users, d.user_info, d.sessions, d.kills, d.geolocations, d.ping, d.nicknames, B, THRESHOLD)


END = NOW - 1800000
GAP = 5400000


@query("tbl_6_server_list", f"""with w as ({window_gap_sql('7d', 7 * DAY).replace(str(NOW), str(END)).replace(str(NOW - 7 * DAY), str(END - 7 * DAY))}),
 x as ({window_spike_sql('7d', 7 * DAY).replace(str(NOW), str(END)).replace(str(NOW - 7 * DAY), str(END - 7 * DAY))}), st as ({start_sql(GAP)})
 select v.id server_id, v.uuid, v.name, (select count(distinct user_id) from user_info i where i.server_id=v.id and registered<={END}) players,
 (select count(*) from user_info i where i.server_id=v.id and registered between {END - 7 * DAY} and {END}) new_players,
 (select count(distinct user_id) from sessions i where i.server_id=v.id and session_start>={END - 7 * DAY} and session_end<={END}) unique_players,
 (select max_by(date, cast(players_online as hugeint)*10000000000000+date) from samples i where i.server_id=v.id and date>={END - 2 * DAY}) last_peak_date,
 (select max(players_online) from samples i where i.server_id=v.id and date>={END - 2 * DAY}) last_peak_players,
 (select max_by(date, cast(players_online as hugeint)*10000000000000+date) from samples i where i.server_id=v.id) best_peak_date,
 (select max(players_online) from samples i where i.server_id=v.id) best_peak_players,
 (select avg(tps) from samples i where i.server_id=v.id and tps>=0 and date between {END - 7 * DAY} and {END}) avg_tps,
 (select case when max(date)>={END - GAP} then max_by(players_online, cast(date as hugeint)*1000+players_online) end from samples i where i.server_id=v.id) as online,
 coalesce(low_tps_spikes_7d,0) low_tps_spikes, coalesce(server_downtime_7d,0) downtime,
 case when {END}-(select max(date) from samples i where i.server_id=v.id)<={GAP} then {END}-st.start end current_uptime
 from servers v left join w on w.server_id=v.id left join x on x.server_id=v.id left join st on st.server_id=v.id where not v.is_proxy""", doubles="avg_tps")
def _(d):
    return tbl.server_list(d.servers, d.user_info, d.sessions, d.samples, END, 12.0, GAP)
