from pyspark.sql import functions as F

from arenalytics.plans import kpis
from catalog import query
from catalog.activity import all_index_sql
from catalog.domain import A, B, DAY, NOW, THRESHOLD

OVER = f"session_end>={A} and session_start<={B}"
IN = f"session_end<={B} and session_start>={A}"
CLIP = f"least(session_end,{B})-greatest(session_start,{A})"
D = f"date<{B} and date>{A}"
LOW = kpis.LOW_TPS


def scalar_sql(servers=(), base=None):
    """Each KPI as an own scalar subquery."""
    srv = f" and server_id in ({','.join(map(str, servers))})" if servers else ""
    proxy = srv or " and server_id in (select id from servers where is_proxy)"
    game = srv or " and server_id in (select id from servers where not is_proxy)"
    reg, uid = ("user_info", "user_id") if servers else ("users", "id")
    day = "floor({c}/86400000)"
    gaps = "select server_id, date, date-lag(date) over (partition by server_id order by date) g from samples where date>={a} and date<={b}{s}".format(a=A, b=B, s="{s}")
    index = all_index_sql(B, True, base or "select id user_id, registered from users", srv)
    kpi = {
        "AFK_TIME": f"select sum(afk_time) from sessions where {OVER}{srv}",
        "DEATHS": f"select sum(deaths) from sessions where {OVER}{srv}",
        "MOB_KILLS": f"select sum(mob_kills) from sessions where {OVER}{srv}",
        "PLAYTIME": f"select sum({CLIP}) from sessions where {OVER}{srv}",
        "SESSION_COUNT": f"select count(*) from sessions where session_start>={A} and session_start<{B}{srv}",
        "SESSION_LENGTH_AVERAGE": f"select floor(sum({CLIP})/count(*)) from sessions where {OVER}{srv}",
        "AFK_TIME_PERCENTAGE": f"select sum(afk_time)/sum(session_end-session_start) from sessions where {OVER}{srv}",
        "PLAYTIME_PER_DAY_AVERAGE": f"select floor(avg(p)) from (select {day.format(c='session_start')} d, sum(session_end-session_start) p from sessions where {IN}{srv} group by 1) x",
        "PLAYTIME_PER_PLAYER_AVERAGE": f"select floor(avg(p)) from (select user_id, sum({CLIP}) p from sessions where {OVER}{srv} group by 1) x",
        "UNIQUE_PLAYERS_COUNT": f"select count(distinct user_id) from sessions where {IN}{srv}",
        "UNIQUE_PLAYERS_AVERAGE": f"select floor(avg(p)) from (select {day.format(c='session_start')} d, count(distinct user_id) p from sessions where {IN}{srv} group by 1) x",
        "NEW_PLAYERS": f"select count(*) from {reg} where registered between {A} and {B}{srv if servers else ''}",
        "NEW_PLAYERS_AVERAGE": f"select floor(avg(p)) from (select {day.format(c='registered')} d, count(distinct {uid}) p from {reg} where registered between {A} and {B}{srv if servers else ''} group by 1) x",
        "NEW_PLAYER_RETENTION": f"select count(distinct s.user_id) from sessions s join user_info u on u.user_id=s.user_id and u.server_id=s.server_id where registered between {A} and {B} and session_start>={B - (B - A) // 2} and session_end<={B}{srv.replace('server_id', 's.server_id')}",
        "REGULAR_PLAYERS": f"select count(*) from ({index}) i where registered<={B} and activity_index>=2 and activity_index<5.1",
        "PLAYER_KILLS": f"select count(*) from kills where date between {A} and {B}{srv}",
        "CHUNKS_AVERAGE": f"select floor(avg(chunks_loaded)) from samples where {D}{srv}",
        "CPU_AVERAGE": f"select avg(cpu_usage)/100 from samples where {D} and cpu_usage>=0{srv}",
        "ENTITIES_AVERAGE": f"select floor(avg(entities)) from samples where {D}{srv}",
        "MSPT_AVERAGE": f"select avg(mspt_average) from samples where {D}{srv}",
        "MSPT_JITTER_AVERAGE": f"select avg(mspt_jitter_avg) from samples where {D}{srv}",
        "MSPT_JITTER_MAX": f"select max(mspt_jitter_max) from samples where {D}{srv}",
        "MSPT_MAX_95TH": f"select max(mspt_95th) from samples where {D}{srv}",
        "CHUNKS_PER_PLAYER": f"select floor(avg(chunks_loaded/players_online)) from samples where {D} and players_online>0{srv}",
        "CPU_IMPACT_PER_PLAYER": f"select avg((cpu_usage-(select avg(cpu_usage) from samples where {D} and cpu_usage>=0 and players_online=0{srv}))/players_online)/100 from samples where {D} and cpu_usage>=0 and players_online>0{srv}",
        "ENTITIES_PER_CHUNK": f"select avg(entities/chunks_loaded) from samples where {D} and chunks_loaded>0{srv}",
        "MSPT_IMPACT_PER_CHUNK": f"select avg(mspt_average/chunks_loaded) from samples where {D} and chunks_loaded>0{srv}",
        "MSPT_IMPACT_PER_PLAYER": f"select avg(mspt_average/players_online) from samples where {D} and players_online>0{srv}",
        "MSPT_AVERAGE_LOW_TPS": f"select avg(mspt_average) from samples where {D} and tps<{LOW}{srv}",
        "MSPT_MAX_95TH_LOW_TPS": f"select max(mspt_95th) from samples where {D} and tps<{LOW}{srv}",
        "UPTIME": f"select coalesce(sum(g),0) from ({gaps.format(s=proxy)}) x where g<=120000",
        "DOWNTIME": f"select coalesce(sum(g),0) from ({gaps.format(s=proxy)}) x where g>=180000",
        "SERVER_OCCUPIED": f"select coalesce(sum(g),0) from ({gaps.format(s=srv + ' and players_online>0')}) x where g<180000",
        "TPS_LOW_SPIKES": f"select count(*) from (select t, lag(t) over (partition by server_id order by date) p from (select server_id, date, min(tps) t from samples where date>={A} and date<={B}{game} group by 1,2) x) y where t>0 and t<{LOW} and (p is null or p>={LOW})",
    }
    if servers:
        kpi |= {
            "PLAYERS_ONLINE_PEAK": f"select max(players_online) from samples where date>={A} and date<={B}{srv}",
            "DISK_MAX": f"select max(free_disk_space) from samples where {D} and free_disk_space>=0{srv}",
            "DISK_MIN": f"select min(free_disk_space) from samples where {D} and free_disk_space>=0{srv}",
            "PLAYERS_ONLINE_AVERAGE": f"select avg(players_online) from samples where {D}{srv}",
            "RAM_AVERAGE": f"select floor(avg(ram_usage)) from samples where {D}{srv}",
            "TPS_AVERAGE": f"select avg(tps) from samples where {D} and tps>=0{srv}",
        }
    else:
        kpi["PLAYERS_ONLINE_PEAK"] = f"select max(n) from (select sum(players_online) n from samples where date>={A} and date<={B}{proxy} group by date) x"
    return " union all ".join(f"select '{n}' kpi, cast(({q}) as double) as value" for n, q in kpi.items()), list(kpi)


NETWORK_SQL, NETWORK_NAMES = scalar_sql()
SERVER_SQL, SERVER_NAMES = scalar_sql((2, 3), "select user_id, min(registered) registered from user_info where server_id in (2,3) group by user_id")


@query("kpi_network", NETWORK_SQL, doubles="value")
def _(d):
    return kpis.kpi_table(d, kpis.Scope(A, B, threshold=THRESHOLD), NETWORK_NAMES)


@query("kpi_servers", SERVER_SQL, doubles="value")
def _(d):
    return kpis.kpi_table(d, kpis.Scope(A, B, (2, 3), threshold=THRESHOLD), SERVER_NAMES)


@query("kpi_per_player", f"""with s as (select user_id, sum(afk_time) a, sum(deaths) d, sum(mob_kills) m, sum({CLIP}) p, count(*) n from sessions where {OVER} group by 1),
 y as (select user_id, floor(avg(p)) p from (select user_id, floor(session_start/86400000) d, sum(session_end-session_start) p from sessions where {IN} group by 1,2) x group by 1),
 k as (select u.id user_id, count(*) n from kills x join users u on u.uuid=x.killer_uuid where date between {A} and {B} group by 1)
 select user_id, 'AFK_TIME' kpi, cast(a as double) as value from s union all select user_id, 'DEATHS', d from s union all select user_id, 'MOB_KILLS', m from s
 union all select user_id, 'PLAYTIME', p from s union all select user_id, 'SESSION_LENGTH_AVERAGE', floor(p/n) from s
 union all select user_id, 'PLAYTIME_PER_DAY_AVERAGE', p from y union all select user_id, 'PLAYER_KILLS', n from k""", doubles="value")
def _(d):
    names = ["AFK_TIME", "DEATHS", "MOB_KILLS", "PLAYTIME", "SESSION_LENGTH_AVERAGE", "PLAYTIME_PER_DAY_AVERAGE", "PLAYER_KILLS"]
    return kpis.kpi_table(d, kpis.Scope(A, B, per_user=True), names)


LIVE = NOW - 1800000


@query("kpi_live", f"""select 'PLAYERS_ONLINE' kpi, cast((select sum(case when m>{LIVE - 120000} then p end) from (select server_id, max(date) m,
 max_by(players_online, cast(date as hugeint)*1000+players_online) p from samples group by 1) x where server_id in (1,2,3,4,5)) as double) as value""", doubles="value")
def _(d):
    return kpis.kpi_table(d, kpis.Scope(A, B, (1, 2, 3, 4, 5), now=LIVE), ["PLAYERS_ONLINE"])


@query("kpi_current_uptime", f"""with g as (select server_id, date, date-lag(date) over (partition by server_id order by date) g from samples where server_id in (2,3)),
 s as (select server_id, max(date) last, greatest(max(date) filter (where g>180000), min(date)) start from g group by 1)
 select 'UPTIME_CURRENT' kpi, cast(max(case when {LIVE}-last<=180000 then {LIVE}-start end) as double) as value from s""", doubles="value")
def _(d):
    return kpis.kpi_table(d, kpis.Scope(A, B, (2, 3), now=LIVE), ["UPTIME_CURRENT"])


TOTAL = "survival_time+creative_time+adventure_time+spectator_time"
WT = f"world_times t join worlds w on w.id=t.world_id join sessions s on s.id=t.session_id where {OVER}"


@query("kpi_most_active_world", f"""select category, "time", total from (select world_name category, cast(sum({TOTAL}) as bigint) as "time", cast(sum(sum({TOTAL})) over () as bigint) total,
 row_number() over (order by sum({TOTAL}) desc, world_name) r from {WT} group by 1) x where r=1""")
def _(d):
    return kpis.kpi_breakdown(d, "MOST_ACTIVE_WORLD", kpis.Scope(A, B))


@query("kpi_most_active_mode", f"""with m as (select unnest(['SURVIVAL','CREATIVE','ADVENTURE','SPECTATOR']) category, unnest([sum(survival_time),sum(creative_time),sum(adventure_time),sum(spectator_time)]) v from {WT})
 select category, cast(v as bigint) as "time", cast((select sum(v) from m) as bigint) total from m order by v desc, category limit 1""")
def _(d):
    return kpis.kpi_breakdown(d, "MOST_ACTIVE_GAME_MODE", kpis.Scope(A, B))


@query("kpi_world_pie_per_player", f"""select s.user_id, world_name category, cast(sum({TOTAL}) as bigint) as "time" from {WT} group by 1,2 having sum({TOTAL})<>0""")
def _(d):
    return kpis.kpi_breakdown(d, "WORLD_PIE", kpis.Scope(A, B, per_user=True))


@query("kpi_server_pie", f"""select v.name category, cast(sum({CLIP}) as bigint) as "time" from sessions s join servers v on v.id=s.server_id where {OVER} group by 1""")
def _(d):
    return kpis.kpi_breakdown(d, "SERVER_PIE", kpis.Scope(A, B))


@query("kpi_server_occupied", f"""with g as (select server_id, date-lag(date) over (partition by server_id order by date) g from samples where date>={A} and date<={B}),
 o as (select date-lag(date) over (partition by server_id order by date) g from samples where date>={A} and date<={B} and players_online>0),
 s as (select cast((select coalesce(sum(g),0) from o where g<180000) as bigint) occupied, cast((select coalesce(sum(g),0) from g where g<=120000) as bigint) uptime)
 select occupied, uptime, case when uptime=0 then -1 else occupied/uptime end as share from s""", doubles="share")
def _(d):
    return kpis.occupied_out_of_uptime(d, kpis.Scope(A, B))


@query("kpi_with_open_sessions", f"""select server_id, cast(sum(least(session_end,{B})-session_start) as bigint) playtime from sessions where session_start<={B} group by 1""")
def _(d):
    from arenalytics.functions.windows import length

    done = d.sessions.where(F.col("session_end") <= B)
    still_open = d.sessions.where(F.col("session_end") > B).drop("session_end")
    return kpis.with_open_sessions(done, still_open, B).groupBy("server_id").agg(F.sum(length()).alias("playtime"))
