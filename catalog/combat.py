from arenalytics.operators import combat as kil
from catalog import query
from catalog.domain import A, B

IN = f"date>={A} and date<={B}"
OVER = f"session_end>={A} and session_start<={B}"


@query("flt_12_without_self_kills", "select id, killer_uuid, victim_uuid from kills where killer_uuid<>victim_uuid")
def _(d):
    return kil.without_self_kills(d.kills).select("id", "killer_uuid", "victim_uuid")


@query("kil_1_kill_count", f"select server_id, count(*) kills from kills where {IN} group by server_id")
def _(d):
    return kil.kill_count(d.kills, A, B, by=["server_id"])


@query("kil_1_kill_count_of_players", f"select killer_uuid, count(*) kills from kills where {IN} and server_id in (1,2,3) group by killer_uuid")
def _(d):
    return kil.kill_count(d.kills, A, B, [1, 2, 3], by=["killer_uuid"])


@query("kil_2_mob_kills_and_deaths", f"select user_id, server_id, cast(sum(mob_kills) as bigint) mob_kills, cast(sum(deaths) as bigint) deaths from sessions where {OVER} group by 1,2")
def _(d):
    return kil.mob_kills_and_deaths(d.sessions, A, B, by=["user_id", "server_id"])


@query("kil_3_average_kdr", f"""with k as (select server_id, killer_uuid u, count(*) kills from kills where {IN} group by 1,2),
 v as (select server_id, victim_uuid u, count(*) deaths from kills where {IN} group by 1,2)
 select k.server_id, avg(kills/deaths) kdr from k join v on k.u=v.u and k.server_id=v.server_id join users x on x.uuid=k.u group by 1""", doubles="kdr")
def _(d):
    return kil.average_kdr(d.kills, d.users, A, B)


@query("kil_4_recent_kills", """select k.id, k.date, k.weapon, a.name killer_name, b.name victim_name, b.registered victim_registered
 from (select * from kills where server_id=3 order by date desc, id desc limit 100) k join users a on a.uuid=k.killer_uuid join users b on b.uuid=k.victim_uuid""")
def _(d):
    return kil.recent_kills(d.kills, d.users, 100, [3]).select("id", "date", "weapon", "killer_name", "victim_name", "victim_registered")


@query("kil_4_kills_of_killers", "select k.id, k.killer_uuid, b.name victim_name from kills k join users b on b.uuid=k.victim_uuid")
def _(d):
    return kil.kills_by(d.kills, d.users, "killer").select("id", "killer_uuid", "victim_name")


@query("kil_4_deaths_of_victims", "select k.id, k.victim_uuid, b.name killer_name from kills k join users b on b.uuid=k.killer_uuid")
def _(d):
    return kil.kills_by(d.kills, d.users, "victim").select("id", "victim_uuid", "killer_name")


@query("kil_5_top_weapons", f"select weapon, count(*) kills from kills where {IN} group by weapon order by kills desc, weapon limit 3")
def _(d):
    return kil.top_weapons(d.kills, A, B, 3)


@query("kil_5_top_weapons_per_player", f"""select * from (select killer_uuid, weapon, kills, cast(row_number() over (partition by killer_uuid order by kills desc, weapon) as int) place
 from (select killer_uuid, weapon, count(*) kills from kills where {IN} group by 1,2) x) y where place<=2""")
def _(d):
    return kil.top_weapons(d.kills, A, B, 2, by=["killer_uuid"])


@query("kil_6_versus", f"""with s as (select user_id, sum(mob_kills) m, sum(deaths) d from sessions where {OVER} group by 1),
 k as (select killer_uuid u, count(*) n from kills where date>{A} and date<={B} group by 1), v as (select victim_uuid u, count(*) n from kills where date>{A} and date<={B} group by 1),
 x as (select id user_id, coalesce(k.n,0) player_kills, coalesce(v.n,0) player_deaths, cast(coalesce(m,0) as bigint) mob_kills,
 cast(coalesce(d,0)-coalesce(v.n,0) as bigint) mob_deaths, cast(coalesce(d,0) as bigint) deaths
 from users u left join s on s.user_id=u.id left join k on k.u=u.uuid left join v on v.u=u.uuid)
 select *, player_kills/case when player_deaths=0 then 1 else player_deaths end kdr, mob_kills/case when mob_deaths=0 then 1 else mob_deaths end mob_kdr from x""", doubles="kdr mob_kdr")
def _(d):
    return kil.versus(d.sessions, d.kills, d.users, A, B)


@query("kil_7_time_to_death", "select k.id, k.date-u.registered since_registered from kills k join users u on u.uuid=k.victim_uuid")
def _(d):
    return kil.time_to_death(d.kills, d.users)


def _top(measure):
    return f"""select s.user_id, u.name, score from (select user_id, cast(sum({measure}) as bigint) score from sessions where session_start>{A} and session_end<{B}
 group by 1 order by score desc, user_id limit 10 offset 2) s join users u on u.id=s.user_id"""


@query("top_1_playtime", _top("session_end-session_start"))
def _(d):
    return kil.top_playtime(d.sessions, d.users, A, B, offset=2)


@query("top_1_active_playtime", _top("session_end-session_start-afk_time"))
def _(d):
    return kil.top_playtime(d.sessions, d.users, A, B, offset=2, only_active=True)


@query("top_1_kills", f"""select u.id user_id, u.name, count(*) score from kills k join users u on u.uuid=k.killer_uuid where k.server_id=2 and date>{A} and date<{B}
 group by 1,2 order by score desc, user_id limit 10""")
def _(d):
    return kil.top_killers(d.kills, d.users, A, B, [2])
