from pyspark.sql import functions as F

from arenalytics.operators import worlds as wld
from catalog import query
from catalog.domain import A, B

SUMS = ", ".join(f"cast(sum({m}_time) as bigint) {m}" for m in wld.MODES)
OVER = f"session_end>={A} and session_start<={B}"
TOTALS = f"select {{k}}, {SUMS} from world_times t join worlds w on w.id=t.world_id group by {{k}}"


@query("wld_1_server_totals", f"""select t.server_id, world_name, {SUMS} from world_times t join worlds w on w.id=t.world_id join sessions s on s.id=t.session_id
 where {OVER} group by 1,2""")
def _(d):
    return wld.world_totals(d.world_times, d.worlds, d.sessions, A, B, by=["server_id"])


@query("wld_1_player_totals", TOTALS.format(k="user_id, server_id, world_name"))
def _(d):
    return wld.world_totals(d.world_times, d.worlds, by=["user_id", "server_id"])


@query("wld_2_mode_totals", f"""select t.server_id, {SUMS} from world_times t join sessions s on s.id=t.session_id where session_end<={B} and session_start>={A} group by 1""")
def _(d):
    return wld.mode_totals(d.world_times, d.sessions, A, B, by=["server_id"])


@query("wld_3_by_mode", f"""unpivot (select user_id, {', '.join(f'cast(sum({m}_time) as bigint) "{m.upper()}"' for m in wld.MODES)} from world_times group by 1)
 on {', '.join(f'"{m.upper()}"' for m in wld.MODES)} into name mode value time""".replace("unpivot (select", "select * from (unpivot (select").replace("value time", "value time)"))
def _(d):
    return wld.by_mode(wld.world_totals(d.world_times, d.worlds, by=["user_id"]), ["user_id"])


@query("wld_3_most_used_mode", """select user_id, case when greatest(s,c,a,p)<=0 then null when s>=greatest(c,a,p) then 'SURVIVAL' when c>=greatest(a,p) then 'CREATIVE'
 when a>=p then 'ADVENTURE' else 'SPECTATOR' end mode from (select user_id, sum(survival_time) s, sum(creative_time) c, sum(adventure_time) a, sum(spectator_time) p
 from world_times group by 1) x""")
def _(d):
    return wld.most_used_mode(wld.world_totals(d.world_times, d.worlds, by=["user_id"]), ["user_id"])


TOTAL = "survival_time+creative_time+adventure_time+spectator_time"


@query("wld_3_world_totals", f"select world_name, cast(sum({TOTAL}) as bigint) total from world_times t join worlds w on w.id=t.world_id group by 1")
def _(d):
    return wld.total_per_world(wld.world_totals(d.world_times, d.worlds))


@query("wld_3_most_played_world", f"""select user_id, world_name from (select user_id, world_name, row_number() over (partition by user_id order by sum({TOTAL}) desc, world_name) r
 from world_times t join worlds w on w.id=t.world_id group by 1,2 having sum({TOTAL})>0) x where r=1""")
def _(d):
    return wld.most_played_world(wld.world_totals(d.world_times, d.worlds, by=["user_id"]), ["user_id"])


@query("wld_4_world_pie", f"""select server_id, coalesce(alias, w.world_name) name, cast(sum({TOTAL}) as bigint) total, cast(sum(creative_time) as bigint) creative
 from world_times t join worlds w on w.id=t.world_id left join world_aliases a on a.world_name=w.world_name group by 1,2 having sum({TOTAL})<>0""")
def _(d):
    pie = wld.world_pie(wld.world_totals(d.world_times, d.worlds, by=["server_id"]), d.world_aliases, ["server_id"])
    return pie.select("server_id", "name", "total", F.col("drilldown")[1]["time"].alias("creative"))


@query("wld_5_favourite_server", """select user_id, server_id from (select user_id, server_id, row_number() over (partition by user_id
 order by sum(session_end-session_start) desc, server_id) r from sessions group by 1,2) x where r=1""")
def _(d):
    return wld.favourite_server(d.sessions)


@query("sta_1_per_server", """select server_id, s.name, cast(sum(value) as bigint) value from statistic_value v join statistic s on s.id=v.statistic_id group by 1,2""")
def _(d):
    return wld.statistic_values(d.statistic, d.statistic_value, ["server_id"])


@query("sta_1_per_user", """select user_id, s.name, cast(sum(value) as bigint) value from statistic_value v join statistic s on s.id=v.statistic_id group by 1,2""")
def _(d):
    return wld.statistic_values(d.statistic, d.statistic_value, ["user_id"])


@query("sta_1_totals", "select s.name, cast(sum(value) as bigint) value from statistic_value v join statistic s on s.id=v.statistic_id group by 1")
def _(d):
    return wld.statistic_values(d.statistic, d.statistic_value, [])
