from pyspark.sql import functions as F

from arenalytics.operators import quality as dq
from catalog import query
from catalog.domain import A, B, DAY, NOW, T0


@query("dq_1_retained_samples", f"""select id, server_id, date, players_online from samples s where date>={A} or players_online=(select max(players_online) from samples x where x.server_id=s.server_id)""")
def _(d):
    return dq.retain_samples(d.samples, A).select("id", "server_id", "date", "players_online")


@query("dq_1_retained_pings", f"select id, min_ping from ping where not (date<{A} or min_ping<0)")
def _(d):
    return dq.retain_pings(d.ping, A).select("id", "min_ping")


@query("dq_1_retained_history", f"select id from metric_history where date>={A}")
def _(d):
    return dq.retain_history(d.metric_history, A).select("id")


@query("dq_2_unique_user_info", "select * exclude (r) from (select *, row_number() over (partition by user_id, server_id order by id) r from dirty_user_info) x where r=1")
def _(d):
    return dq.unique_user_info(d.dirty_user_info)


CUT = NOW - DAY


@query("dq_3_without_inactive_users", f"""with x as (select user_id from sessions group by 1 having max(session_end)<{CUT}), u as (select uuid from users where id in (select user_id from x))
 select 'users' "table", count(*) "rows" from users where id not in (select user_id from x) union all
 select 'sessions', count(*) from sessions where user_id not in (select user_id from x) union all
 select 'kills', count(*) from kills where killer_uuid not in (select uuid from u) and victim_uuid not in (select uuid from u) union all
 select 'nicknames', count(*) from nicknames where uuid not in (select uuid from u)""")
def _(d):
    gone = dq.inactive_users(d.sessions, CUT)
    uuids = d.users.join(gone.withColumnRenamed("user_id", "id"), "id", "left_semi").select("uuid")
    return dq.table_counts(dq.remove_users({"users": d.users, "sessions": d.sessions, "kills": d.kills, "nicknames": d.nicknames}, gone, uuids))


@query("dq_4_without_server", """select 'servers' "table", count(*) "rows" from servers where id<>3 union all select 'sessions', count(*) from sessions where server_id<>3
 union all select 'samples', count(*) from samples where server_id<>3 union all select 'users', count(*) from users""")
def _(d):
    return dq.table_counts(dq.remove_servers({"servers": d.servers, "sessions": d.sessions, "samples": d.samples, "users": d.users}, [3]))


# Users of one name are taken for one person: all move to the smallest id.
PAIRS = """select u.id old_id, v.id new_id, u.uuid old_uuid, v.uuid new_uuid from users u join (select name, min(id) first from users group by name) f on f.name=u.name
 join users v on v.id=f.first where u.id<>f.first"""


def _merged(d):
    first = d.users.groupBy("name").agg(F.min_by(F.struct(F.col("id").alias("new_id"), F.col("uuid").alias("new_uuid")), "id").alias("f"))
    named = d.users.select("name", F.col("id").alias("old_id"), F.col("uuid").alias("old_uuid")).join(first, "name")
    pairs = named.select("old_id", "f.new_id", "old_uuid", "f.new_uuid").where(F.col("old_id") != F.col("new_id"))
    return dq.merge_identities({"users": d.users, "sessions": d.sessions, "user_info": d.user_info, "kills": d.kills, "nicknames": d.nicknames}, pairs)


@query("dq_5_merged_sessions", f"with p as ({PAIRS}) select s.id, coalesce(p.new_id, s.user_id) user_id from sessions s left join p on p.old_id=s.user_id")
def _(d):
    return _merged(d)["sessions"].select("id", "user_id")


@query("dq_5_merged_user_info", f"""with p as ({PAIRS}), m as (select i.*, coalesce(p.new_id,i.user_id) u, p.old_id is not null moved from user_info i left join p on p.old_id=i.user_id)
 select id, u user_id, server_id, registered from (select *, row_number() over (partition by u, server_id order by moved, id) r from m) x where r=1""")
def _(d):
    return _merged(d)["user_info"].select("id", "user_id", "server_id", "registered")


@query("dq_5_merged_kills", f"""with p as ({PAIRS}) select k.id, coalesce(a.new_uuid, killer_uuid) killer_uuid, coalesce(b.new_uuid, victim_uuid) victim_uuid from kills k
 left join p a on a.old_uuid=killer_uuid left join p b on b.old_uuid=victim_uuid""")
def _(d):
    return _merged(d)["kills"].select("id", "killer_uuid", "victim_uuid")


@query("dq_6_minimized_register_dates", f"""select u.id, case when m is not null and (r>m or r=0) then m else r end registered from (select id, case when id%3=0 then 0 else registered+{DAY} end r from users) u
 left join (select user_id, min(registered) filter (where registered<>0) m from user_info group by 1) i on i.user_id=u.id""")
def _(d):
    shifted = d.users.withColumn("registered", F.expr(f"case when id % 3 = 0 then 0 else registered + {DAY} end"))
    return dq.minimized_register_dates(shifted, d.user_info).select("id", "registered")


@query("dq_7_reset_bad_afk", "select id, case when abs(a-(session_end-session_start))<5 then 0 else a end afk_time from (select *, case when deaths=1 then session_end-session_start-3 else afk_time end a from sessions) x")
def _(d):
    spoiled = d.sessions.withColumn("afk_time", F.expr("case when deaths = 1 then session_end - session_start - 3 else afk_time end"))
    return dq.reset_bad_afk(spoiled).select("id", "afk_time")


@query("dq_8_without_dangling", "select id, killer_uuid, victim_uuid from kills where victim_uuid in (select uuid from users) and killer_uuid in (select uuid from users) and server_uuid in (select uuid from servers)")
def _(d):
    known = dq.without_dangling(dq.without_dangling(d.kills, d.users.select("uuid"), "victim_uuid"), d.users.select("uuid"), "killer_uuid")
    return dq.without_dangling(known, d.servers.select("uuid"), "server_uuid").select("id", "killer_uuid", "victim_uuid")


@query("dq_9_corrected_addresses", """with c as (select id, split_part(join_address, chr(0), 1) a, contains(join_address, chr(0)) bad from dirty_addresses),
 n as (select a, row_number() over (order by min(id)) k from c where bad and a not in (select a from c where not bad) group by a)
 select id, a join_address from c where not bad union all select cast((select max(id) from c)+k as int), a from n""")
def _(d):
    return dq.corrected_addresses(d.dirty_addresses, d.sessions)[0]


@query("dq_9_corrected_sessions", "select id, cast(case join_address_id when 2 then 6 when 3 then 4 else join_address_id end as int) join_address_id from sessions")
def _(d):
    return dq.corrected_addresses(d.dirty_addresses, d.sessions)[1].select("id", "join_address_id")


@query("dq_10_filled_addresses", """select s.id, cast(case when s.join_address_id in (1,2) then s.join_address_id when j.id is not null then j.id else 1 end as int) join_address_id from sessions s
 left join user_info u on u.user_id=s.user_id and u.server_id=s.server_id and u.opped left join (select 2 id) j on u.user_id is not null""")
def _(d):
    known = d.join_address.where("id in (1, 2)")
    info = d.user_info.withColumn("join_address", F.expr("case when opped then 'play.a.com' else 'nowhere' end"))
    return dq.fill_missing_addresses(d.sessions, known, info).select("id", "join_address_id")


@query("dq_11_merged_users", """with n as (select * from other_users where uuid not in (select uuid from users)),
 m as (select (select max(id) from users)+row_number() over (order by id) id, uuid, registered, name from n) select id, uuid, registered, name from users union all select * from m""")
def _(d):
    return dq.merge_dimension(d.users, d.other_users, "uuid")[0].select("id", "uuid", "registered", "name")


LOOKUP = """l as (select o.id old_id, coalesce(u.id, (select max(id) from users)+row_number() over (partition by u.id is null order by o.id)) new_id from other_users o left join users u on u.uuid=o.uuid),
 j as (select o.id old_id, coalesce(a.id, (select max(id) from join_address)+row_number() over (partition by a.id is null order by o.id)) new_id from other_addresses o left join join_address a on a.join_address=o.join_address)"""


@query("dq_11_merged_sessions", f"""with {LOOKUP} select id, user_id, server_id, session_start, join_address_id from sessions union all
 select (select max(id) from sessions)+row_number() over (order by s.id), l.new_id, server_id, session_start, cast(j.new_id as int) from other_sessions s join l on l.old_id=s.user_id join j on j.old_id=s.join_address_id""")
def _(d):
    users = dq.id_lookup(d.users, d.other_users, "uuid")
    addresses = dq.id_lookup(d.join_address, d.other_addresses, "join_address")
    merged = dq.merge_facts(d.sessions, d.other_sessions, {"user_id": users, "join_address_id": addresses}, new_id=True)
    return merged.select("id", "user_id", "server_id", "session_start", "join_address_id")


@query("dq_11_table_counts", """select 'users' "table", count(*) "rows" from users union all select 'sessions', count(*) from sessions union all select 'samples', count(*) from samples""")
def _(d):
    return dq.table_counts({"users": d.users, "sessions": d.sessions, "samples": d.samples})


@query("dq_12_flag_changes", """select i.user_id, i.server_id, b.user_id is not null banned from user_info i left join ban_list b on b.user_id=i.user_id and b.server_id=i.server_id
 where banned<>(b.user_id is not null)""")
def _(d):
    return dq.flag_changes(d.user_info, d.ban_list)
