from pyspark.sql import functions as F

from arenalytics.operators import lifecycle as life
from arenalytics.session import shared_folder
from arenalytics.sources import imports, recovery, sinks, tables
from catalog import query
from catalog.domain import A, B, DAY, NOW

MINUTE = 60000


@query("src_1_samples_with_keys", "select s.id, v.uuid server_uuid, s.date, s.tps from samples s join servers v on v.id=s.server_id", doubles="tps")
def _(d):
    return tables.with_natural_keys(d.samples, servers=d.servers).select("id", "server_uuid", "date", "tps")


@query("src_1_pings_with_keys", "select p.id, u.uuid user_uuid, v.uuid server_uuid, p.date, p.avg_ping from ping p join users u on u.id=p.user_id join servers v on v.id=p.server_id", doubles="avg_ping")
def _(d):
    return tables.with_natural_keys(d.ping, d.users, d.servers).select("id", "user_uuid", "server_uuid", "date", "avg_ping")


@query("src_1_sessions_with_keys", """select s.id, u.uuid user_uuid, v.uuid server_uuid, s.session_start, s.session_end, s.mob_kills, s.deaths, s.afk_time, j.join_address
 from sessions s join users u on u.id=s.user_id join servers v on v.id=s.server_id join join_address j on j.id=s.join_address_id""")
def _(d):
    named = tables.with_natural_keys(d.sessions, d.users, d.servers, d.join_address)
    return named.select("id", "user_uuid", "server_uuid", "session_start", "session_end", "mob_kills", "deaths", "afk_time", "join_address")


@query("src_1_geolocations_with_keys", "select u.uuid user_uuid, g.geolocation, g.last_used from geolocations g join users u on u.id=g.user_id")
def _(d):
    return tables.with_natural_keys(d.geolocations, d.users).select("user_uuid", "geolocation", "last_used")


@query("src_1_nicknames_per_user", """select uuid user_uuid, cast(row_number() over (partition by uuid order by last_used desc, nickname, server_uuid)-1 as int) place, server_uuid, nickname, last_used from nicknames""")
def _(d):
    return tables.nicknames_per_user(d.nicknames).select("user_uuid", F.posexplode("nicknames").alias("place", "n")).select("user_uuid", "place", "n.*")


@query("src_1_user_info_with_keys", """select i.id, u.uuid user_uuid, v.uuid server_uuid, i.join_address, i.registered, i.opped, i.banned from user_info i join users u on u.id=i.user_id join servers v on v.id=i.server_id""")
def _(d):
    return tables.with_natural_keys(d.user_info, d.users, d.servers).select("id", "user_uuid", "server_uuid", "join_address", "registered", "opped", "banned")


@query("src_1_users_by_key", "select id, uuid, name, registered, times_kicked from users")
def _(d):
    return d.users.select("id", "uuid", "name", "registered", "times_kicked")


@query("src_1_world_names", "select server_uuid, list(world_name order by world_name) world_names from (select distinct server_uuid, world_name from worlds) w group by server_uuid")
def _(d):
    return tables.world_names(d.worlds)


@query("src_2_keyset_page", "select id, session_start from sessions where id>(select max(id)//2 from sessions) order by id limit 500")
def _(d):
    middle = d.sessions.agg(F.floor(F.max("id") / 2)).scalar()
    return tables.page(d.sessions, middle, 500).select("id", "session_start")


def _nested(d):
    """Sessions as they leave the server: natural keys, nested world times and kills."""
    worlds = (
        d.world_times.join(d.worlds.select(F.col("id").alias("world_id"), "world_name"), "world_id")
        .groupBy("session_id", "world_name")
        .agg(*[F.sum(f"{m}_time").alias(m) for m in ("survival", "creative", "adventure", "spectator")])
        .select("session_id", "world_name", F.struct(F.create_map(*[c for m in ("survival", "creative", "adventure", "spectator") for c in (F.lit(m.upper()), F.col(m))]).alias("times")).alias("w"))
        .groupBy("session_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("world_name", "w"))).alias("world_times"))
    )
    person = lambda c: F.struct(F.col(c).alias("uuid"), F.col(c).alias("name"))
    kills = d.kills.select("session_id", F.array(F.struct(person("killer_uuid").alias("killer"), person("victim_uuid").alias("victim"), "weapon", "date")).alias("kills"))
    people = d.users.select(F.col("id").alias("user_id"), F.col("uuid").alias("user_uuid"), "name")
    places = d.servers.select(F.col("id").alias("server_id"), F.col("uuid").alias("server_uuid"))
    addresses = d.join_address.select(F.col("id").alias("join_address_id"), "join_address")
    return (
        d.sessions.join(people, "user_id").join(places, "server_id").join(addresses, "join_address_id")
        .join(worlds.withColumnRenamed("session_id", "id"), "id", "left")
        .join(kills.withColumnRenamed("session_id", "id"), "id", "left")
    )


@query("src_3_recovery_round_trip", """select u.uuid user_uuid, v.uuid server_uuid, session_start, session_end, afk_time, mob_kills, deaths, j.join_address, u.name,
 cast(coalesce(w.s,0) as bigint) survival, cast(coalesce(k.n,0) as int) kills, k.weapon from sessions s join users u on u.id=s.user_id join servers v on v.id=s.server_id join join_address j on j.id=s.join_address_id
 left join (select session_id, sum(survival_time) s from world_times group by 1) w on w.session_id=s.id left join (select session_id, count(*) n, max(weapon) weapon from kills group by 1) k on k.session_id=s.id""")
def _(d):
    folder = shared_folder(d.spark, "recovery")
    recovery.write(_nested(d), folder)
    back = recovery.read(d.spark, folder)
    survival = F.aggregate(F.map_values("world_times"), F.lit(0).cast("bigint"), lambda a, w: a + w["times"]["SURVIVAL"])
    return back.select(
        "user_uuid", "server_uuid", "session_start", "session_end", "afk_time", "mob_kills", "deaths", "join_address", "name",
        survival.alias("survival"), F.size("kills").alias("kills"), F.get("kills", F.lit(0))["weapon"].alias("weapon"),
    )


@query("src_4_imported_users", """select id is not null known, uuid, registered, name from users union all select true, uuid, registered, name from other_users where uuid not in (select uuid from users)""")
def _(d):
    return imports.import_users(d.users, d.other_users.unionByName(d.other_users)).select(F.col("id").isNotNull().alias("known"), "uuid", "registered", "name")


@query("src_4_imported_sessions", """select u.id user_id, s.server_id, s.session_start, max(s.session_end) session_end from other_sessions s join other_users o on o.id=s.user_id join users u on u.uuid=o.uuid
 where not exists (select 1 from sessions x where x.user_id=u.id and x.server_id=s.server_id and x.session_start=s.session_start) group by 1,2,3""")
def _(d):
    people = d.other_users.select(F.col("id").alias("user_id"), F.col("uuid").alias("user_uuid"))
    incoming = tables.with_natural_keys(d.other_sessions.join(people, "user_id").drop("user_id"), servers=d.servers)
    return imports.import_sessions(d.sessions, incoming, d.users, d.servers).select("user_id", "server_id", "session_start", "session_end")


@query("snk_1_split_sessions", """select 'sessions' "table", count(*) "rows", cast(sum(session_end-session_start) as bigint) total from sessions union all
 select 'world_times', count(*), cast(sum(t) as bigint) from (select session_id, world_id, sum(survival_time+creative_time+adventure_time+spectator_time) t from world_times group by 1,2) x union all
 select 'kills', count(*), cast(sum(date) as bigint) from kills k join sessions s on s.id=k.session_id""")
def _(d):
    folder = shared_folder(d.spark, "stored")
    nested = _nested(d)
    sinks.store_sessions(nested, folder, 0)
    sinks.store_sessions(nested, folder, 0)  # a repeated batch must not add rows
    sinks.write_batch(sinks.split_sessions(nested)["sessions"], f"{folder}/sessions", 1)  # a batch that failed before its commit
    read = lambda n: sinks.committed(d.spark, folder, n)
    modes = F.col("survival_time") + F.col("creative_time") + F.col("adventure_time") + F.col("spectator_time")
    parts = [("sessions", F.sum(F.col("session_end") - F.col("session_start"))), ("world_times", F.sum(modes)), ("kills", F.sum("date"))]
    frames = [read(n).agg(F.lit(n).alias("table"), F.count("*").alias("rows"), s.alias("total")) for n, s in parts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query("snk_2_appended_samples", "select server_id, count(*) n, max(date) last from samples group by server_id")
def _(d):
    folder = shared_folder(d.spark, "samples")
    sinks.append(d.samples.where(F.col("date") < A), folder, ["server_id"])
    sinks.append(d.samples.where(F.col("date") >= A), folder, ["server_id"])
    return d.spark.read.parquet(folder).groupBy("server_id").agg(F.count("*").alias("n"), F.max("date").alias("last"))


@query("snk_3_upsert_latest", f"""select user_id, geolocation, max(last_used) last_used from (select * from geolocations union all
 select user_id, geolocation, last_used+case when user_id%2=0 then {DAY} else -{DAY} end from geolocations) x group by 1,2""")
def _(d):
    new = d.geolocations.withColumn("last_used", F.expr(f"last_used + case when user_id % 2 = 0 then {DAY} else -{DAY} end"))
    return sinks.upsert_latest(d.geolocations, new, ["user_id", "geolocation"], "last_used")


@query("snk_3_upsert_flags", "select user_id, server_id, opped from user_info")
def _(d):
    old = d.user_info.select("user_id", "server_id", (~F.col("opped")).alias("opped"), F.lit(1).alias("version"))
    new = d.user_info.select("user_id", "server_id", "opped", F.lit(2).alias("version"))
    return sinks.upsert_latest(old, new, ["user_id", "server_id"], "version").drop("version")


@query("snk_4_upsert_counts", f"""select uuid, server_id, cast(sum(times) as bigint) times, max(last_bounce) last_bounce, max(name) name from (select uuid, server_id, times, last_bounce, name from allowlist_bounce union all
 select uuid, server_id, 2, last_bounce+1000, name from allowlist_bounce where server_id<=2) x group by 1,2""")
def _(d):
    more = d.allowlist_bounce.where("server_id <= 2").withColumn("times", F.lit(2).cast("bigint")).withColumn("last_bounce", F.col("last_bounce") + 1000)
    return sinks.upsert_counts(d.allowlist_bounce, more, ["uuid", "server_id"], "times", "last_bounce")


@query("snk_5_upsert_registrations", f"""with k as (select uuid, name, registered from users where registered<{A}), s as (select uuid, case when id%3=0 then null else name end name, registered-id r from users)
 select s.uuid, case when k.name is not null then k.name else coalesce(s.name, s.uuid) end name, least(k.registered, s.r) registered, k.uuid is null added from s left join k on k.uuid=s.uuid""")
def _(d):
    known = d.users.where(F.col("registered") < A)
    seen = d.users.select("uuid", F.expr("case when id % 3 = 0 then null else name end").alias("name"), (F.col("registered") - F.col("id")).alias("registered"))
    return sinks.upsert_registrations(known, seen).select("uuid", "name", "registered", F.col("id").isNull().alias("added"))


@query("snk_6_json_export", "select uuid, name, registered from users")
def _(d):
    folder = shared_folder(d.spark, "export")
    sinks.export_json(d.users.select("uuid", "name", "registered"), folder)
    return d.spark.read.schema("uuid string, name string, registered bigint").json(folder)


# The raw event log as sessions, AFK times and world times (batch form)

CHANGES = "select * from session_events where kind in ('join','leave')"
FINISHED = f"""select user_id, server_id, date session_start, nd session_end, nk<>'leave' interrupted from (select *, lead(date) over w nd, lead(kind) over w nk from ({CHANGES}) c
 window w as (partition by user_id order by date, event_id)) x where kind='join' and nd is not null"""


@query("str_1_sessions_batch", FINISHED)
def _(d):
    return life.finished_sessions(d.session_events)


# A user's own bound: events belong to the session whose start is the last join before them, unless a leave came between.
STATE = """select *, last_value(case when kind='join' then date when kind='leave' then -1 end ignore nulls) over (partition by user_id order by date, event_id rows unbounded preceding) open_start from session_events where kind in ({k})"""
AFK_SQL = f"""with s as ({STATE.format(k="'join','leave','action','afk'")}), p as (select *, lag(date) over w pd, lag(kind) over w pk, lag(open_start) over w po from s
 window w as (partition by user_id order by date, event_id))
 select user_id, po session_start, cast(sum(case when pk='afk' then date-pd when date-pd>=180000 then date-pd else 0 end) as bigint) afk_time from p where kind in ('action','leave') and po>=0 group by 1,2"""


@query("str_2_afk_batch", AFK_SQL)
def _(d):
    return life.afk_times(d.session_events)


WORLD_SQL = f"""with s as ({STATE.format(k="'join','leave','world'")}), n as (select *, lead(date) over (partition by user_id order by date, event_id) nd from s)
 select user_id, open_start session_start, world, mode, cast(sum(nd-date) as bigint) as "time" from n where open_start>=0 and nd is not null group by 1,2,3,4"""


@query("str_3_world_times_batch", WORLD_SQL)
def _(d):
    return life.world_times(d.session_events)


@query("str_4_session_counters", """select s.id, count(*) player_kills from sessions s join users u on u.id=s.user_id join kills k on k.killer_uuid=u.uuid and k.server_id=s.server_id
 and k.date>=s.session_start and k.date<s.session_end group by 1""")
def _(d):
    return life.session_counters(d.sessions, d.kills, d.users)


@query("str_4_first_sessions", "select s.id, abs(s.session_start-u.registered)<15000 first_session from sessions s join users u on u.id=s.user_id")
def _(d):
    people = d.users.select(F.col("id").alias("user_id"), "registered")
    return life.with_first_flag(d.sessions, people).select("id", "first_session")


ROLLUP_SQL = """with p as (select *, date-date%60000 m from pulses), t as (select *, row_number() over (partition by server_id, m order by mspt)-1 i, count(*) over (partition by server_id, m) n,
 abs(mspt-lag(mspt) over (partition by server_id, m order by date, id)) j from p where mspt>0),
 q as (select server_id, m, max(mspt) filter (where i=cast(floor(n*0.95) as bigint)-1 and i>0) p95, avg(j) ja, cast(max(j) as double) jm from t group by 1,2)
 select p.server_id, p.m date, avg(tps) filter (where tps>=0) tps, max(players) players_online, avg(cpu) cpu_usage, cast(floor(avg(ram)) as bigint) ram_usage,
 max_by(entities, cast(date as hugeint)*100000000+id) entities, max_by(chunks, cast(date as hugeint)*100000000+id) chunks_loaded, max_by(disk, cast(date as hugeint)*100000000+id) free_disk_space,
 avg(mspt) filter (where mspt>0) mspt_average, any_value(q.p95) mspt_95th, any_value(q.ja) mspt_jitter_avg, any_value(q.jm) mspt_jitter_max
 from p left join q on q.server_id=p.server_id and q.m=p.m group by 1,2"""


@query("str_5_minute_rollup_batch", ROLLUP_SQL, doubles="tps cpu_usage mspt_average mspt_jitter_avg mspt_jitter_max")
def _(d):
    return life.minute_rollup(d.pulses)


@query("str_6_tick_tps", """with p as (select distinct server_id, date*1000000 ns from pulses), l as (select server_id, ns, greatest(ns-lag(ns) over (partition by server_id order by ns), 1000000000) g from p),
 z as (select *, cast(greatest(ceil(g/20000000000)-1,0) as bigint) k from l where g is not null and ns<>(select min(ns) from p x where x.server_id=l.server_id))
 select server_id, ns, 20000000000/(g-k*20000000000) tps, cast(1 as bigint) weight from z union all select server_id, ns, 0.0, k from z where k>0""", doubles="tps")
def _(d):
    return life.tick_tps(d.pulses.select("server_id", (F.col("date") * 1_000_000).alias("ns")))


@query("str_7_ping_rollup_batch", """select user_id, server_id, max(date) date, coalesce(min(value) filter (where value>0 and value<=4000),-1) min_ping,
 coalesce(max(value) filter (where value>0 and value<=4000),-1) max_ping, cast(trunc(quantile_cont(value,0.5)) as double) avg_ping from raw_pings group by user_id, server_id, floor(date/3600000)""", doubles="avg_ping")
def _(d):
    return life.ping_rollup(d.raw_pings, 60 * MINUTE)


@query("str_9_closed_at_stop", f"""select user_id, server_id, date session_start, {NOW} session_end from (select *, lead(date) over (partition by user_id order by date, event_id) nd from ({CHANGES}) c) x
 where kind='join' and nd is null""")
def _(d):
    return life.close_open_sessions(d.session_events, NOW)
