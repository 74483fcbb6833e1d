from pyspark.sql import functions as F

from arenalytics.operators import geo, joins, ping as png
from arenalytics.operators import join_address as ja
from arenalytics.operators import roster
from arenalytics.session import shared_folder
from catalog import query
from catalog.domain import A, B, NOW

HOUR = 3600000
IN = f"date>={A} and date<={B}"
STATES = "select server_id, date, max_by(players_online, id) players_online from samples group by 1,2"


@query("flt_4_valid_ping", "select id, avg_ping from ping where avg_ping>0 and avg_ping<=4000")
def _(d):
    return png.valid(d.ping).select("id", "avg_ping")


@query("flt_9_matching_names", """select name from users where lower(name) like '%name-1%' union
 select u.name from users u join nicknames n on n.uuid=u.uuid where lower(nickname) like '%name-1%'""")
def _(d):
    return roster.matching_names(d.users, d.nicknames, "NAME-1")


@query("flt_9_matching_nicknames", """select name from users where lower(name) like '%ick-4%' union
 select u.name from users u join nicknames n on n.uuid=u.uuid where lower(nickname) like '%ick-4%'""")
def _(d):
    return roster.matching_names(d.users, d.nicknames, "ick-4")


def _indexed(d, text):
    folder = shared_folder(d.spark, "names")
    roster.write_name_index(d.users, d.nicknames, folder)
    return roster.indexed_names(d.spark.read.parquet(folder), text)


@query("flt_9_indexed_names", """select name from users where lower(name) like '%ame-11%' union
 select u.name from users u join nicknames n on n.uuid=u.uuid where lower(nickname) like '%ame-11%'""")
def _(d):
    return _indexed(d, "aMe-11")


@query("flt_9_indexed_short", """select name from users where lower(name) like '%-4%' union
 select u.name from users u join nicknames n on n.uuid=u.uuid where lower(nickname) like '%-4%'""")
def _(d):
    return _indexed(d, "-4")


@query("flt_11_redacted_addresses", r"""select id, case when regexp_full_match(join_address, 'play\.b\..*|.*COM') then 'unknown' else join_address end join_address from join_address""")
def _(d):
    return ja.redact(d.join_address, [r"play\.b\..*", ".*COM"])


@query("flt_11_redacted_counts", r"""with l as (select user_id, max_by(join_address_id, id) i from sessions group by 1)
 select case when regexp_full_match(join_address, 'play\.b\..*|.*COM') then 'unknown' else join_address end join_address, count(*) players
 from l join join_address j on j.id=l.i group by 1""")
def _(d):
    return ja.redact_counts(ja.latest_counts(d.sessions, d.join_address), [r"play\.b\..*", ".*COM"])


@query("join_1_with_dimensions", """select s.id, u.uuid user_uuid, v.name server_name, j.join_address from sessions s join users u on u.id=s.user_id
 join servers v on v.id=s.server_id join join_address j on j.id=s.join_address_id""")
def _(d):
    return joins.with_dimensions(d.sessions, d.users, d.servers, d.join_address).select("id", "user_uuid", "server_name", "join_address")


@query("join_2_assembled_sessions", """with w as (select session_id, count(distinct world_name) worlds, cast(sum(survival_time) as bigint) survival,
 min(world_name) first_world from world_times t join worlds w on w.id=t.world_id group by 1), k as (select session_id, count(*) n from kills group by 1)
 select s.id, u.name user_name, v.name server_name, j.join_address, w.worlds, w.survival, w.first_world, coalesce(k.n,0) player_kills
 from sessions s join users u on u.id=s.user_id join servers v on v.id=s.server_id join join_address j on j.id=s.join_address_id
 left join w on w.session_id=s.id left join k on k.session_id=s.id""")
def _(d):
    full = joins.assemble_sessions(d.sessions, d.users, d.servers, d.join_address, d.world_times, d.worlds, d.kills)
    survival = F.aggregate(F.map_values("world_times"), F.lit(0).cast("bigint"), lambda acc, m: acc + m["survival"])
    return full.select(
        "id", "user_name", "server_name", "join_address", F.size("world_times").cast("bigint").alias("worlds"),
        survival.alias("survival"), F.array_min(F.map_keys("world_times")).alias("first_world"), "player_kills",
    )


@query("join_2_session_kills", """select session_id, k.date, weapon, killer_uuid, a.name killer_name, victim_uuid, b.name victim_name from kills k
 left join users a on a.uuid=k.killer_uuid left join users b on b.uuid=k.victim_uuid""")
def _(d):
    return joins.session_kills(d.kills, d.users)


@query("join_4_latest_rows", """select a.user_id, a.geolocation, a.last_used from geolocations a left join geolocations b on a.user_id=b.user_id
 and a.last_used<b.last_used where b.last_used is null""")
def _(d):
    return joins.latest_rows(d.geolocations, ["user_id"], "last_used")


@query("join_7_online_on", f"""with p as ({STATES}), s as (select distinct server_id, session_start date from sessions)
 select s.server_id, s.date, p.players_online, s.date-p.date age from s asof left join p on p.server_id=s.server_id and p.date<=s.date""")
def _(d):
    return joins.online_on(d.samples, d.sessions.select("server_id", F.col("session_start").alias("date")))


@query("join_7b_lonely_joins", f"""with p as ({STATES}) select s.server_id, count(*) filter (where p.players_online=0) lonely_joins
 from sessions s asof left join p on p.server_id=s.server_id and p.date<=s.session_start group by s.server_id""")
def _(d):
    return joins.lonely_joins(d.sessions, d.samples)


@query("join_7b_server_online", f"""with p as ({STATES}), s as (select distinct server_id, session_end date from sessions)
 select s.server_id, s.date, coalesce(s.date-p.date<{HOUR // 2},false) as online from s asof left join p on p.server_id=s.server_id and p.date<=s.date""")
def _(d):
    return joins.server_online_at(d.samples, d.sessions.select("server_id", F.col("session_end").alias("date")), HOUR // 2)


@query("join_8_ping_per_session", """select s.id, avg(avg_ping) average_ping from sessions s join ping p on p.user_id=s.user_id and p.server_id=s.server_id
 and p.date>=s.session_start and p.date<s.session_end group by s.id""", doubles="average_ping")
def _(d):
    return png.per_session(d.sessions, d.ping)


@query("join_9_semi_and_anti", """select user_id, 'in' side, count(*) sessions from sessions where user_id in (select user_id from user_info where opped) group by 1
 union all select user_id, 'out', count(*) from sessions where user_id not in (select user_id from user_info where opped) group by 1""")
def _(d):
    ops = d.user_info.where("opped").select("user_id")
    sides = joins.in_set(d.sessions, ops).withColumn("side", F.lit("in")).unionByName(joins.not_in_set(d.sessions, ops).withColumn("side", F.lit("out")))
    return sides.groupBy("user_id", "side").agg(F.count("*").alias("sessions"))


NUM = "+".join(f"cast(split_part(ip,'.',{i + 1}) as bigint)*{256 ** (3 - i)}" for i in range(4))


@query("join_11_address_countries", f"""with n as (select distinct ip, {NUM} n from logins)
 select ip, case when contains(ip,'127.0.0.1') then 'Local Machine' when ip like '10.%' or (ip like '172.%' and n between 2886729728 and 2887778303) or ip like '192.168.%'
 then 'Local Private Network' when r.country is null then 'Not Found' else r.country end country from n left join ip_ranges r on n.n between r.first and r.last""")
def _(d):
    return geo.locate(d.logins, d.ip_ranges)


LATEST = """select user_id, geolocation from (select *, rank() over (partition by user_id order by last_used desc) r from geolocations) x where r=1"""


@query("join_11_longest_prefix", """with a as (select distinct ip, hi, lo from addresses), m as (select a.ip, n.country, n.bits from a join networks n on a.hi between n.hi1 and n.hi2 and a.lo between n.lo1 and n.lo2),
 b as (select ip, max_by(country, bits) country from m group by ip) select a.ip, coalesce(b.country, 'Not Found') country from a left join b on b.ip=a.ip""")
def _(d):
    return geo.locate_by_prefix(d.addresses, d.networks.select("cidr", "country"))


@query("join_12_country_codes", f"""select code, users from (select geolocation, count(*) users from ({LATEST}) l group by 1) c join country_codes k on lower(k.name)=lower(c.geolocation)""")
def _(d):
    return geo.with_codes(geo.counts(d.geolocations), d.country_codes)


@query("png_1_average_ping", f"select server_id, avg(avg_ping) average_ping from ping where {IN} group by server_id", doubles="average_ping")
def _(d):
    return png.average_ping(d.ping, A, B, by=["server_id"])


@query("png_1_average_ping_network", f"select avg(avg_ping) average_ping from ping where {IN}", doubles="average_ping")
def _(d):
    return png.average_ping(d.ping, A, B)


@query("png_2_by_geolocation", f"""select server_id, geolocation, min(min_ping) min_ping, max(max_ping) max_ping, cast(trunc(avg(avg_ping)) as bigint) avg_ping
 from ping p join ({LATEST}) l on l.user_id=p.user_id group by 1,2""")
def _(d):
    return png.by_geolocation(d.ping, d.geolocations, by=["server_id"])


@query("png_2_by_geolocation_network", f"""select geolocation, min(min_ping) min_ping, max(max_ping) max_ping, cast(trunc(avg(avg_ping)) as bigint) avg_ping
 from ping p join ({LATEST}) l on l.user_id=p.user_id group by 1""")
def _(d):
    return png.by_geolocation(d.ping, d.geolocations)


@query("png_3_rollup", """select server_id, date-date%60000 date, coalesce(min(min_ping) filter (where min_ping>0 and min_ping<=4000),-1) min_ping,
 coalesce(max(max_ping) filter (where max_ping>0 and max_ping<=4000),-1) max_ping,
 coalesce(avg(avg_ping) filter (where avg_ping>0 and avg_ping<=4000),-1) avg_ping from ping group by server_id, date-date%60000""", doubles="avg_ping")
def _(d):
    return png.rollup(d.ping, by=["server_id"])


@query("png_4_series", f"select user_id, server_id, date, min_ping, max_ping, avg_ping from ping where {IN} and server_id in (1,2)")
def _(d):
    return png.series(d.ping, A, B, [1, 2])


@query("png_5_per_country", f"select geolocation, p.id, p.avg_ping from ping p join ({LATEST}) l on l.user_id=p.user_id where server_id=2")
def _(d):
    return png.per_country(d.ping, d.geolocations, 2).select("geolocation", "id", "avg_ping")


@query("geo_1_counts", f"select geolocation, count(*) users from ({LATEST}) l group by 1")
def _(d):
    return geo.counts(d.geolocations)


@query("geo_1_counts_of_users", f"select geolocation, count(*) users from ({LATEST}) l where user_id in (select user_id from user_info where opped) group by 1")
def _(d):
    return geo.counts(d.geolocations, d.user_info.where("opped").select("user_id"))


@query("geo_1_counts_per_server", f"select server_id, geolocation, count(*) users from ({LATEST}) l join user_info i on i.user_id=l.user_id group by 1,2")
def _(d):
    return geo.counts_per_server(d.geolocations, d.user_info)


@query("geo_2_unique", "select distinct geolocation from geolocations")
def _(d):
    return geo.unique(d.geolocations)


@query("geo_2_users_in", "select distinct user_id from geolocations where lower(geolocation) in ('nation_1','nation_7')")
def _(d):
    return geo.users_in(d.geolocations, ["Nation_1", "NATION_7"])


@query("geo_3_last_used", "select user_id, geolocation, max(last_used) last_used from geolocations group by 1,2")
def _(d):
    return geo.last_used(d.geolocations)


@query("geo_3_most_recent", "select user_id, geolocation from (select *, row_number() over (partition by user_id order by last_used desc, geolocation desc) r from geolocations) x where r=1")
def _(d):
    return geo.most_recent(d.geolocations)


@query("geo_4_top", f"select geolocation, count(*) users from ({LATEST}) l group by 1 order by 2 desc, 1 limit 20")
def _(d):
    return geo.top(geo.counts(d.geolocations))


@query("ja_1_latest_counts", """select j.join_address, count(*) players from sessions a left join sessions b on a.id<b.id and a.user_id=b.user_id
 join join_address j on j.id=a.join_address_id where b.id is null group by 1""")
def _(d):
    return ja.latest_counts(d.sessions, d.join_address)


NEWEST = """select user_id, server_id, join_address_id from (select *, rank() over (partition by {k} order by session_start desc) r from sessions) x where r=1"""


@query("ja_1_latest_counts_per_server", f"""select server_id, join_address, count(*) players from ({NEWEST.format(k='user_id, server_id')}) n
 join join_address j on j.id=n.join_address_id group by 1,2""")
def _(d):
    return ja.latest_counts_per_server(d.sessions, d.join_address)


@query("ja_2_latest_of_users", f"select user_id, join_address from ({NEWEST.format(k='user_id')}) n join join_address j on j.id=n.join_address_id")
def _(d):
    return ja.latest_of_users(d.sessions, d.join_address)


@query("ja_2_latest_of_users_per_server", f"select user_id, server_id, join_address from ({NEWEST.format(k='user_id, server_id')}) n join join_address j on j.id=n.join_address_id")
def _(d):
    return ja.latest_of_users(d.sessions, d.join_address, ["user_id", "server_id"])


@query("ja_3_per_day", f"""select server_id, cast(floor(session_start/86400000)*86400000 as bigint) date, join_address, count(distinct user_id) players from sessions s
 left join join_address j on j.id=s.join_address_id where session_start>{A} and session_start<={B} and join_address in ('unknown','play.a.com') group by 1,2,3""")
def _(d):
    return ja.per_day(d.sessions, d.join_address, A, B, addresses=["unknown", "play.a.com"], by=["server_id"])


@query("ja_4_all_addresses", "select distinct join_address from join_address where id in (select join_address_id from sessions where server_id=2) union select 'unknown'")
def _(d):
    return ja.all_addresses(d.join_address, d.sessions, [2])


@query("ja_4_users_with_addresses", """select distinct user_id from sessions s join join_address j on j.id=s.join_address_id where join_address in ('MC.B.com','play.a.com')""")
def _(d):
    return ja.users_with_addresses(d.sessions, d.join_address, ["MC.B.com", "play.a.com"])


@query("ja_5_sanitized", """with c as (select id, lower(regexp_replace(join_address, ':[^:]*$', '')) a from join_address), b as (select id, case when a='192.0.2.7' then '' else a end a from c)
 select id, a join_address, contains(a,'.') valid from b""")
def _(d):
    return ja.sanitized_table(d.join_address, [r"192\.0\.2\.\d+"])


@query("nck_1_latest_nicknames", """select uuid, server_uuid, nickname, last_used from (select *, rank() over (partition by uuid, server_uuid order by last_used desc) r from nicknames) x where r=1""")
def _(d):
    return roster.latest_nicknames(d.nicknames)


@query("nck_1_nickname_lists", "select uuid, string_agg(distinct nickname, ',' order by nickname) nicknames from nicknames group by uuid")
def _(d):
    return roster.nickname_lists(d.nicknames)


@query("nck_1_nicknames_of_player", "select nickname, server_uuid, last_used from nicknames where uuid='u-7'")
def _(d):
    return roster.nicknames_of(d.nicknames, "u-7").select("nickname", "server_uuid", "last_used")


@query("alw_1_bounces", "select uuid, name, server_id, times, last_bounce from allowlist_bounce where server_id in (1,3)")
def _(d):
    return roster.allowlist_bounces(d.allowlist_bounce, [1, 3])


INSTALLED = """select server_id, plugin_name, version, modified from (select *, row_number() over (partition by server_id, plugin_name order by modified desc, id desc) r
 from plugin_versions) x where r=1 and version is not null"""


@query("plg_1_installed", INSTALLED)
def _(d):
    return roster.installed_plugins(d.plugin_versions)


@query("plg_2_history", "select server_id, plugin_name, version, modified from plugin_versions where server_id=1")
def _(d):
    return roster.plugin_history(d.plugin_versions, [1]).select("server_id", "plugin_name", "version", "modified")


@query("plg_3_changes", f"""select coalesce(i.server_id,s.server_id) server_id, coalesce(i.plugin_name,s.plugin_name) plugin_name, s.version, {NOW} modified,
 case when i.version is null then 'new' when s.version is null then 'removed' else 'updated' end change from ({INSTALLED}) i
 full join plugin_snapshot s on s.server_id=i.server_id and s.plugin_name=i.plugin_name where i.version is distinct from s.version""")
def _(d):
    return roster.plugin_changes(roster.installed_plugins(d.plugin_versions), d.plugin_snapshot, NOW)
