"""Player and server tables derived from the given test tables.

The texts run unchanged in Spark SQL and in DuckDB, apart from ``{MS}`` (epoch milliseconds of ``ts``).
Every view keeps all rows of the event log (or of one event type) so work grows with the input.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession

# First instant of the event log, 2024-01-01T00:00:00Z, and useful instants after it.
T0 = 1704067200000
DAY = 86400000
A = T0 + 7 * DAY
B = T0 + 21 * DAY
NOW = T0 + 30 * DAY
THRESHOLD = 30 * 60000
WEEK = 7 * DAY

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

MS_SPARK = "unix_millis(cast(ts as timestamp))"
MS_DUCK = "epoch_us(ts)//1000"

# Later users start later: the log of user u is compressed into the last (30 - u%25) days.
_START = f"{T0}+(user_id%25)*{DAY}+cast(floor((ms-{T0})*(30-user_id%25)/30) as bigint)"
_LENGTH = "cast(floor(60000*(1+(event_id*37)%90)/((1+user_id%20)*(1+user_id%20))) as bigint)"

VIEWS = {
    "servers": "select cast(r_regionkey+1 as int) id, concat('srv-',r_name) uuid, r_name name, true is_installed, "
    "r_regionkey=0 is_proxy from region",
    "ev": "select event_id, user_id, event_type, {MS} ms, cast(floor(value*100) as bigint) v100, "
    "cast(1+event_id%5 as int) server_id from events",
    "sessions": "select event_id id, user_id, server_id, s session_start, s+len session_end, cast(v100%7 as int) mob_kills, "
    "cast(event_id%3 as int) deaths, case when event_type='view' then cast(floor(len/10) as bigint) else 0 end afk_time, "
    "cast(1+event_id%4 as int) join_address_id from "
    f"(select *, {_START} s, {_LENGTH} len from ev) x",
    "users": "select user_id id, concat('u-',cast(user_id as string)) uuid, min(session_start) registered, "
    "concat('name-',cast(user_id%120 as string)) name, cast(user_id%4 as int) times_kicked from sessions group by user_id",
    "user_info": "select user_id*10+server_id id, user_id, server_id, concat('addr-',cast(user_id%3 as string)) join_address, "
    "min(session_start) registered, user_id%17=0 opped, (user_id+server_id)%23=0 banned from sessions group by user_id, server_id",
    "samples": "select event_id id, server_id, ms - ms%60000 date, case when event_id%50=0 then -1.0 else "
    "20.0-cast(v100%1500 as double)/100 end tps, cast(event_id%12 as int) players_online, "
    "case when event_id%31=0 then -1.0 else cast(v100%10000 as double)/100 end cpu_usage, 1000+v100%4000 ram_usage, "
    "cast(v100%900 as int) entities, cast(event_id%300 as int) chunks_loaded, "
    "case when event_id%41=0 then -1 else 50000+v100%1000 end free_disk_space, "
    "case when event_id%9=0 then null else cast(v100%6000 as double)/100 end mspt_average, "
    "case when event_id%9=0 then null else cast(v100%6000+event_id%500 as double)/100 end mspt_95th, "
    "case when event_id%7=0 then null else cast(v100%700 as double)/100 end mspt_jitter_avg, "
    "case when event_id%7=0 then null else cast(v100%700+event_id%90 as double)/100 end mspt_jitter_max from ev",
    "ping": "select event_id id, user_id, server_id, ms date, cast(v100%4200-20 as int) min_ping, "
    "cast(v100%4200-20+event_id%90 as int) max_ping, cast(v100%4200-20 as double)+cast(event_id%90 as double)/2 avg_ping "
    "from ev where event_type='click'",
    "kills": "select event_id id, concat('u-',cast(user_id as string)) killer_uuid, "
    "concat('u-',cast(user_id-user_id%10+event_id%10 as string)) victim_uuid, s.uuid server_uuid, server_id, "
    "concat('weapon-',cast(v100%6 as string)) weapon, ms date, event_id session_id from ev join servers s on s.id=ev.server_id "
    "where event_type='error'",
    "geolocations": "select e.user_id, n.n_name geolocation, max(e.ms) last_used from ev e join nation n on "
    "n.n_nationkey=e.event_id%25 where e.event_type='signup' group by e.user_id, n.n_name",
    "nicknames": "select concat('u-',cast(user_id as string)) uuid, concat('nick-',cast(user_id%50 as string),'-',"
    "cast(event_id%3 as string)) nickname, s.uuid server_uuid, max(ms) last_used from ev join servers s on s.id=ev.server_id "
    "where event_type='purchase' group by user_id, user_id%50, event_id%3, s.uuid",
    "join_address": "select cast(r_regionkey+1 as int) id, case r_regionkey when 0 then 'unknown' when 1 then 'play.a.com' "
    "when 2 then 'play.b.com:25565' when 3 then 'MC.B.com' else '192.0.2.7' end join_address from region",
    "worlds": "select cast(r_regionkey+1 as int) id, concat('world_',lower(r_name)) world_name, concat('srv-',r_name) server_uuid from region",
    "world_times": "select user_id, w world_id, server_id, id session_id, part-2*cast(floor(part/4) as bigint)-cast(floor(part/8) as bigint) survival_time, "
    "cast(floor(part/4) as bigint) creative_time, cast(floor(part/8) as bigint) adventure_time, cast(floor(part/4) as bigint) spectator_time from ("
    "select *, cast(1+id%5 as int) w, cast(floor((session_end-session_start)/2) as bigint) part from sessions union all "
    "select *, cast(1+(id+2)%5 as int) w, session_end-session_start-cast(floor((session_end-session_start)/2) as bigint) part from sessions) x",
    "allowlist_bounce": "select concat('u-',cast(user_id as string)) uuid, concat('name-',cast(user_id%120 as string)) name, server_id, "
    "count(*) times, max(ms) last_bounce from ev where event_type='error' group by user_id, server_id",
    "plugin_versions": "select p_partkey id, cast(1+p_partkey%5 as int) server_id, p_name plugin_name, "
    "case when p_partkey%10=0 then null else p_brand end version, "
    f"{T0}+((p_partkey*7919)%2592000)*1000 modified from part",
    "statistic": "select cast(n_nationkey+1 as int) id, concat('stat-',n_name) name from nation",
    "statistic_value": "select cast(1+event_id%25 as int) statistic_id, user_id, server_id, cast(max(v100%1000) as int) value from ev "
    "group by event_id%25, user_id, server_id",
    "metric_plugins": f"select cast(r_regionkey+1 as int) id, concat('plugin-',r_name) name, {T0}+r_regionkey*{DAY} last_updated, "
    "cast(r_regionkey+1 as int) server_id from region",
    "metric_providers": "select cast(n_nationkey+1 as int) id, concat('provider-',cast(n_nationkey%5 as string)) name, "
    "case n_nationkey%5 when 0 then 'boolean' when 1 then 'double' when 2 then 'number' when 3 then 'percentage' else 'group' end type, "
    "cast(1+floor(n_nationkey/5) as int) plugin_id, case when n_nationkey%10=2 then 'DATE_YEAR' else 'NONE' end format, "
    "n_nationkey%3=0 show_in_table, n_nationkey%7=3 hidden, case when n_nationkey%5=0 then 'linked' end provided_condition, "
    "case when n_nationkey%5=1 then 'linked' when n_nationkey%5=2 then 'not_linked' end condition from nation",
    "metric_events": "select ev.event_id, ev.user_id, ev.server_id, ev.ms, ev.v100, mp.id provider_id, mp.type kind, mp.plugin_id "
    "from ev join metric_providers mp on mp.id=1+ev.event_id%25",
    "metric_user_values": "select user_id, provider_id, case when kind='boolean' then e%2=0 end boolean_value, "
    "case when kind='double' then cast(v as double)/100 end double_value, case when kind='percentage' then cast(v%101 as double)/100 end percentage_value, "
    "case when kind='number' then v end long_value from (select user_id, provider_id, kind, max(v100) v, max(event_id) e from metric_events "
    "where kind<>'group' group by user_id, provider_id, kind) x",
    "metric_groups": "select distinct user_id, provider_id, concat('group-',cast(v100%7 as string)) group_name from metric_events where kind='group'",
    "metric_server_values": "select cast(plugin_id as int) server_id, provider_id, case when kind='boolean' then e%2=0 end boolean_value, "
    "case when kind='double' then cast(v as double)/100 end double_value, case when kind='percentage' then cast(v%101 as double)/100 end percentage_value, "
    "case when kind='number' then v end long_value from (select plugin_id, provider_id, kind, max(v100) v, max(event_id) e from metric_events "
    "where kind<>'group' group by plugin_id, provider_id, kind) x",
    "metric_history": "select event_id id, provider_id, server_id, ms date, case when kind='double' then cast(v100 as double)/100 end double_value, "
    "case when kind='number' then v100 end long_value from metric_events where kind in ('double','number')",
    "metric_user_table_rows": "select cast(1+event_id%3 as int) table_id, user_id, event_id row_number, event_type col_1, "
    "cast(v100 as string) col_2, cast(server_id as string) col_3 from ev",
    "metric_server_table_rows": "select cast(1+event_id%3 as int) table_id, server_id, event_type col_1, count(*) uses, max(v100) best "
    "from ev group by event_id%3, server_id, event_type",
    "metric_table_headers": "select cast(r_regionkey+1 as int) id, concat('table-',r_name) name, 'Kind' col_1, 'Value' col_2, 'Server' col_3, "
    "cast(r_regionkey+1 as int) plugin_id from region",
    "session_events": "select event_id, user_id, server_id, case event_type when 'signup' then 'join' when 'purchase' then 'leave' "
    "when 'view' then 'world' when 'click' then 'action' else 'afk' end kind, ms date, "
    "concat('w',cast(event_id%3 as string)) world, cast(v100%4 as int) mode from ev",
}



def _uses(text: str, names) -> list[str]:
    return [n for n in names if re.search(rf"\b(from|join)\s+{n}\b", text, re.IGNORECASE)]


def _needs(sql: str) -> list[str]:
    """Views used by a text, each after the views it depends on."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in _uses(text, VIEWS):
            if name not in order:
                visit(VIEWS[name])
                order.append(name)

    visit(sql)
    return order


def with_views(sql: str) -> str:
    """Prefix a DuckDB text with the views it uses."""
    views = ",\n".join(f"{n} as ({VIEWS[n].replace('{MS}', MS_DUCK)})" for n in _needs(sql))
    if not views:
        return sql
    body = sql.strip()
    if body.lower().startswith("with "):
        return f"with {views},\n{body[5:]}"
    return f"with {views}\n{body}"


class Domain:
    """Lazy access to the base tables and the derived views as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in BASE_TABLES:
                self._made[name] = self.spark.read.parquet(os.path.join(self.sf_dir, f"{name}.parquet"))
            elif name in VIEWS:
                self._made[name] = self._view(name)
            else:
                raise AttributeError(name)
        return self._made[name]

    def _view(self, name: str) -> DataFrame:
        text = VIEWS[name].replace("{MS}", MS_SPARK)
        used = _uses(text, (*BASE_TABLES, *VIEWS))
        frames = {t: getattr(self, t) for t in used}
        for t in used:
            text = re.sub(rf"\b(from|join)\s+{t}\b", rf"\1 {{{t}}} {t}" if not _aliased(text, t) else rf"\1 {{{t}}}", text)
        return self.spark.sql(text, **frames)


def _aliased(text: str, table: str) -> bool:
    after = re.search(rf"\b(?:from|join)\s+{table}\s+(\w+)", text)
    return bool(after) and after.group(1).lower() not in ("group", "where", "join", "union", "on", "order")


VIEWS["logins"] = (
    "select event_id, user_id, concat(cast(1+(v100*7919+event_id)%223 as string),'.',cast(event_id%256 as string),'.',cast(v100%256 as string),'.1') ip from ev"
)
VIEWS["ip_ranges"] = (
    "select cast(n_nationkey as bigint)*134217728 first, cast(n_nationkey as bigint)*134217728+100000000 last, n_name country from nation"
)
VIEWS["country_codes"] = "select upper(n_name) name, concat('C',cast(n_nationkey as string)) code from nation join region on r_regionkey=n_regionkey where n_nationkey<>3"
VIEWS["world_aliases"] = "select world_name, case when id<3 then 'Shared' else world_name end alias from worlds where id<>5"
VIEWS["plugin_snapshot"] = (
    "select distinct cast(1+p_partkey%5 as int) server_id, p_name plugin_name, 'Brand#1' version from part where p_size<>7"
)
# A second dataset to merge: other names for half of the users, one server and one address that are new.
VIEWS["other_users"] = (
    "select user_id+100000 id, concat('u-',cast(user_id*2 as string)) uuid, min(session_start) registered, concat('other-',cast(user_id as string)) name, "
    "cast(0 as int) times_kicked from sessions group by user_id"
)
VIEWS["other_sessions"] = (
    "select id+1000000 id, user_id+100000 user_id, server_id, session_start, session_end, mob_kills, deaths, afk_time, cast(join_address_id+10 as int) join_address_id from sessions"
)
VIEWS["other_addresses"] = "select cast(r_regionkey+11 as int) id, case r_regionkey when 0 then 'unknown' when 1 then 'play.a.com' else concat('new-',r_name) end join_address from region"
VIEWS["dirty_addresses"] = "select id, case id when 2 then concat('play.a.com',chr(0),'x') when 3 then concat('MC.B.com',chr(0),'y') else join_address end join_address from join_address"
VIEWS["dirty_user_info"] = (
    "select id, user_id, server_id, 'play.a.com' join_address, registered, opped, banned from user_info union all "
    "select id+10000000 id, user_id, server_id, 'dup' join_address, registered+5 registered, opped, banned from user_info"
)
VIEWS["ban_list"] = "select user_id, server_id from ev where event_type='error' group by user_id, server_id having max(v100)>8000"
VIEWS["pulses"] = (
    "select event_id id, server_id, ms date, case when event_id%50=0 then -1.0 else 20.0-cast(v100%1500 as double)/100 end tps, cast(event_id%12 as int) players, "
    "cast(v100%10000 as double)/100 cpu, 1000+v100%4000 ram, cast(v100%900 as int) entities, cast(event_id%300 as int) chunks, 50000+v100%1000 disk, v100%90 mspt from ev"
)
VIEWS["raw_pings"] = "select event_id id, user_id, server_id, ms date, cast(v100%4200-20 as int) value from ev where event_type='click'"
# Mob kills and deaths among the session events, and who is exempt from AFK times when.
VIEWS["combat_events"] = (
    "select event_id, user_id, server_id, kind, date, world, mode from session_events union all "
    "select event_id+1000000000 event_id, user_id, server_id, case when v100%3=0 then 'death' else 'mob_kill' end kind, ms date, "
    "concat('w',cast(event_id%3 as string)) world, cast(v100%4 as int) mode from ev where event_id%4<>1"
)
VIEWS["exemptions"] = (
    f"select user_id, cast({T0}+(user_id%9)*{2 * DAY} as bigint) valid_from, case when user_id%3=0 then null else cast({T0}+(user_id%9+user_id%5)*{2 * DAY} as bigint) end valid_to "
    "from ev where user_id%2=0 group by user_id union all "
    f"select user_id, cast(null as bigint) valid_from, cast({T0}+{DAY} as bigint) valid_to from ev where user_id%5=0 group by user_id"
)
# Addresses of both kinds as texts and, for the SQL side, as two halves of 128 bits; networks that lie within each other.
VIEWS["addresses"] = (
    "select ip, cast(0 as bigint) hi, 281470681743360+cast(split_part(ip,'.',1) as bigint)*16777216+cast(split_part(ip,'.',2) as bigint)*65536"
    "+cast(split_part(ip,'.',3) as bigint)*256+cast(split_part(ip,'.',4) as bigint) lo from logins union all "
    "select concat('2001:db8:',lower(hex(event_id%23)),'::',lower(hex(v100))) ip, 2306139568115548160+(event_id%23)*65536 hi, v100 lo from ev union all "
    "select concat('2A02:0:0:',hex(event_id%7),':0:0:0:',hex(1+event_id%300)) ip, 3026981734365233152+event_id%7 hi, 1+event_id%300 lo from ev where event_id%5=0"
)
VIEWS["networks"] = (
    "select concat(cast(n_nationkey*9 as string),'.0.0.0/8') cidr, n_name country, 104 bits, cast(0 as bigint) hi1, cast(0 as bigint) hi2, "
    "281470681743360+cast(n_nationkey as bigint)*9*16777216 lo1, 281470681743360+(cast(n_nationkey as bigint)*9+1)*16777216-1 lo2 from nation union all "
    "select concat(cast(n_nationkey*9 as string),'.128.0.0/10'), concat(n_name,' half'), 106, cast(0 as bigint), cast(0 as bigint), "
    "281470681743360+cast(n_nationkey as bigint)*9*16777216+8388608, 281470681743360+cast(n_nationkey as bigint)*9*16777216+8388608+4194303 from nation union all "
    "select '2001:db8::/32', 'documents', 32, 2306139568115548160, 2306139572410515455, cast(0 as bigint), 9223372036854775807 from region where r_regionkey=0 union all "
    "select concat('2001:DB8:',hex(n_nationkey),'::/48'), n_name, 48, 2306139568115548160+cast(n_nationkey as bigint)*65536, 2306139568115548160+cast(n_nationkey as bigint)*65536+65535, "
    "cast(0 as bigint), 9223372036854775807 from nation where n_nationkey%2=0 union all "
    "select concat('2001:db8:',hex(n_nationkey),'::0:0/119'), concat(n_name,' low'), 119, 2306139568115548160+cast(n_nationkey as bigint)*65536, 2306139568115548160+cast(n_nationkey as bigint)*65536, "
    "cast(0 as bigint), cast(511 as bigint) from nation where n_nationkey%3=0 union all "
    "select '2a02:0:0:3::/64', 'sixty-four', 64, 3026981734365233155, 3026981734365233155, cast(0 as bigint), 9223372036854775807 from region where r_regionkey=0"
)
