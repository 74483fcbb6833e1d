from pyspark.sql import functions as F

from arenalytics.operators import metrics as ext
from catalog import query
from catalog.domain import NOW, T0

DAY = 86400000
META = "join metric_providers mp on mp.id=x.provider_id and not mp.hidden join metric_plugins pl on pl.id=mp.plugin_id"


def _stat(cols, where):
    return f"""select x.provider_id, mp.name provider, pl.name plugin, pl.server_id, {', '.join('x.' + c.split()[-1] for c in cols.split(';'))}
 from (select provider_id, {cols.replace(';', ',')} from metric_user_values where {where} is not null group by provider_id) x {META}"""


@query("ext_1_boolean_shares", _stat("count(*) filter (where boolean_value)/count(*) as share", "boolean_value"), doubles="share")
def _(d):
    return ext.boolean_shares(d.metric_user_values, d.metric_providers, d.metric_plugins)


@query("ext_2_double_stats", _stat("avg(double_value) average;sum(double_value) total", "double_value"), doubles="average total")
def _(d):
    return ext.double_stats(d.metric_user_values, d.metric_providers, d.metric_plugins)


@query("ext_3_number_stats", _stat("avg(long_value) average;cast(sum(long_value) as bigint) total", "long_value") + " where mp.format not in ('DATE_YEAR','DATE_SECOND')", doubles="average")
def _(d):
    return ext.number_stats(d.metric_user_values, d.metric_providers, d.metric_plugins)


@query("ext_4_percentage_stats", _stat("avg(percentage_value) average", "percentage_value"), doubles="average")
def _(d):
    return ext.percentage_stats(d.metric_user_values, d.metric_providers, d.metric_plugins)


@query("ext_5_group_sizes", f"""select x.provider_id, mp.name provider, pl.name plugin, pl.server_id, group_name, users from (
 select provider_id, group_name, count(*) users from metric_groups group by 1,2) x {META}""")
def _(d):
    return ext.group_sizes(d.metric_groups, d.metric_providers, d.metric_plugins)


COLS = "boolean_value, double_value, percentage_value, long_value"


@query("ext_6_user_values", f"select user_id, x.provider_id, mp.name provider, pl.name plugin, pl.server_id, mp.format, {COLS} from metric_user_values x {META}")
def _(d):
    return ext.with_metadata(d.metric_user_values, d.metric_providers, d.metric_plugins)


@query("ext_6_user_groups", f"select user_id, x.provider_id, mp.name provider, pl.name plugin, pl.server_id, mp.format, group_name from metric_groups x {META}")
def _(d):
    return ext.with_metadata(d.metric_groups, d.metric_providers, d.metric_plugins)


@query("ext_6_user_tables", """select user_id, h.name "table", plugin_id, h.col_1 header_1, x.col_1, x.col_2, x.col_3 from metric_user_table_rows x
 join metric_table_headers h on h.id=x.table_id""")
def _(d):
    return ext.table_rows(d.metric_user_table_rows, d.metric_table_headers, "user_id")


@query("ext_7_server_values", f"select x.provider_id, mp.name provider, pl.name plugin, pl.server_id, mp.format, {COLS} from metric_server_values x {META}")
def _(d):
    return ext.with_metadata(d.metric_server_values.drop("server_id"), d.metric_providers, d.metric_plugins)


@query("ext_7_server_tables", """select x.server_id, h.name "table", plugin_id, h.col_1 header_1, x.col_1 from metric_server_table_rows x
 join metric_table_headers h on h.id=x.table_id""")
def _(d):
    return ext.table_rows(d.metric_server_table_rows, d.metric_table_headers, "server_id")


@query("ext_8_history_series", f"""select x.provider_id, mp.name provider, pl.name plugin, pl.server_id, x.date, x.id, coalesce(x.double_value, cast(x.long_value as double)) as value
 from metric_history x {META}""", doubles="value")
def _(d):
    return ext.history_series(d.metric_history, d.metric_providers, d.metric_plugins)


NAMES = ["1.provider-0", "2.provider-1", "3.provider-2", "1.provider-3", "2.provider-4"]


@query("ext_9_values_in_player_table", """with r as (select user_id from sessions group by user_id order by max(session_end) desc, user_id limit 50),
 v as (select user_id, provider_id, coalesce(cast(boolean_value as varchar), cast(long_value as varchar)) t from metric_user_values where user_id in (select user_id from r)
 union all select user_id, provider_id, string_agg(distinct group_name, ',' order by group_name) from metric_groups where user_id in (select user_id from r) group by 1,2),
 s as (select v.user_id, concat(cast(plugin_id as varchar),'.',name) m, t from v join metric_providers p on p.id=v.provider_id where show_in_table)
 select user_id, max(t) filter (where m='1.provider-0') b1, max(t) filter (where m='3.provider-2') n3, max(t) filter (where m='2.provider-4') g2 from s group by user_id""")
def _(d):
    wide = ext.in_player_table(d.metric_user_values, d.metric_groups, d.metric_providers, ext.recent_users(d.sessions, 50), NAMES)
    return wide.select("user_id", F.col("`1.provider-0`").alias("b1"), F.col("`3.provider-2`").alias("n3"), F.col("`2.provider-4`").alias("g2"))


@query("ext_10_users_in_groups", """select distinct user_id from metric_groups g join metric_providers p on p.id=g.provider_id
 where p.plugin_id=2 and p.type='group' and group_name in ('group-1','group-2')""")
def _(d):
    return ext.users_in_groups(d.metric_groups, d.metric_providers.where("plugin_id = 2 and type = 'group'"), ["group-1", "group-2"])


@query("ext_10_users_with_boolean", """select distinct user_id, 'TRUE' wanted from metric_user_values where provider_id=6 and boolean_value union all
 select distinct user_id, 'FALSE' from metric_user_values where provider_id=6 and not boolean_value union all
 select distinct user_id, 'BOTH' from metric_user_values where provider_id=6 and boolean_value is not null""")
def _(d):
    ids = d.metric_providers.where("id = 6")
    sets = [ext.users_with_boolean(d.metric_user_values, ids, w).withColumn("wanted", F.lit(w)) for w in ("TRUE", "FALSE", "BOTH")]
    return sets[0].unionByName(sets[1]).unionByName(sets[2])


@query("ext_11_append_history", f"""select provider_id, server_id, date, double_value, long_value from metric_history union all
 select provider_id, server_id, {NOW}, coalesce(double_value, percentage_value), long_value from metric_server_values where boolean_value is null""", doubles="double_value")
def _(d):
    return ext.append_history(d.metric_history, d.metric_server_values, NOW)


@query("ext_12_satisfied_values", """select v.user_id, v.provider_id from metric_user_values v join metric_providers p on p.id=v.provider_id
 where not exists (select 1 from metric_user_values b join metric_providers q on q.id=b.provider_id where b.user_id=v.user_id and q.plugin_id=p.plugin_id
 and q.provided_condition is not null and b.boolean_value is not null
 and p.condition=case when b.boolean_value then concat('not_',q.provided_condition) else q.provided_condition end)""")
def _(d):
    return ext.satisfied_values(d.metric_user_values, d.metric_providers).select("user_id", "provider_id")


CUT = T0 + 2 * DAY


@query("ext_13_without_stale_providers", f"""select user_id, provider_id from metric_user_values where provider_id not in (select p.id from metric_providers p
 join metric_plugins l on l.id=p.plugin_id where l.last_updated<{CUT} or l.name='plugin-EUROPE')""")
def _(d):
    stale = ext.stale_providers(d.metric_providers, d.metric_plugins, CUT, ["plugin-EUROPE"])
    return ext.drop_providers(d.metric_user_values, stale).select("user_id", "provider_id")


@query("ext_13_without_invalidated", "select provider_id, date, server_id from metric_history where provider_id not in (select id from metric_providers where name='provider-1')")
def _(d):
    return ext.drop_providers(d.metric_history, d.metric_providers.where("name = 'provider-1'").select("id")).select("provider_id", "date", "server_id")


@query("ext_14_installed", "select p.id, p.name, p.server_id, s.name server from metric_plugins p join servers s on s.id=p.server_id")
def _(d):
    return ext.installed(d.metric_plugins, d.servers)


def _registry():
    registry = ext.Registry()

    @registry.metric("boolean", "user", provides="veteran")
    def is_veteran(tables):
        return tables["sessions"].groupBy(F.col("user_id").alias("key")).agg((F.count("*") >= 60).alias("value"))

    @registry.metric("number", "user", condition="veteran")
    def veteran_playtime(tables):
        return tables["sessions"].groupBy(F.col("user_id").alias("key")).agg(F.sum(F.col("session_end") - F.col("session_start")).alias("value"))

    @registry.metric("double", "user", condition="not_veteran", on=("leave",))
    def mean_deaths(tables):
        return tables["sessions"].groupBy(F.col("user_id").alias("key")).agg(F.avg("deaths").alias("value"))

    @registry.metric("group", "user")
    def home(tables):
        best = F.max_by("server_id", F.struct("session_start", "id"))
        return tables["sessions"].groupBy(F.col("user_id").alias("key")).agg(F.concat(F.lit("server-"), best.cast("string")).alias("value"))

    @registry.metric("percentage", "server")
    def afk_share(tables):
        return tables["sessions"].groupBy(F.col("server_id").alias("key")).agg(
            (F.sum("afk_time") / F.sum(F.col("session_end") - F.col("session_start"))).alias("value")
        )

    @registry.metric("table", "server")
    def busiest(tables):
        return tables["sessions"].groupBy(F.col("server_id").alias("key"), F.col("join_address_id").alias("col_1")).agg(F.count("*").alias("col_2"))

    return registry


@query("udf_1_user_metrics", """with s as (select user_id, count(*)>=60 v, sum(session_end-session_start) p, avg(deaths) m, max_by(server_id, session_start) h from sessions group by 1)
 select 'is_veteran' provider, user_id as key, v boolean_value, cast(null as double) double_value, cast(null as bigint) long_value, cast(null as varchar) group_name from s
 union all select 'veteran_playtime', user_id, null, null, cast(p as bigint), null from s where v
 union all select 'mean_deaths', user_id, null, m, null, null from s where not v
 union all select 'home', user_id, null, null, null, concat('server-',cast(h as varchar)) from s""", doubles="double_value")
def _(d):
    rows = _registry().evaluate({"sessions": d.sessions}, "user")
    return rows.select("provider", "key", "boolean_value", "double_value", "long_value", "group_name")


@query("udf_1_server_metrics", "select 'afk_share' provider, server_id as key, sum(afk_time)/sum(session_end-session_start) percentage_value from sessions group by server_id", doubles="percentage_value")
def _(d):
    return _registry().evaluate({"sessions": d.sessions}, "server").select("provider", "key", "percentage_value")


@query("udf_1_table_provider", """select 'busiest' provider, server_id as key, cast(join_address_id as varchar) col_1, cast(count(*) as varchar) col_2, cast(null as varchar) col_5
 from sessions group by server_id, join_address_id""")
def _(d):
    return _registry().evaluate_tables({"sessions": d.sessions}, "server").select("provider", "key", "col_1", "col_2", "col_5")


@query("udf_2_metrics_of_event", "select 'mean_deaths' provider, user_id as key, avg(deaths) double_value from sessions group by user_id", doubles="double_value")
def _(d):
    return _registry().evaluate({"sessions": d.sessions}, "user", event="leave").select("provider", "key", "double_value")
