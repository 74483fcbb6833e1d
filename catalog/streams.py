"""Streaming queries: the event log is replayed as a stream until it is drained."""

from pyspark.sql import functions as F

from arenalytics.operators import lifecycle as life
from arenalytics.operators import roster
from arenalytics.session import shared_folder
from arenalytics.streaming import batches, replay, rollups, sessions
from catalog import query
from catalog.domain import DAY, NOW, T0, Domain
from catalog.io import AFK_SQL, CHANGES, FINISHED, ROLLUP_SQL, STATE, WORLD_SQL
from catalog.metrics import _registry

HOUR, MINUTE = 3600000, 60000
DELAY = 10 * MINUTE


class Live(Domain):
    """The views over a streaming read of one base table."""

    def __init__(self, d: Domain, table: str):
        super().__init__(d.spark, d.sf_dir)
        schema = getattr(d, table).schema
        self._made[table] = replay.file_stream(d.spark, d.sf_dir, schema, f"{table}.parquet")


def _whole(d, view: str, build, purpose: str):
    """The rows that a stream gives for a view of the event log, up to and with the stream's end."""
    return d.spark.read.parquet(replay.drain_closed(getattr(Live(d, "events"), view), build, purpose))


def _sessions(d, view: str = "session_events", exempt=None):
    build = lambda events: sessions.live_rows(events, session_timeout=None, exempt=exempt)
    return sessions.finished(_whole(d, view, build, "sessions"))


@query("str_1_live_sessions", f"""with f as ({FINISHED}), a as ({AFK_SQL}) select f.user_id, f.server_id, f.session_start, f.session_end, f.interrupted, coalesce(a.afk_time,0) afk_time
 from f left join a on a.user_id=f.user_id and a.session_start=f.session_start""")
def _(d):
    return _sessions(d).select("user_id", "server_id", "session_start", "session_end", "interrupted", "afk_time")


@query("str_2_live_exemption", f"""with s as ({STATE.format(k="'join','leave','action','afk'")}), e as (select *, exists (select 1 from exemptions x where x.user_id=s.user_id
 and s.date>=coalesce(x.valid_from, s.date) and (x.valid_to is null or s.date<x.valid_to)) ex from s),
 p as (select *, lag(date) over w pd, lag(case when ex and kind='afk' then 'still' else kind end) over w pk, lag(open_start) over w po from e window w as (partition by user_id order by date, event_id)),
 a as (select user_id, po session_start, cast(sum(case when ex then 0 when pk='afk' then date-pd when date-pd>=180000 then date-pd else 0 end) as bigint) afk_time from p
 where kind in ('action','leave') and po>=0 group by 1,2), f as ({FINISHED})
 select f.user_id, f.session_start, coalesce(a.afk_time,0) afk_time from f left join a on a.user_id=f.user_id and a.session_start=f.session_start""")
def _(d):
    return _sessions(d, exempt=d.exemptions).select("user_id", "session_start", "afk_time")


@query("str_2_versioned_exemption_batch", f"""with s as ({STATE.format(k="'join','leave','action','afk'")}), e as (select *, exists (select 1 from exemptions x where x.user_id=s.user_id
 and s.date>=coalesce(x.valid_from, s.date) and (x.valid_to is null or s.date<x.valid_to)) ex from s),
 p as (select *, lag(date) over w pd, lag(case when ex and kind='afk' then 'still' else kind end) over w pk, lag(open_start) over w po from e window w as (partition by user_id order by date, event_id))
 select user_id, po session_start, cast(sum(case when ex then 0 when pk='afk' then date-pd when date-pd>=180000 then date-pd else 0 end) as bigint) afk_time from p
 where kind in ('action','leave') and po>=0 group by 1,2""")
def _(d):
    return life.afk_times(d.session_events, exempt=d.exemptions)


@query("str_3_live_world_times", f"""with f as ({FINISHED}), w as ({WORLD_SQL}) select w.* from w join f on f.user_id=w.user_id and f.session_start=w.session_start""")
def _(d):
    return sessions.as_world_times(_sessions(d))


COUNTED = f"""select user_id, open_start session_start, cast(count(*) filter (where kind='mob_kill') as int) mob_kills, cast(count(*) filter (where kind='death') as int) deaths
 from ({STATE.replace("session_events", "combat_events").format(k="'join','leave','mob_kill','death'")}) c where open_start>=0 and kind in ('mob_kill','death') group by 1,2"""


@query("str_4_event_counters_batch", COUNTED)
def _(d):
    return life.event_counters(d.combat_events)


@query("str_4_live_counters", f"""with f as ({FINISHED}), k as ({COUNTED}) select f.user_id, f.server_id, f.session_start, f.session_end, coalesce(mob_kills,0) mob_kills, coalesce(deaths,0) deaths
 from f left join k on k.user_id=f.user_id and k.session_start=f.session_start""")
def _(d):
    return _sessions(d, "combat_events").select("user_id", "server_id", "session_start", "session_end", "mob_kills", "deaths")


@query("str_5_live_minutes", ROLLUP_SQL, doubles="tps cpu_usage mspt_average mspt_jitter_avg mspt_jitter_max")
def _(d):
    return _whole(d, "pulses", rollups.live_minutes, "minutes")


@query("str_7_live_pings", f"""select user_id, server_id, max(date) date, coalesce(min(value) filter (where value>0 and value<=4000),-1) min_ping,
 coalesce(max(value) filter (where value>0 and value<=4000),-1) max_ping, cast(trunc(quantile_cont(value,0.5)) as double) avg_ping from raw_pings
 group by user_id, server_id, floor(date/{HOUR})""", doubles="avg_ping")
def _(d):
    return _whole(d, "raw_pings", lambda pings: rollups.live_pings(pings, width="1 hour"), "pings")


@query("str_0_activity_sessions", f"""with g as (select user_id, date, case when date-lag(date) over (partition by user_id order by date)<{30 * MINUTE} then 0 else 1 end n from session_events),
 s as (select user_id, date, sum(n) over (partition by user_id order by date rows unbounded preceding) k from g)
 select user_id, min(date) session_start, max(date) session_end, count(*) "events" from s group by user_id, k""")
def _(d):
    return _whole(d, "session_events", rollups.activity_sessions, "activity")


@query("str_11_late_side_output", f"""with a as (select *, least(cast(floor((date-{T0}+case when event_id%40=0 then {2 * DAY} else 0 end)/{5 * DAY}) as int), 5) arrival from session_events),
 m as (select arrival, max(max(date)) over (order by arrival rows between unbounded preceding and 1 preceding)-{DELAY} watermark from a group by arrival)
 select a.user_id, a.event_id, a.date, a.kind from a join m on m.arrival=a.arrival where a.date<=m.watermark""")
def _(d):
    """Events that arrive two days late, in six batches: the side output of the running session stream."""
    late = F.when(F.col("event_id") % 40 == 0, 2 * DAY).otherwise(0)
    arrival = F.least(F.floor((F.col("date") - T0 + late) / (5 * DAY)).cast("int"), F.lit(5))
    arriving = d.session_events.withColumn("arrival", arrival)
    folder = shared_folder(d.spark, "arrivals")
    for (n,) in sorted(arriving.select("arrival").distinct().collect()):
        arriving.where(F.col("arrival") == n).drop("arrival").repartition(1).write.mode("append").parquet(folder)
    source = replay.file_stream(d.spark, folder, d.session_events.schema, files_per_batch=1)
    build = lambda events: sessions.live_rows(events, session_timeout=None)
    rows = d.spark.read.parquet(replay.drain_closed(source, build, "late"))
    return sessions.late_events(rows).select("user_id", "event_id", "date", "kind")


@query("str_8_metric_refresh", """select 'mean_deaths' provider, user_id as key, avg(deaths) double_value from sessions where user_id in (select user_id from session_events where kind='leave') group by user_id""",
    doubles="double_value")
def _(d):
    write = batches.refresh_metrics(_registry(), {"sessions": d.sessions}, "leave")
    done = d.spark.read.parquet(replay.drain(Live(d, "events").session_events, "metrics", write))
    return done.select("provider", "key", "double_value")


@query("str_10_plugin_changes", f"""with i as (select server_id, plugin_name, version from (select *, row_number() over (partition by server_id, plugin_name order by modified desc, id desc) r
 from plugin_versions) x where r=1 and version is not null)
 select coalesce(i.server_id,s.server_id) server_id, coalesce(i.plugin_name,s.plugin_name) plugin_name, s.version, {NOW} modified,
 case when i.version is null then 'new' when s.version is null then 'removed' else 'updated' end change from i
 full join plugin_snapshot s on s.server_id=i.server_id and s.plugin_name=i.plugin_name where i.version is distinct from s.version""")
def _(d):
    write = batches.record_plugin_changes(roster.installed_plugins(d.plugin_versions), NOW)
    snapshots = Live(d, "part").part.selectExpr("cast(1 + p_partkey % 5 as int) server_id", "p_name plugin_name", "'Brand#1' version", "p_size").where("p_size <> 7").drop("p_size")
    once = lambda batch, batch_id, path: write(batch.distinct(), batch_id, path)
    done = d.spark.read.parquet(replay.drain(snapshots, "plugins", once))
    return done.select("server_id", "plugin_name", "version", "modified", "change")


SNAPSHOTS = f"""with s as (select server_id, 1 snapshot, plugin_name, version from plugin_snapshot union all select server_id, 2, plugin_name, 'Brand#2' from plugin_snapshot where length(plugin_name)%3<>0),
 i as (select server_id, plugin_name, version from (select *, row_number() over (partition by server_id, plugin_name order by modified desc, id desc) r from plugin_versions) x where r=1 and version is not null),
 a as (select server_id, plugin_name, version from s where snapshot=1), b as (select server_id, plugin_name, version from s where snapshot=2),
 c as (select 1 step, coalesce(i.server_id,a.server_id) server_id, coalesce(i.plugin_name,a.plugin_name) plugin_name, a.version, case when i.version is null then 'new' when a.version is null then 'removed' else 'updated' end change
 from (select * from i where server_id in (select server_id from a)) i full join a on a.server_id=i.server_id and a.plugin_name=i.plugin_name where i.version is distinct from a.version union all
 select 2, coalesce(a.server_id,b.server_id), coalesce(a.plugin_name,b.plugin_name), b.version, case when a.version is null then 'new' when b.version is null then 'removed' else 'updated' end
 from (select * from a where server_id in (select server_id from b)) a full join b on a.server_id=b.server_id and a.plugin_name=b.plugin_name where a.version is distinct from b.version)
 select cast(step as int) step, server_id, plugin_name, version, {NOW} modified, change from c"""


@query("str_10_split_snapshots", SNAPSHOTS)
def _(d):
    """Two snapshots of every server, each cut over three batches that hold rows of all servers."""
    second = d.plugin_snapshot.where(F.char_length("plugin_name") % 3 != 0).withColumn("version", F.lit("Brand#2"))
    both = d.plugin_snapshot.withColumn("snapshot", F.lit(1).cast("bigint")).unionByName(second.withColumn("snapshot", F.lit(2).cast("bigint")))
    sizes = both.groupBy("server_id", "snapshot").agg(F.countDistinct("plugin_name").alias("plugins"))
    rows = both.join(sizes, ["server_id", "snapshot"]).select("server_id", "snapshot", "plugins", "plugin_name", "version")
    folder = shared_folder(d.spark, "snapshots")
    for n in (1, 2):
        for part in range(3):
            rows.where((F.col("snapshot") == n) & (F.pmod(F.xxhash64("plugin_name"), F.lit(3)) == part)).coalesce(1).write.mode("append").parquet(folder)
    source = replay.file_stream(d.spark, folder, rows.schema, files_per_batch=1)
    out = replay.drain(source, "split", batches.record_split_snapshots(roster.installed_plugins(d.plugin_versions), NOW))
    changes = d.spark.read.parquet(f"{out}/changes")
    # Batches 0 to 2 bring the first snapshots, 3 to 5 the second ones.
    step = F.floor(F.col("batch") / 3).cast("int") + 1
    return changes.select(step.alias("step"), "server_id", "plugin_name", "version", "modified", "change")


@query("str_9_preserved_sessions", f"""select user_id, server_id, date session_start, {NOW} session_end from (select *, lead(date) over (partition by user_id order by date, event_id) nd from ({CHANGES}) c) x
 where kind='join' and nd is null""")
def _(d):
    folder = batches.preserve_open_sessions(life.close_open_sessions(d.session_events, NOW), shared_folder(d.spark, "stop"), 1)
    return d.spark.read.parquet(folder).select("user_id", "server_id", "session_start", "session_end")
