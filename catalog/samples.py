from pyspark.sql import functions as F

from arenalytics.operators import samples as tps
from catalog import query
from catalog.domain import A, B, NOW, T0

DAY, HOUR, MINUTE = 86400000, 3600000, 60000
IN = f"date>={A} and date<={B}"
OPEN = f"date<{B} and date>{A}"
LOW = 12.0
HIGHEST = [m for m in tps.METRICS if m not in ("tps", "mspt_jitter_avg")]


def res_sql(a, b, width):
    return (
        f"select server_id, min(date) date, min(tps) tps, avg(mspt_jitter_avg) mspt_jitter_avg, {', '.join(f'max({m}) {m}' for m in HIGHEST)} "
        f"from samples where date>={a} and date<{b} group by server_id, floor(date/{width})"
    )


@query("flt_2_dated_and_tps_range", f"select id, date, tps from samples where {IN} and tps>-1 and tps<{LOW}")
def _(d):
    return tps.tps_between(tps.dated(d.samples, A, B), -1, LOW).select("id", "date", "tps")


@query("flt_5_online_activity", """select server_id, count(*) filter (where players_online>0) active, count(*) filter (where players_online=0) idle
 from samples group by server_id""")
def _(d):
    kinds = tps.online_activity(d.samples, "ACTIVE").withColumn("k", F.lit("a")).unionByName(tps.online_activity(d.samples, "IDLE").withColumn("k", F.lit("i")))
    return kinds.groupBy("server_id").agg(F.count_if(F.col("k") == "a").alias("active"), F.count_if(F.col("k") == "i").alias("idle"))


@query("tps_1_in_resolution", res_sql(A, B, 20 * MINUTE), doubles="mspt_jitter_avg")
def _(d):
    return tps.in_resolution(d.samples, A, B, 20 * MINUTE)


@query("tps_2_raw_series", f"select server_id, date, {', '.join(tps.METRICS)} from samples where {IN} and server_id<>2")
def _(d):
    return tps.raw_series(d.samples.where(F.col("server_id") != 2), A, B)


@query("tps_3_stitched_series", f"""select *, {20 * MINUTE} resolution from ({res_sql(0, NOW - 20 * DAY, 20 * MINUTE)}) o
 union all by name select *, {5 * MINUTE} resolution from ({res_sql(NOW - 20 * DAY, NOW - 10 * DAY, 5 * MINUTE)}) m
 union all by name select server_id, date, {', '.join(tps.METRICS)}, 0 resolution from samples where date between {NOW - 10 * DAY} and {NOW}""", doubles="mspt_jitter_avg")
def _(d):
    return tps.stitched_series(d.samples, NOW, raw_span=10 * DAY, fine_span=20 * DAY)


@query("tps_4_preview", f"select server_id, min(date) date, max(players_online) players_online from samples group by server_id, floor(date/{15 * MINUTE})")
def _(d):
    return tps.preview(d.samples)


@query("tps_5_players_online_series", f"select server_id, date, players_online from samples where {OPEN}")
def _(d):
    return tps.players_online_series(d.samples, A, B)


@query("tps_6_occupied_time", f"""with o as (select server_id, date, lag(date) over (partition by server_id order by date) p from samples
 where players_online>0 and {IN}), m as (select *, case when p is null or date-p>=180000 then 1 else 0 end n from o),
 s as (select server_id, date, sum(n) over (partition by server_id order by date rows unbounded preceding) seg from m),
 g as (select server_id, seg, max(date)-min(date) len from s group by 1,2)
 select server_id, cast(sum(len) as bigint) occupied from g group by server_id""")
def _(d):
    return tps.occupied_time(d.samples, A, B)


DIFF = "select {k} date-lag(date) over ({p} order by date) diff from samples where {w}"


@query("tps_7_uptime", f"""select server_id, cast(coalesce(sum(diff) filter (where diff<=120000),0) as bigint) uptime
 from ({DIFF.format(k='server_id,', p='partition by server_id', w=IN)}) q group by server_id""")
def _(d):
    return tps.up_and_down_time(d.samples, A, B).select("server_id", "uptime")


@query("tps_7_uptime_servers_merged", f"select cast(coalesce(sum(diff) filter (where diff<=120000),0) as bigint) uptime from ({DIFF.format(k='', p='', w=IN)}) q")
def _(d):
    return tps.up_and_down_time(d.samples, A, B, merge_servers=True).select("uptime")


@query("tps_8_downtime", f"""select server_id, cast(coalesce(sum(diff) filter (where diff>=180000),0) as bigint) downtime
 from ({DIFF.format(k='server_id,', p='partition by server_id', w=IN)}) q group by server_id""")
def _(d):
    return tps.up_and_down_time(d.samples, A, B).select("server_id", "downtime")


POINTS = "select server_id, date, min(tps) tps, max(players_online) players_online from samples where {w} group by 1,2"


@query("tps_9_low_tps_spikes", f"""select server_id, count(*) filter (where tps>0 and tps<{LOW} and (p is null or p>={LOW})) spikes from (
 select *, lag(tps) over (partition by server_id order by date) p from ({POINTS.format(w=IN)}) x) y group by server_id""")
def _(d):
    return tps.low_tps_spikes(d.samples, LOW, A, B)


@query("tps_10_up_and_down_by_sample", f"""select server_id, cast(coalesce(sum(diff) filter (where diff<120000),0) as bigint) uptime,
 cast(coalesce(sum(diff) filter (where diff>180000),0) as bigint) downtime
 from ({DIFF.format(k='server_id,', p='partition by server_id', w=IN)}) q group by server_id""")
def _(d):
    return tps.up_and_down_time(d.samples, A, B, exclusive=True)


@query("tps_10_occupied_by_sample", f"""select server_id, cast(coalesce(sum(date-p) filter (where players_online>0 and date-p<=180000),0) as bigint) occupied
 from (select *, lag(date) over (partition by server_id order by date) p from ({POINTS.format(w=IN)}) x) y group by server_id""")
def _(d):
    return tps.occupied_time_by_sample(d.samples, A, B)


@query("tps_10_spikes_by_sample", f"""select server_id, count(*) filter (where l and not coalesce(pl,false)) spikes from (
 select *, lag(l) over (partition by server_id order by date) pl from (select *, tps>=0 and tps<{LOW} l from ({POINTS.format(w=IN)}) x) z) y group by server_id""")
def _(d):
    return tps.low_tps_spikes_by_sample(d.samples, LOW, A, B)


@query("tps_11_peak_players", f"""select server_id, date, players_online from (select *, row_number() over (partition by server_id
 order by players_online desc, date desc) rn from samples where {IN}) r where rn=1""")
def _(d):
    return tps.peak_players(d.samples, A, B)


@query("tps_12_network_peak", f"""select date, cast(n as bigint) players_online from (select date, sum(players_online) n from samples where {IN}
 group by date) x order by n desc, date desc limit 1""")
def _(d):
    return tps.network_peak(d.samples, A, B)


@query("tps_12_single_proxy_peak", f"""select server_id, date, players_online from (select s.*, row_number() over (order by players_online desc, date desc) rn
 from samples s join servers v on v.id=s.server_id where v.is_proxy and {IN}) r where rn=1""")
def _(d):
    proxies = d.servers.where("is_proxy").select(F.col("id").alias("server_id"))
    return tps.peak_players(d.samples, A, B, proxies)


@query("tps_13_latest_sample", """select server_id, date, id, tps, players_online, mspt_average from (select *, row_number() over (partition by server_id
 order by date desc, id desc) rn from samples) r where rn=1""")
def _(d):
    return tps.latest_sample(d.samples).select("server_id", "date", "id", "tps", "players_online", "mspt_average")


def _averages_sql(where, group="server_id"):
    cols = [f"coalesce(avg(case when {m}>=0 then {m} end),-1) average_{m}" for m in tps.METRICS if m not in ("mspt_95th", "mspt_jitter_max")]
    cols += [
        "coalesce(max(mspt_jitter_max),-1) max_jitter", "coalesce(max(mspt_95th),-1) max_mspt_95th",
        "coalesce(max(free_disk_space) filter (where free_disk_space>=0),-1) max_disk",
        "coalesce(min(free_disk_space) filter (where free_disk_space>=0),-1) min_disk",
    ]
    return f"select {group}, {', '.join(cols)} from samples where {where} group by {group}"


AVG_COLS = " ".join(f"average_{m}" for m in tps.METRICS if m not in ("mspt_95th", "mspt_jitter_max")) + " max_jitter max_mspt_95th"


@query("tps_14_averages", _averages_sql(OPEN), doubles=AVG_COLS)
def _(d):
    return tps.averages(d.samples, A, B)


@query("tps_15_extremes_when_active", _averages_sql(OPEN + " and players_online>0"), doubles=AVG_COLS)
def _(d):
    return tps.averages(d.samples, A, B, activity="ACTIVE")


@query("tps_16_under_low_tps", f"""select server_id, coalesce(avg(mspt_average) filter (where mspt_average>=0),-1) average_mspt,
 coalesce(max(mspt_95th) filter (where mspt_95th>=0),-1) max_mspt_95th from samples where {OPEN} and tps<{LOW} group by server_id""", doubles="average_mspt max_mspt_95th")
def _(d):
    return tps.under_low_tps(d.samples, A, B, LOW)


@query("tps_17_load_ratios", f"""with i as (select server_id, avg(cpu_usage) idle from samples where {OPEN} and players_online=0 and cpu_usage>=0 group by server_id)
 select s.server_id, coalesce(avg((cpu_usage-idle)/players_online) filter (where cpu_usage>=0 and players_online>0),-1) cpu_per_player,
 coalesce(avg(chunks_loaded/players_online) filter (where chunks_loaded>=0 and players_online>0),-1) chunks_per_player,
 coalesce(avg(entities/chunks_loaded) filter (where entities>=0 and chunks_loaded>0),-1) entities_per_chunk,
 coalesce(avg(mspt_average/players_online) filter (where mspt_average>=0 and players_online>0),-1) mspt_per_player,
 coalesce(avg(mspt_average/chunks_loaded) filter (where mspt_average>=0 and chunks_loaded>0),-1) mspt_per_chunk
 from samples s left join i on i.server_id=s.server_id where {OPEN} group by s.server_id""",
    doubles="cpu_per_player chunks_per_player entities_per_chunk mspt_per_player mspt_per_chunk")
def _(d):
    return tps.load_ratios(d.samples, A, B)


GAP = 3 * HOUR // 2


def start_sql(gap):
    return (
        f"select server_id, max(s) start from (select server_id, date s from (select server_id, date, date-lag(date) over (partition by server_id order by date) diff "
        f"from samples) g where diff>{gap} union all select server_id, min(date) from samples group by server_id) u group by server_id"
    )


@query("tps_18_latest_start", start_sql(GAP))
def _(d):
    return tps.latest_start(d.samples, GAP)


UP_NOW = NOW - HOUR // 2


@query("tps_19_current_uptime", f"""select l.server_id, {UP_NOW}-start uptime from (select server_id, max(date) last from samples group by server_id) l
 join ({start_sql(GAP)}) s on s.server_id=l.server_id where {UP_NOW}-last<={GAP}""")
def _(d):
    return tps.current_uptime(d.samples, UP_NOW, GAP)


@query("tps_20_share_above", f"select server_id, count(*) filter (where tps>=15)/count(*) as share from samples where {IN} group by server_id", doubles="share")
def _(d):
    return tps.share_above(d.samples, 15, A, B)


@query("tps_21_averages_by_sample", _averages_sql(IN), doubles=AVG_COLS)
def _(d):
    return tps.averages(d.samples, A, B, closed=True)


@query("tps_22_low_tps_insights", f"""select server_id, avg(players_online) low_tps_players, avg(tps) filter (where tps>=0) low_tps_tps,
 avg(cpu_usage) filter (where cpu_usage>=0) low_tps_cpu, avg(entities) low_tps_entities, avg(chunks_loaded) low_tps_chunks, avg(mspt_average) low_tps_mspt
 from samples where {IN} and tps>-1 and tps<{LOW} group by server_id""",
    doubles="low_tps_players low_tps_tps low_tps_cpu low_tps_entities low_tps_chunks low_tps_mspt")
def _(d):
    return tps.low_tps_insights(d.samples, A, B, LOW)


def numbers_sql(group="server_id", windows=tps.WINDOWS):
    cols = []
    for t, span in windows.items():
        f = f"date>={NOW - span}"

        def mean(c):
            return f"coalesce(avg({c}) filter (where {f} and {c}>=0),-1)"

        cols += [
            f"cast(floor({mean('players_online')}) as bigint) players_{t}", f"{mean('tps')} tps_{t}", f"{mean('cpu_usage')} cpu_{t}",
            f"{mean('ram_usage')} ram_{t}", f"cast(floor({mean('entities')}) as bigint) entities_{t}",
            f"cast(floor({mean('chunks_loaded')}) as bigint) chunks_{t}",
            f"coalesce(max(free_disk_space) filter (where {f} and free_disk_space>=0),-1) max_disk_{t}",
            f"coalesce(min(free_disk_space) filter (where {f} and free_disk_space>=0),-1) min_disk_{t}", f"{mean('mspt_average')} mspt_average_{t}",
        ]
    head = f"{group}, " if group else ""
    tail = f"group by {group}" if group else ""
    return f"select {head}{', '.join(cols)} from samples where date between {NOW - max(windows.values())} and {NOW} {tail}"


def window_gap_sql(t, span):
    return f"""select server_id, cast(coalesce(sum(diff) filter (where diff>180000),0) as bigint) server_downtime_{t},
 cast(coalesce(sum(diff) filter (where diff<120000),0) as bigint) server_uptime_{t} from (
 {DIFF.format(k='server_id,', p='partition by server_id', w=f'date between {NOW - span} and {NOW}')}) q group by server_id"""


def window_spike_sql(t, span):
    return f"""select server_id, count(*) filter (where l and not coalesce(pl,false)) low_tps_spikes_{t} from (
 select *, lag(l) over (partition by server_id order by date) pl from (select *, tps>=0 and tps<{LOW} l from (
 {POINTS.format(w=f'date between {NOW - span} and {NOW}')}) x) z) y group by server_id"""


def performance_sql():
    sql = f"select * from ({numbers_sql()}) n"
    for t, span in tps.WINDOWS.items():
        sql += f" left join ({window_gap_sql(t, span)}) g{t} using (server_id) left join ({window_spike_sql(t, span)}) s{t} using (server_id)"
    return sql


NUMBER_DOUBLES = " ".join(f"{c}_{t}" for t in tps.WINDOWS for c in ("tps", "cpu", "ram", "mspt_average"))


@query("tps_23_performance_numbers", performance_sql(), doubles=NUMBER_DOUBLES)
def _(d):
    return tps.performance_numbers(d.samples, NOW, LOW)


@query("tps_24_metric_series", f"select server_id, date, cpu_usage y from samples where {IN} and cpu_usage<>-1")
def _(d):
    return tps.metric_series(d.samples, "cpu_usage", A, B)
