from pyspark.sql import Window
from pyspark.sql import functions as F

from arenalytics.functions import clock, ordered, stats
from arenalytics.functions import windows as W
from arenalytics.operators import activity as act
from arenalytics.operators import samples as tps
from arenalytics.operators import series as ser
from catalog import query
from catalog.activity import GROUP_SQL, all_index_sql
from catalog.domain import A, B, DAY, NOW, THRESHOLD

HOUR, MINUTE = 3600000, 60000


@query("win_1_lag", """select server_id, date, lag(date) over (partition by server_id order by date) prev_date, lag(p) over (partition by server_id order by date) prev_players
 from (select server_id, date, max_by(players_online, id) p from samples group by 1,2) x""")
def _(d):
    points = d.samples.groupBy("server_id", "date").agg(F.max_by("players_online", "id").alias("p"))
    return ordered.with_previous(points, ["server_id"], "date", ["p"]).select(
        "server_id", "date", F.col("prev.date").alias("prev_date"), F.col("prev.p").alias("prev_players")
    )


@query("win_2_running_sum", """select server_id, date, cast(sum(n) over (partition by server_id order by date rows unbounded preceding) as bigint) busy
 from (select server_id, date, count(*) filter (where players_online>0) n from samples group by 1,2) x""")
def _(d):
    return ordered.running_total(d.samples, ["server_id"], "date", {"busy": F.when(F.col("players_online") > 0, 1).otherwise(0)}, clock.HOUR)


@query("win_3_row_number", """select server_id, id, cast(rn as int) rn from (select *, row_number() over (partition by server_id order by players_online desc, date desc, id desc) rn from samples) x where rn<=5""")
def _(d):
    order = Window.partitionBy("server_id").orderBy(F.col("players_online").desc(), F.col("date").desc(), F.col("id").desc())
    return d.samples.select("server_id", "id", F.row_number().over(order).alias("rn")).where("rn <= 5")


@query("srt_1_limit_offset", "select id, session_start from sessions order by session_start desc, id limit 25 offset 50")
def _(d):
    return d.sessions.select("id", "session_start").orderBy(F.col("session_start").desc(), "id").offset(50).limit(25)


@query("set_1_weekly_union", f"""select user_id, cast(sum(a) as bigint) active from ({' union all '.join(
    f"select user_id, session_end-session_start-afk_time a from sessions where session_end>={B - (w + 1) * 7 * DAY} and session_start<={B - w * 7 * DAY}" for w in range(3))}) x group by user_id""")
def _(d):
    return act.weekly_active(d.sessions, B).select("user_id", (F.col("w0") + F.col("w1") + F.col("w2")).alias("active"))


@query("set_2_union_distinct", "select user_id from ping union select user_id from geolocations")
def _(d):
    return d.ping.select("user_id").unionByName(d.geolocations.select("user_id")).distinct()


@query("set_3_intersect", "select user_id from user_info where opped intersect select user_id from geolocations where geolocation='NATION_2'")
def _(d):
    return d.user_info.where("opped").select("user_id").distinct().join(d.geolocations.where("geolocation = 'NATION_2'"), "user_id", "left_semi")


@query("set_5_except", "select distinct user_id from geolocations except select user_id from user_info where banned")
def _(d):
    return d.geolocations.select("user_id").distinct().join(d.user_info.where("banned"), "user_id", "left_anti")


@query("agg_grouping_sets", f"""select server_id, count(distinct user_id) players, count(*) sessions from sessions where session_end<={B} and session_start>={A}
 group by grouping sets ((server_id), ())""")
def _(d):
    return d.sessions.where(W.contained(A, B)).rollup("server_id").agg(F.countDistinct("user_id").alias("players"), F.count("*").alias("sessions"))


@query("clk_1_clock_segments", f"""with c as (select session_start%{DAY} t, 1 n from sessions union all select session_end%{DAY}, -1 from sessions),
 g as (select t, sum(n) n from c group by t), r as (select t, sum(n) over (order by t) lvl from g)
 select coalesce(lag(t) over (order by t),0) start, t "end", cast(coalesce(lag(lvl) over (order by t),0) as bigint) sessions from r""")
def _(d):
    return ser.clock_segments(d.sessions)


@query("gap_1_fill_missing", f"""with p as (select server_id, session_start-session_start%{HOUR} date, count(*) n from sessions group by 1,2),
 l as (select *, coalesce(lead(date) over (partition by server_id order by date), {NOW + DAY}) nx from p)
 select server_id, date, n from p union all select server_id, t, 0 from (select server_id, unnest(generate_series(date+{HOUR}, nx-1, {HOUR})) t from l where nx-date>{HOUR}) g""")
def _(d):
    points = d.sessions.groupBy("server_id", clock.hour("session_start").alias("date")).agg(F.count("*").alias("n"))
    return ser.fill_missing(points, ["server_id"], "date", "n", HOUR, NOW + DAY)


@query("gap_2_gap_markers", f"""with l as (select server_id, date, lead(date) over (partition by server_id order by date) nx from (select distinct server_id, date from samples) x)
 select server_id, unnest(generate_series(date+{MINUTE}, nx-1, {30 * MINUTE})) date from l where nx-date>{3 * MINUTE}""")
def _(d):
    return ser.gap_markers(d.samples, ["server_id"], "date")


@query("pch_1_punch_card", f"""with c as (select cast(floor(((session_start+{HOUR}+3*{DAY})%(7*{DAY}))/{DAY}) as int) d, cast(floor(((session_start+{HOUR})%{DAY})/{HOUR}) as int) h, count(*) n
 from sessions group by 1,2), s as (select cast(d as int) d, cast(h as int) h from range(7) a(d), range(24) b(h)),
 f as (select s.d, s.h, coalesce(n,0) n from s left join c on c.d=s.d and c.h=s.h), z as (select *, cast(floor(n*10.0/greatest(max(n) over (),1)) as int) v from f)
 select d "day", h "hour", h*{HOUR} x, n, case when v<>0 then v+4 else 0 end z from z""")
def _(d):
    return ser.punch_card(d.sessions, HOUR)


@query("pch_2_date_parts", f"""select id, cast(floor((session_start+{HOUR})/{DAY})*{DAY} as bigint) "day", cast(floor((session_start+{HOUR})/{HOUR})*{HOUR} as bigint) "hour",
 cast(isodow(make_timestamp((session_start+{HOUR})*1000))-1 as int) weekday, cast(hour(make_timestamp((session_start+{HOUR})*1000)) as int) hour_of_day from sessions""")
def _(d):
    return d.sessions.select(
        "id", clock.day("session_start", HOUR).alias("day"), clock.hour("session_start", HOUR).alias("hour"),
        clock.day_of_week("session_start", HOUR).alias("weekday"), clock.hour_of_day("session_start", HOUR).alias("hour_of_day"),
    )


@query("fn_1_ratio_and_trend", f"""with c as (select server_id, count(*) filter (where session_start<{(A + B) // 2}) b, count(*) filter (where session_start>={(A + B) // 2}) a, sum(afk_time) afk,
 sum(session_end-session_start) len from sessions where session_start>={A} and session_start<{B} group by 1)
 select server_id, abs(a-b) sessions_trend, case when a>b then '+' when a<b then '-' end sessions_direction, afk/len share, cast(len//(a+b) as bigint) mean_length from c""", doubles="share")
def _(d):
    half = (A + B) // 2
    c = d.sessions.where(W.start_in(A, B)).groupBy("server_id").agg(
        F.count_if(F.col("session_start") < half).alias("b"), F.count_if(F.col("session_start") >= half).alias("a"),
        F.sum("afk_time").alias("afk"), F.sum(W.length()).alias("len"),
    )
    return c.select(
        "server_id", *stats.trend_columns("sessions", F.col("b"), F.col("a")), stats.ratio(F.col("afk"), F.col("len")).alias("share"),
        stats.int_ratio(F.col("len"), F.col("a") + F.col("b")).alias("mean_length"),
    )


@query("udf_5_percentile_rank", """select server_id, len percentile from (select server_id, session_end-session_start len, row_number() over (partition by server_id
 order by session_end-session_start)-1 i, count(*) over (partition by server_id) n from sessions) x where i=cast(floor(n*0.95) as bigint)-1 and i>0""")
def _(d):
    lengths = d.sessions.select("server_id", W.length().alias("len"))
    return stats.ranked_percentile(lengths, ["server_id"], "len", 0.95, width=MINUTE)


@query("udf_5_jitter", """with p as (select server_id, date, max(mspt_average) m from samples where mspt_average is not null group by 1,2)
 select server_id, avg(j) jitter_average, max(j) jitter_max from (select server_id, abs(m-lag(m) over (partition by server_id order by date)) j from p) x group by 1""", doubles="jitter_average jitter_max")
def _(d):
    return tps.tick_jitter(d.samples)


@query("udf_5_quantile", "select server_id, quantile_cont(v100, 0.9) q from ev group by server_id", doubles="q")
def _(d):
    return stats.grouped_quantile(d.ev, ["server_id"], "v100", 0.9, width=100, into="q")


@query("udf_3_free_sql", "select u.name, count(*) kills from kills k join users u on u.uuid=k.killer_uuid group by u.name")
def _(d):
    from arenalytics.plans.queries import run_sql

    return run_sql(d.spark, "select u.name, count(*) kills from {kills} k join {users} u on u.uuid = k.killer_uuid group by u.name", kills=d.kills, users=d.users)


@query("udf_4_common_queries", f"""with i as ({all_index_sql(B, False)}), s as (select user_id, cast(sum(least(session_end,{B})-greatest(session_start,{A})) filter (where session_end>={A} and session_start<={B}) as bigint) p,
 max(session_end) l from sessions group by 1)
 select u.uuid, u.name, coalesce(p,0) playtime, l last_seen, activity_index, {GROUP_SQL} activity_group from users u join s on s.user_id=u.id join i on i.user_id=u.id""", doubles="activity_index")
def _(d):
    from arenalytics.plans.queries import common_queries

    return common_queries(d.users, d.sessions, A, B, THRESHOLD)
