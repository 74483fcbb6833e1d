from pyspark.sql import functions as F

from arenalytics.operators import activity as act
from arenalytics.operators import join_address as ja
from arenalytics.operators import retention as ret
from catalog import query
from catalog.activity import all_index_sql
from catalog.domain import A, B, DAY, NOW, T0, THRESHOLD, WEEK

HOUR = 3600000
BASE = """select u.id user_id, u.registered, max(session_end) last_seen, cast(sum(session_end-session_start) as bigint) playtime,
 max(session_end)-u.registered time_difference from users u join sessions s on s.user_id=u.id group by 1,2"""
WEEKS = "concat(cast(year(make_timestamp(registered*1000)) as varchar),'-week-',cast(cast(ceil(dayofyear(make_timestamp(registered*1000))/7) as int) as varchar))"


def _base(d):
    people = d.users.select(F.col("id").alias("user_id"), "registered")
    return ret.retention_base(people, d.sessions)


def _cohorts(d, kind="weeks"):
    return ret.registered_after(_base(d), T0 + DAY).withColumn("cohort", ret.cohort(kind))


COHORTS = f"select *, {WEEKS} cohort from ({BASE}) b where registered>{T0 + DAY}"


@query("ret_1_base_network", BASE)
def _(d):
    return _base(d)


@query("ret_1_base_server", """select i.user_id, i.server_id, i.registered, max(session_end) last_seen, cast(sum(session_end-session_start) as bigint) playtime,
 max(session_end)-i.registered time_difference from user_info i join sessions s on s.user_id=i.user_id and s.server_id=i.server_id group by 1,2,3""")
def _(d):
    return ret.retention_base(d.user_info, d.sessions, ("user_id", "server_id"))


@query("ret_2_cohorts", f"""select user_id, strftime(make_timestamp(registered*1000),'%Y-%m-%d') by_day, {WEEKS} by_week,
 strftime(make_timestamp(registered*1000),'%Y-%m') by_month, cast(year(make_timestamp(registered*1000)) as varchar) by_year, 'all' by_none from ({BASE}) b""")
def _(d):
    kinds = {"by_day": "days", "by_week": "weeks", "by_month": "months", "by_year": "years", "by_none": "none"}
    return _base(d).select("user_id", *[ret.cohort(k).alias(n) for n, k in kinds.items()])


@query("ret_2_address_cohorts", f"""with a as (select user_id, join_address from (select s.user_id, j.join_address, rank() over (partition by s.user_id order by session_start desc) r
 from sessions s join join_address j on j.id=s.join_address_id) x where r=1),
 g as (select * from (values ('play','play.a.com'),('play','play.b.com:25565'),('any','play.a.com'),('any','unknown'),('any','MC.B.com')) v(cohort, join_address))
 select g.cohort, b.user_id, b.registered from ({BASE}) b join a on a.user_id=b.user_id join g on g.join_address=a.join_address""")
def _(d):
    rows = [("play", "play.a.com"), ("play", "play.b.com:25565"), ("any", "play.a.com"), ("any", "unknown"), ("any", "MC.B.com")]
    groups = d.spark.createDataFrame(rows, "cohort string, join_address string")
    addresses = ja.latest_of_users(d.sessions, d.join_address).select("user_id", "join_address")
    return ret.by_address_group(_base(d), addresses, groups).select("cohort", "user_id", "registered")


def _curve_sql(measure, step):
    return f"""with c as ({COHORTS}), z as (select cohort, count(*) total, max({measure}) top from c group by cohort),
 p as (select cohort, total, unnest(generate_series(0, cast(ceil(top/{step}) as bigint))) step from z where top>0)
 select p.cohort, step, count(c.user_id) filter (where c.{measure}>step*{step}) players,
 count(c.user_id) filter (where c.{measure}>step*{step})*100.0/any_value(total) as percent from p join c on c.cohort=p.cohort group by p.cohort, step"""


@query("ret_3_curve_by_time", _curve_sql("time_difference", DAY), doubles="percent")
def _(d):
    return ret.curve_by_time(_cohorts(d), DAY)


@query("ret_4_curve_by_playtime", _curve_sql("playtime", HOUR), doubles="percent")
def _(d):
    return ret.curve_by_playtime(_cohorts(d), HOUR)


DATES = f"""with c as ({COHORTS}), z as (select cohort, count(*) total, min(registered)-min(registered)%{DAY} origin from c group by cohort),
 p as (select cohort, total, unnest(generate_series(origin, {NOW + 10 * DAY}-1, {DAY})) date from z)"""


@query("ret_5_curve_by_date", f"""{DATES}, n as (select p.cohort, date, count(*) filter (where c.last_seen>=date) players, any_value(total) total
 from p join c on c.cohort=p.cohort group by p.cohort, date), s as (select cohort, min(date) stop from n where players=0 group by cohort)
 select n.cohort, date, players, players*100.0/total as percent from n left join s on s.cohort=n.cohort where stop is null or date<=stop""", doubles="percent")
def _(d):
    return ret.curve_by_date(_cohorts(d), NOW + 10 * DAY)


@query("ret_6_alive_by_date", f"""{DATES}, n as (select p.cohort, date, count(*) filter (where c.registered<=date and c.last_seen>=date) players, any_value(total) total
 from p join c on c.cohort=p.cohort group by p.cohort, date),
 s as (select cohort, min(date) stop from n where players=0 and exists (select 1 from n m where m.cohort=n.cohort and m.date=n.date-{DAY} and m.players=0)
 and exists (select 1 from n m where m.cohort=n.cohort and m.date<n.date and m.players>0) group by cohort)
 select n.cohort, date, players, players*100.0/total as percent from n left join s on s.cohort=n.cohort where stop is null or date<=stop""", doubles="percent")
def _(d):
    return ret.alive_by_date(_cohorts(d), NOW + 10 * DAY)


@query("ret_7_recent_hourly_curve", f"""with c as (select *, 'all' cohort from ({BASE}) b where registered>{NOW - 14 * DAY}),
 p as (select unnest(generate_series(0, cast(ceil(max(time_difference)/{HOUR}) as bigint))) step from c)
 select 'all' cohort, step, (select count(*) from c where time_difference>step*{HOUR}) players,
 (select count(*) from c where time_difference>step*{HOUR})*100.0/(select count(*) from c) as percent from p""", doubles="percent")
def _(d):
    base = ret.registered_after(_base(d), NOW - 14 * DAY).withColumn("cohort", ret.cohort("none"))
    return ret.curve_by_time(base, HOUR)


@query("ret_8_retained_in_both_halves", f"""with w as (select id, greatest({A},registered) s, greatest({A},registered)+({B}-greatest({A},registered))//2 h from users)
 select id user_id from w where exists (select 1 from sessions x where x.user_id=w.id and session_end>=s and session_start<=h)
 and exists (select 1 from sessions x where x.user_id=w.id and session_end>=h and session_start<={B})""")
def _(d):
    return ret.retained_in_both_halves(d.users, d.sessions, A, B)


HALF_MONTH, MONTH = 15 * DAY, 30 * DAY
FEATURES = f"""with o as (select server_id, date, max_by(players_online, id) p from samples group by 1,2),
 h as (select user_id, server_id home from (select *, row_number() over (partition by user_id order by session_start, id) r from sessions) z where r=1),
 k as (select u.id user_id, u.registered, h.home from users u left join h on h.user_id=u.id),
 j as (select k.user_id, k.registered, o.p from k asof left join o on o.server_id=k.home and o.date<=k.registered),
 s as (select x.*, u.registered from sessions x join users u on u.id=x.user_id),
 w as (select user_id, sum(1/(pi()/2*(t/{THRESHOLD})+1)) s3, count(*) n from (select user_id, k, sum(session_end-session_start-afk_time) t from s
 join (select unnest([0,1,2]) k) kk on session_end>=registered+{DAY}-(k+1)*{WEEK} and session_start<=registered+{DAY}-k*{WEEK} group by 1,2) q group by 1),
 r as (select user_id, bool_or(session_end>=registered and session_start<=registered+{HALF_MONTH}) and
 bool_or(session_end>=registered+{HALF_MONTH} and session_start<=registered+{MONTH}) retained from s group by 1),
 f as (select j.user_id, j.registered, 5-5*((coalesce(s3,0)+3-coalesce(n,0))/3) activity_index, cast(coalesce(p,-1) as double) online_on_join, coalesce(retained,false) retained
 from j left join w on w.user_id=j.user_id left join r on r.user_id=j.user_id)"""


def _features(d):
    return ret.first_day_features(d.users, d.sessions, d.samples, THRESHOLD)


@query("ret_9_first_day_features", f"select * from ({FEATURES} select * from f) y", doubles="activity_index")
def _(d):
    return _features(d)


@query("ret_9_likely_retained", f"""{FEATURES}, c as (select avg(activity_index) filter (where retained) ri, avg(online_on_join) filter (where retained) ro,
 avg(activity_index) filter (where not retained) ni, avg(online_on_join) filter (where not retained) no from f where registered<={T0 + 16 * DAY})
 select user_id from f join c on true where registered>{T0 + 16 * DAY} and
 abs(ri-activity_index)*2+case when online_on_join<>-1 then abs(ro-online_on_join)/10 else 0 end <
 abs(ni-activity_index)*2+case when online_on_join<>-1 then abs(no-online_on_join)/10 else 0 end""")
def _(d):
    features = _features(d)
    return ret.likely_retained(features, features.where(F.col("registered") > T0 + 16 * DAY), T0 + 16 * DAY)


LATE = T0 + 24 * DAY


@query("ret_10_predicted_retained", f"""with x as (select *, user_id in (select user_id from sessions where session_start>={NOW - (NOW - A) // 2} and session_end<={NOW}) l
 from ({all_index_sql(NOW, True)}) i where registered between {A} and {NOW}), c as (select avg(activity_index) filter (where l) r, avg(activity_index) filter (where not l) n from x)
 select count(*) filter (where abs(ln(activity_index)-ln(r))<abs(ln(activity_index)-ln(n))) players from ({all_index_sql(NOW, True)}) y join c on true
 where registered between {B - 7 * DAY} and {NOW}""")
def _(d):
    base = act.base_users(d.users, None, None, None)
    averages = act.retained_index_averages(d.sessions, base, A, NOW, THRESHOLD)
    return ret.predicted_retained(act.index_of_new_players(d.sessions, base, B - 7 * DAY, NOW, THRESHOLD), averages)
