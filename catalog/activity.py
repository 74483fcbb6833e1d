from pyspark.sql import functions as F

from arenalytics.operators import activity as act
from catalog import query
from catalog.domain import A, B, NOW, THRESHOLD, WEEK


def index_sql(date, closed, where="", keys="user_id"):
    """Independent form: one relation per week, united and averaged."""
    op = "<=" if closed else "<"
    parts = " union all ".join(
        f"select {keys}, {w} wk, session_end-session_start-afk_time act from sessions "
        f"where session_end>={date - (w + 1) * WEEK} and session_start{op}{date - w * WEEK} {where}"
        for w in range(3)
    )
    return (
        f"select {keys}, sum(t) s3, count(*) n from (select {keys}, wk, 1/(pi()/2*(sum(act)/{THRESHOLD})+1) t from ({parts}) p "
        f"group by {keys}, wk) q group by {keys}"
    )


def all_index_sql(date, closed, base="select id user_id, registered from users", where=""):
    return (
        f"select b.user_id, b.registered, 5-5*((coalesce(i.s3,0)+3-coalesce(i.n,0))/3) activity_index "
        f"from ({base}) b left join ({index_sql(date, closed, where)}) i on i.user_id=b.user_id"
    )


GROUP_SQL = (
    "case when activity_index<1 then 'Inactive' when activity_index<2 then 'Irregular' when activity_index<3 then 'Regular' "
    "when activity_index<3.75 then 'Active' else 'Very Active' end"
)
S2 = "select user_id, min(registered) registered from user_info where server_id in (1,2) group by user_id"
W2 = "and server_id in (1,2)"


@query(
    "act_1_index_per_server",
    f"""select u.server_id, u.user_id, 5-5*((coalesce(i.s3,0)+3-coalesce(i.n,0))/3) activity_index from user_info u
    left join ({index_sql(B, True, keys='server_id, user_id')}) i on i.user_id=u.user_id and i.server_id=u.server_id""",
    doubles="activity_index",
)
def _(d):
    return act.activity_index_per_server(d.sessions, d.user_info, B, THRESHOLD)


@query("act_2_index_network", f"select user_id, activity_index from ({all_index_sql(B, True)}) x", doubles="activity_index")
def _(d):
    return act.activity_index(d.sessions, act.base_users(d.users, None, None, None), B, THRESHOLD)


@query(
    "act_3_index_multi_server",
    f"select user_id, activity_index from ({all_index_sql(NOW, False, S2, W2)}) x where registered<={NOW}",
    doubles="activity_index",
)
def _(d):
    base = act.base_users(d.users, d.user_info, [1, 2], NOW)
    return act.activity_index(d.sessions, base, NOW, THRESHOLD, [1, 2], closed=False)


@query(
    "act_4_classified",
    f"select user_id, {GROUP_SQL} activity_group from ({all_index_sql(B, False)}) x where registered<={B}",
)
def _(d):
    index = act.activity_index(d.sessions, act.base_users(d.users, None, None, B), B, THRESHOLD, closed=False)
    return index.select("user_id", act.activity_group().alias("activity_group"))


@query(
    "act_5_group_counts",
    f"select {GROUP_SQL} activity_group, count(*) players from ({all_index_sql(NOW, False)}) x where registered<={NOW} group by 1",
)
def _(d):
    return act.group_counts(act.activity_index(d.sessions, act.base_users(d.users, None, None, NOW), NOW, THRESHOLD, closed=False))


@query(
    "act_5_group_counts_multi_server",
    f"select {GROUP_SQL} activity_group, count(*) players from ({all_index_sql(B, False, S2, W2)}) x where registered<={B} group by 1",
)
def _(d):
    base = act.base_users(d.users, d.user_info, [1, 2], B)
    return act.group_counts(act.activity_index(d.sessions, base, B, THRESHOLD, [1, 2], closed=False))


@query(
    "act_5_regular_players",
    f"select count(*) players from ({all_index_sql(B, True)}) x where registered<={B} and activity_index>=2 and activity_index<5.1",
)
def _(d):
    index = act.activity_index(d.sessions, act.base_users(d.users, None, None, B), B, THRESHOLD)
    return act.count_within(index, *act.REGULAR_RANGE)


@query(
    "act_5_group_counts_of_users",
    f"""select {GROUP_SQL} activity_group, count(*) players from ({all_index_sql(B, True)}) x
    where user_id in (select user_id from geolocations where geolocation in ('NATION_1','NATION_2')) group by 1""",
)
def _(d):
    chosen = d.geolocations.where(F.col("geolocation").isin("NATION_1", "NATION_2")).select("user_id").distinct()
    base = act.base_users(d.users, None, None, None).join(chosen, "user_id", "left_semi")
    return act.group_counts(act.activity_index(d.sessions, base, B, THRESHOLD))


REG = f"select user_id from ({all_index_sql(B, True)}) x where activity_index>=2 and activity_index<5.1"
IN = f"session_start>={A} and session_end<={B}"


def _index(d):
    return act.activity_index(d.sessions, act.base_users(d.users, None, None, None), B, THRESHOLD)


@query(
    "act_6_playtime_per_regular",
    f"""select avg(p) average_playtime from (select sum(session_end-session_start) p from sessions
    where {IN} and user_id in ({REG}) group by user_id) t""",
    doubles="average_playtime",
)
def _(d):
    return act.playtime_per_regular(d.sessions, _index(d), A, B)


@query(
    "act_7_session_length_of_regulars",
    f"select avg(session_end-session_start) average_length from sessions where {IN} and user_id in ({REG})",
    doubles="average_length",
)
def _(d):
    return act.session_length_of_regulars(d.sessions, _index(d), A, B)


@query(
    "act_8_afk_per_regular",
    f"select avg(p) average_afk from (select sum(afk_time) p from sessions where {IN} and user_id in ({REG}) group by user_id) t",
    doubles="average_afk",
)
def _(d):
    return act.afk_per_regular(d.sessions, _index(d), A, B)


@query(
    "act_9_new_turned_regular",
    f"select count(*) players from ({all_index_sql(B, True)}) x where registered between {A} and {B} and activity_index>=2",
)
def _(d):
    return act.new_turned_regular(d.sessions, act.base_users(d.users, None, None, None), A, B, THRESHOLD)


@query(
    "act_10_regular_turned_inactive",
    f"""select count(*) players from ({all_index_sql(B, True)}) s join ({all_index_sql(NOW + 20 * WEEK // 7, True)}) e
    on e.user_id=s.user_id where s.activity_index>=2 and s.activity_index<5.1 and e.activity_index>=-0.1 and e.activity_index<1""",
)
def _(d):
    base = act.base_users(d.users, None, None, None)
    return act.regular_turned_inactive(d.sessions, base, B, NOW + 20 * WEEK // 7, THRESHOLD)


@query(
    "act_11_index_of_new_players",
    f"select user_id, activity_index from ({all_index_sql(B, True)}) x where registered between {A} and {B}",
    doubles="activity_index",
)
def _(d):
    return act.index_of_new_players(d.sessions, act.base_users(d.users, None, None, None), A, B, THRESHOLD)


HALF = NOW - (NOW - A) // 2


@query(
    "act_12_retained_index_averages",
    f"""select avg(case when l then activity_index end) retained, avg(case when not l then activity_index end) non_retained from (
    select x.*, user_id in (select user_id from sessions where session_start>={HALF} and session_end<={NOW}) l
    from ({all_index_sql(NOW, True)}) x where registered between {A} and {NOW}) y""",
    doubles="retained non_retained",
)
def _(d):
    return act.retained_index_averages(d.sessions, act.base_users(d.users, None, None, None), A, NOW, THRESHOLD)


SERIES = " union all ".join(
    f"select cast({NOW - k * WEEK} as bigint) date, {GROUP_SQL} activity_group, user_id, activity_index from "
    f"({all_index_sql(NOW - k * WEEK, False)}) x{k} where registered<={NOW - k * WEEK}"
    for k in range(9)
)


@query("act_13_weekly_group_counts", f"select date, activity_group, count(*) players from ({SERIES}) y group by date, activity_group")
def _(d):
    return act.weekly_group_counts(d.sessions, act.base_users(d.users, None, None, None), NOW, 8, THRESHOLD)


@query(
    "act_14_group_stack",
    "select date, "
    + ", ".join(f"count(*) filter (where activity_group='{g}') \"{g}\"" for g in act.GROUPS)
    + f" from ({SERIES}) y group by date",
)
def _(d):
    return act.group_stack(act.weekly_group_counts(d.sessions, act.base_users(d.users, None, None, None), NOW, 8, THRESHOLD))


@query(
    "act_16_active_users",
    f"select user_id from ({all_index_sql(B, True)}) x where registered<={B} and activity_index>=3",
)
def _(d):
    return act.active_users(act.activity_index(d.sessions, act.base_users(d.users, None, None, B), B, THRESHOLD), 3.0)


@query("act_16_users_per_weekly_group", f"select date, activity_group, user_id from ({SERIES}) y")
def _(d):
    indexes = act.weekly_indexes(d.sessions, act.base_users(d.users, None, None, None), NOW, 8, THRESHOLD)
    return indexes.select("date", act.activity_group().alias("activity_group"), "user_id")


@query(
    "act_15_index_distance",
    f"""select a.user_id, abs(ln(a.activity_index)-ln(b.activity_index)) distance from ({all_index_sql(B, True)}) a
    join ({all_index_sql(NOW, True)}) b on a.user_id=b.user_id where a.activity_index>0.000001 and b.activity_index>0.000001""",
    doubles="distance",
)
def _(d):
    base = act.base_users(d.users, None, None, None)
    first = act.activity_index(d.sessions, base, B, THRESHOLD).withColumnRenamed("activity_index", "a")
    second = act.activity_index(d.sessions, base, NOW, THRESHOLD).withColumnRenamed("activity_index", "b")
    both = first.join(second, "user_id").where((F.col("a") > 1e-6) & (F.col("b") > 1e-6))
    return both.select("user_id", act.index_distance("a", "b").alias("distance"))
