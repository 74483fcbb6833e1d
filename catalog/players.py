from pyspark.sql import functions as F

from arenalytics.functions.clock import DAY, HOUR
from arenalytics.operators import players as pc
from arenalytics.session import shared_folder
from catalog import query
from catalog.domain import A, B, NOW

INSIDE = f"session_end<={B} and session_start>={A}"
OFF = 2 * HOUR


def _bucket(c, width):
    return f"cast(floor(({c}+{OFF})/{width})*{width} as bigint)"


@query("pc_1_unique_players", f"select count(distinct user_id) players from sessions where {INSIDE} and server_id in (2,3)")
def _(d):
    return pc.unique_players(d.sessions, A, B, [2, 3])


@query("pc_1_unique_players_per_server", f"select server_id, count(distinct user_id) players from sessions where {INSIDE} group by server_id")
def _(d):
    return pc.unique_players(d.sessions, A, B, by=["server_id"])


@query("pc_2_unique_per_day", f"select {_bucket('session_start', DAY)} date, count(distinct user_id) players from sessions where {INSIDE} group by 1")
def _(d):
    return pc.unique_players_per_bucket(d.sessions, A, B, DAY, OFF)


@query("pc_2_unique_per_hour", f"select server_id, {_bucket('session_start', HOUR)} date, count(distinct user_id) players from sessions where {INSIDE} group by 1,2")
def _(d):
    return pc.unique_players_per_bucket(d.sessions, A, B, HOUR, OFF, by=["server_id"])


PERIODS = (("hour", HOUR), ("day", DAY), ("week", 7 * DAY), ("month", 30 * DAY))


@query("pc_2_unique_rollup", " union all ".join(f"select '{n}' period, {_bucket(_bucket('session_start', HOUR) + f'-{OFF}', w)} date, count(distinct user_id) players from sessions where {INSIDE} group by 2" for n, w in PERIODS))
def _(d):
    return pc.unique_rollup(pc.unique_cells(d.sessions, A, B, OFF))


@query("pc_2_unique_rollup_per_server", " union all ".join(f"select server_id, '{n}' period, {_bucket('session_start', w)} date, count(distinct user_id) players from sessions where {INSIDE} group by 1,3" for n, w in PERIODS))
def _(d):
    """Cells stored in two parts, as by two runs, and merged."""
    folder = shared_folder(d.spark, "unique-cells")
    for odd in (0, 1):
        cells = pc.unique_cells(d.sessions.where(F.col("id") % 2 == odd), A, B, OFF, by=["server_id"])
        cells.write.mode("append").parquet(folder)
    return pc.unique_rollup(d.spark.read.parquet(folder), by=["server_id"])


@query("pc_3_average_unique", f"""select server_id, avg(n) average_players from (select server_id, {_bucket('session_start', DAY)} dt, count(distinct user_id) n
 from sessions where {INSIDE} group by 1,2) x group by server_id""", doubles="average_players")
def _(d):
    return pc.average_unique_players(d.sessions, A, B, OFF, by=["server_id"])


@query("pc_4_new_players", f"select count(*) players from users where registered between {A} and {B}")
def _(d):
    return pc.new_players(d.users, A, B)


@query("pc_4_new_players_per_server", f"select server_id, count(*) players from user_info where registered between {A} and {B} group by server_id")
def _(d):
    return pc.new_players(d.user_info, A, B, by=["server_id"])


@query("pc_5_new_per_day", f"select {_bucket('registered', DAY)} date, count(*) players from users where registered between {A} and {B} group by 1")
def _(d):
    return pc.new_players_per_bucket(d.users, A, B, DAY, OFF)


@query("pc_5_new_per_hour", f"select server_id, {_bucket('registered', HOUR)} date, count(*) players from user_info where registered between {A} and {B} group by 1,2")
def _(d):
    return pc.new_players_per_bucket(d.user_info, A, B, HOUR, OFF, by=["server_id"])


@query("pc_6_average_new", f"""select avg(n) average_players from (select {_bucket('registered', DAY)} dt, count(*) n from users
 where registered between {A} and {B} group by 1) x""", doubles="average_players")
def _(d):
    return pc.average_new_players(d.users, A, B, OFF, user="id")


@query("pc_6_average_new_of_servers", f"""select avg(n) average_players from (select {_bucket('registered', DAY)} dt, count(distinct user_id) n from user_info
 where registered between {A} and {B} and server_id in (1,4) group by 1) x""", doubles="average_players")
def _(d):
    return pc.average_new_players(d.user_info, A, B, OFF, [1, 4])


HALF = B - (B - A) // 2


@query("pc_7_retained_players", f"""select s.server_id, count(distinct s.user_id) players from sessions s join user_info u on u.user_id=s.user_id
 and u.server_id=s.server_id where registered>={A} and registered<={B} and session_start>={HALF} and session_end<={B} group by s.server_id""")
def _(d):
    return pc.retained_players(d.user_info, d.sessions, A, B, by=["server_id"])


@query("pc_8_operators", "select server_id, count(*) filter (where opped) operators from user_info group by server_id")
def _(d):
    return pc.operator_count(d.user_info)


@query("pc_9_user_counts", "select server_id, count(distinct user_id) users from user_info group by server_id union all select null, count(*) from users")
def _(d):
    total = d.users.agg(F.lit(None).cast("int").alias("server_id"), F.count(F.lit(1)).alias("users"))
    return pc.user_counts(d.user_info, ["server_id"]).unionByName(total)


@query("pc_10_first_register_date", "select min(registered) registered from users")
def _(d):
    return pc.first_register_date(d.users)


@query("pc_11_register_dates", f"select user_id, server_id, registered from user_info where registered between {A} and {B} and server_id in (1,2)")
def _(d):
    return pc.register_dates(d.user_info, A, B, [1, 2])


@query("pc_12_new_per_day_filled", f"""with c as (select cast(floor(registered/{DAY})*{DAY} as bigint) date from users)
 select date, cast(sum(n) as bigint) players from (select date, 1 n from c union all
 select t, 0 from (select unnest(generate_series((select min(date) from c), {NOW + 5 * DAY - DAY}, {DAY})) t) g) x group by date""")
def _(d):
    return pc.new_per_day_filled(d.users, NOW + 5 * DAY)


@query("flt_8_registered_between", f"select id from users where registered between {A} and {B}")
def _(d):
    return pc.registered_between(d.users, A, B).select("id")
