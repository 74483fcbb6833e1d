"""Report queries. Their SQL states every number as an own correlated subquery per server."""

from pyspark.sql import functions as F

from arenalytics.plans import reports as rep
from catalog import query
from catalog.activity import all_index_sql, index_sql
from catalog.domain import A, B, DAY, NOW, T0, THRESHOLD
from catalog.network import LATEST
from catalog.samples import LOW, NUMBER_DOUBLES, numbers_sql, performance_sql, start_sql, window_gap_sql, window_spike_sql

HOUR, WEEK, MONTH = 3600000, 7 * DAY, 30 * DAY
RNOW = T0 + 25 * DAY  # users still register in the day before
AT = "x.server_id=v.id"


def trend(name, before, after):
    return f"abs({after}-{before}) {name}_trend, case when {after}>{before} then '+' when {after}<{before} then '-' end {name}_direction"


def _day(c):
    return f"floor({c}/{DAY})"


def unique(a, b, at=AT):
    return f"(select count(distinct user_id) from sessions x where {at} and session_start>={a} and session_end<={b})"


def unique_avg(a, b, at=AT):
    return f"(select cast(coalesce(floor(avg(n)),0) as bigint) from (select count(distinct user_id) n from sessions x where {at} and session_start>={a} and session_end<={b} group by {_day('session_start')}) q)"


def play(a, b, at=AT):
    return f"(select cast(coalesce(sum(least(session_end,{b})-greatest(session_start,{a})),0) as bigint) from sessions x where {at} and session_end>={a} and session_start<={b})"


def play_avg(a, b, at=AT):
    return f"(select cast(coalesce(floor(avg(n)),0) as bigint) from (select sum(session_end-session_start) n from sessions x where {at} and session_start>={a} and session_end<={b} group by {_day('session_start')}) q)"


def count(a, b, at=AT):
    return f"(select count(*) from sessions x where {at} and session_start>={a} and session_start<{b})"


def new(a, b, at=AT, table="user_info"):
    return f"(select count(*) from {table} x where {at} and registered between {a} and {b})"


def new_avg(a, b, at=AT, table="user_info"):
    return f"(select cast(coalesce(floor(avg(n)),0) as bigint) from (select count(*) n from {table} x where {at} and registered between {a} and {b} group by {_day('registered')}) q)"


def kills(a, b, at=AT):
    return f"(select count(*) from kills x where {at} and date between {a} and {b})"


def mobs(column, a, b, at=AT):
    return f"(select cast(coalesce(sum({column}),0) as bigint) from sessions x where {at} and session_end>={a} and session_start<={b})"


def _div(a, b):
    return f"case when {b}=0 then 0 else cast({a}//{b} as bigint) end"


def server_index(date):
    """Index of every user on every server at a date."""
    return (
        f"select u.server_id, u.user_id, u.registered, 5-5*((coalesce(i.s3,0)+3-coalesce(i.n,0))/3) i from user_info u "
        f"left join ({index_sql(date, True, keys='server_id, user_id')}) i on i.user_id=u.user_id and i.server_id=u.server_id"
    )


def _online_sql():
    w = rep.online_windows(RNOW)
    inner = []
    for t, (a, b) in w.items():
        inner += [
            f"{unique(a, b)} unique_players_{t}", f"{unique_avg(a, b)} unique_players_avg_{t}", f"{new(a, b)} new_players_{t}",
            f"{new_avg(a, b)} new_players_avg_{t}", f"{play(a, b)} playtime_{t}", f"{play_avg(a, b)} playtime_avg_{t}", f"{count(a, b)} sessions_{t}",
        ]
    for t in ("30d", "7d"):
        a, b = w[t]
        inner.append(
            f"(select count(distinct x.user_id) from user_info x join sessions s on s.user_id=x.user_id and s.server_id=x.server_id where {AT} "
            f"and registered between {a} and {b} and session_start>={b - (b - a) // 2} and session_end<={b}) new_players_retention_{t}"
        )
    a, b = w["30d"]
    inner.append(
        f"""(select count(*) from ix x join (select server_id, avg(i) filter (where l) r, avg(i) filter (where not l) n from (select ix.*,
 exists (select 1 from sessions s where s.user_id=ix.user_id and s.server_id=ix.server_id and session_start>={b - (b - a) // 2} and session_end<={b}) l from ix
 where registered between {a} and {b}) y group by 1) c on c.server_id=x.server_id where {AT} and registered between {RNOW - DAY} and {RNOW}
 and abs(ln(x.i)-ln(c.r))<abs(ln(x.i)-ln(c.n))) new_players_retention_24h"""
    )
    measures = ["unique_players", "unique_players_avg", "new_players", "new_players_avg", "playtime", "playtime_avg", "sessions"]
    lengths = ", ".join(f"{_div(f'playtime_{t}', f'sessions_{t}')} session_length_avg_{t}" for t in w)
    shown = [f"{m}_{t}" for m in [*measures, "session_length_avg"] for t in ("30d", "7d", "24h") if (m, t) != ("playtime_avg", "24h")]
    percents = [f"case when new_players_{t}=0 then -1 else new_players_retention_{t}/new_players_{t} end new_players_retention_{t}_perc" for t in ("30d", "7d", "24h")]
    trends = [trend(m, f"{m}_before", f"{m}_after") for m in [*measures, "session_length_avg"]]
    return (
        f"with ix as ({server_index(RNOW)}), n as (select v.id server_id, {', '.join(inner)} from servers v), l as (select *, {lengths} from n) "
        f"select server_id, {', '.join(shown)}, playtime_24h playtime_avg_24h, {', '.join(f'new_players_retention_{t}' for t in ('30d', '7d', '24h'))}, "
        f"{', '.join(percents)}, {', '.join(trends)} from l"
    )


@query("rep_1_online_activity_numbers", _online_sql(), doubles="new_players_retention_30d_perc new_players_retention_7d_perc new_players_retention_24h_perc")
def _(d):
    return rep.online_activity_numbers(d.sessions, d.user_info, RNOW, THRESHOLD)


def _insights_sql():
    start, half = RNOW - MONTH, RNOW - MONTH // 2
    parts = {"all": "true", "before": f"session_end>={start} and session_start<={half}", "after": f"session_end>={half} and session_start<={RNOW}"}
    cols = []
    for p, where in parts.items():
        cols += [
            f"cast(floor(coalesce(avg(len) filter (where first and {where}),0)) as bigint) first_session_length_avg_{p}",
            f"cast(floor(coalesce(quantile_cont(len,0.5) filter (where first and {where}),-1)) as bigint) first_session_length_median_{p}",
            f"count(*) filter (where players_online=0 and {where}) lone_joins_{p}",
            f"count(*) filter (where players_online=0 and first and {where}) lone_new_joins_{p}",
            f"coalesce(avg(players_online) filter (where first and {where}),0) players_first_join_avg_{p}",
        ]
    names = ["first_session_length_avg", "first_session_length_median", "lone_joins", "lone_new_joins", "players_first_join_avg"]
    return f"""with p as (select server_id, date, max_by(players_online, id) players_online from samples where date between {start} and {RNOW} group by 1,2),
 s as (select x.*, session_end-session_start len, coalesce(abs(u.registered-session_start)<500,false) as first from sessions x left join user_info u on u.user_id=x.user_id and u.server_id=x.server_id
 and registered between {start} and {RNOW} where session_start between {start} and {RNOW}),
 j as (select s.*, p.players_online from s asof left join p on p.server_id=s.server_id and p.date<=s.session_start),
 a as (select server_id, {', '.join(cols)} from j group by server_id)
 select server_id, {', '.join(f'{n}_all {n}' for n in names)}, {', '.join(trend(n, f'{n}_before', f'{n}_after') for n in names)} from a"""


@query("rep_2_online_activity_insights", _insights_sql(), doubles="players_first_join_avg players_first_join_avg_trend")
def _(d):
    return rep.online_activity_insights(d.sessions, d.user_info, d.samples, RNOW)


W7 = window_gap_sql("7d", WEEK)
S7 = window_spike_sql("7d", WEEK)


@query("rep_3_last_days", f"""with g as ({W7}), k as ({S7}), n as (select v.id server_id, {unique(NOW - WEEK, NOW)} unique_players, {unique_avg(NOW - WEEK, NOW)} unique_players_day,
 {new(NOW - WEEK, NOW)} new_players, (select count(distinct x.user_id) from user_info x join sessions s on s.user_id=x.user_id and s.server_id=x.server_id where {AT}
 and registered between {NOW - WEEK} and {NOW} and session_start>={NOW - WEEK // 2} and session_end<={NOW}) new_players_retention,
 (select coalesce(avg(tps),-1) from samples x where {AT} and tps>=0 and date between {NOW - WEEK} and {NOW}) average_tps from servers v)
 select n.*, case when new_players=0 then -1 else new_players_retention/new_players end new_players_retention_perc, coalesce(low_tps_spikes_7d,0) low_tps_spikes,
 coalesce(server_downtime_7d,0) downtime from n left join g on g.server_id=n.server_id left join k on k.server_id=n.server_id""", doubles="average_tps new_players_retention_perc")
def _(d):
    return rep.last_days(d.sessions, d.user_info, d.samples, NOW, LOW)


GAP = 3 * HOUR // 2
END = NOW - HOUR // 2


def _totals_sql(at, index, table, key, people, source):
    inner = f"""{people} total_players, (select count(*) from ({index}) x where {at.replace('x.server_id=v.id', 'x.server_id=v.id') if key else 'true'} and registered<={END} and i>=2 and i<5.1) regular_players,
 {play(0, END, at)} playtime, {count(0, END, at)} sessions, {mobs('mob_kills', 0, END, at)} mob_kills, {mobs('deaths', 0, END, at)} deaths, {kills(0, END, at)} player_kills,
 (select max_by(date, cast(players_online as hugeint)*10000000000000+date) from samples x where {at}) best_peak_date, (select max(players_online) from samples x where {at}) best_peak_players,
 (select max_by(date, cast(players_online as hugeint)*10000000000000+date) from samples x where {at} and date>={END - 2 * DAY}) last_peak_date,
 (select max(players_online) from samples x where {at} and date>={END - 2 * DAY}) last_peak_players,
 (select max_by(players_online, cast(date as hugeint)*1000+players_online) from samples x where {at}) online_players,
 (select max({END}-start) from up x where {at}) current_uptime"""
    return f"""with up as (select s.server_id, s.start from ({start_sql(GAP)}) s join (select server_id, max(date) l from samples group by 1) m on m.server_id=s.server_id where {END}-l<={GAP}),
 n as (select {key} {inner} {source}) select *, {_div('playtime', 'total_players')} player_playtime, {_div('playtime', 'sessions')} session_length_avg from n"""


@query("rep_3_totals", _totals_sql(AT, server_index(END), "user_info", "v.id server_id,", f"(select count(distinct user_id) from user_info x where {AT})", "from servers v"))
def _(d):
    return rep.totals(d.sessions, d.user_info, d.kills, d.samples, END, THRESHOLD, gap=GAP)


NETWORK_INDEX = f"select user_id, registered, activity_index i from ({all_index_sql(END, True)}) z"


@query("rep_8_network_totals", _totals_sql("true", NETWORK_INDEX, "users", "", "(select count(*) from users)", ""))
def _(d):
    people = d.users.select(F.col("id").alias("user_id"), "registered")
    return rep.totals(d.sessions, people, d.kills, d.samples, END, THRESHOLD, by=(), gap=GAP)


def _weeks_sql(at, table, key, source, index):
    inner = []
    for t, (a, b) in {"before": (NOW - 2 * WEEK, NOW - WEEK), "after": (NOW - WEEK, NOW)}.items():
        inner += [
            f"{unique(a, b, at)} unique_players_{t}", f"{new(a, b, at, table)} new_players_{t}", f"{play(a, b, at)} playtime_{t}", f"{count(a, b, at)} sessions_{t}",
            f"{kills(a, b, at)} player_kills_{t}", f"{mobs('mob_kills', a, b, at)} mob_kills_{t}", f"{mobs('deaths', a, b, at)} deaths_{t}",
            f"(select count(*) from ({index(b)}) x where {at} and registered<={b} and i>=2 and i<5.1) regular_{t}",
        ]
    names = ["unique_players", "new_players", "regular", "sessions", "player_kills", "mob_kills", "deaths", "average_playtime", "session_length"]
    derived = ", ".join(
        f"{_div(f'playtime_{t}', f'unique_players_{t}')} average_playtime_{t}, {_div(f'playtime_{t}', f'sessions_{t}')} session_length_{t}" for t in ("before", "after")
    )
    head = "server_id, " if key else ""
    return f"""with n as (select {key} {', '.join(inner)} {source}), m as (select *, {derived} from n)
 select {head} {', '.join(f'{n}_{t}' for n in names for t in ('before', 'after'))}, {', '.join(trend(n, f'{n}_before', f'{n}_after') for n in names)} from m"""


@query("rep_3_weeks", _weeks_sql(AT, "user_info", "v.id server_id,", "from servers v", server_index))
def _(d):
    return rep.weeks(d.sessions, d.user_info, d.kills, NOW, THRESHOLD)


def network_index(date):
    return f"select user_id, registered, activity_index i from ({all_index_sql(date, True)}) z"


@query("rep_8_network_weeks", _weeks_sql("true", "users", "", "", network_index))
def _(d):
    people = d.users.select(F.col("id").alias("user_id"), "registered")
    return rep.weeks(d.sessions, people, d.kills, NOW, THRESHOLD, by=())


@query("rep_8_network_players", "select " + ", ".join(
    f"{unique(NOW - s, NOW, 'true')} unique_players_{t}, {new(NOW - s, NOW, 'true', 'users')} new_players_{t}" for t, s in (("1d", DAY), ("7d", WEEK), ("30d", MONTH))))
def _(d):
    return rep.network_players(d.sessions, d.users, NOW)


SPAN = 10 * DAY


def _playerbase_sql(at, table, key, source, index, session_at):
    then, half, now = NOW - SPAN, NOW - SPAN // 2, NOW
    dates = {"now": now, "half": half, "then": then}
    win = {"then": (NOW - 2 * SPAN, then), "now": (then, now)}
    cte = ", ".join(f"i_{t} as ({index(d)})" for t, d in dates.items())
    inner = []
    for t, d in (("then", then), ("now", now)):
        a, b = win[t]
        reg = f"x.user_id in (select user_id from i_{t} r where i>=2 and i<5.1{session_at})"
        over, cont = f"session_end>={a} and session_start<={b}", f"session_start>={a} and session_end<={b}"
        inner += [
            f"(select count(*) from {table} x where {at} and registered<={d}) total_players_{t}",
            f"(select count(*) from i_{t} x where {at} and registered<={d} and i>=2 and i<5.1) regular_players_{t}",
            f"(select cast(coalesce(floor(avg(n)),0) as bigint) from (select sum(least(session_end,{b})-greatest(session_start,{a})) n from sessions x where {at} and {over} group by user_id) q) playtime_avg_{t}",
            f"(select cast(coalesce(floor(avg(n)),0) as bigint) from (select sum(afk_time) n from sessions x where {at} and {over} group by user_id) q) afk_avg_{t}",
            f"(select cast(coalesce(floor(avg(n)),0) as bigint) from (select sum(session_end-session_start) n from sessions x where {at} and {cont} and {reg} group by user_id) q) regular_playtime_avg_{t}",
            f"(select cast(coalesce(floor(avg(session_end-session_start)),0) as bigint) from sessions x where {at} and {cont} and {reg}) regular_session_avg_{t}",
            f"(select cast(coalesce(floor(avg(n)),0) as bigint) from (select sum(afk_time) n from sessions x where {at} and {cont} and {reg} group by user_id) q) regular_afk_avg_{t}",
        ]

    def fresh(a, b, t):
        return f"(select count(*) from i_{t} x where {at} and registered between {a} and {b} and i>=2)"

    def lost(s, e):
        return f"(select count(*) from i_{s} x join i_{e} e on e.user_id=x.user_id{' and e.server_id=x.server_id' if key else ''} where {at} and x.i>=2 and x.i<5.1 and e.i>=-0.1 and e.i<1)"

    inner += [
        f"{fresh(then, now, 'now')} new_to_regular", f"{fresh(then, half, 'half')} ntr_b", f"{fresh(half, now, 'now')} ntr_a",
        f"{lost('then', 'now')} regular_to_inactive", f"{lost('then', 'half')} rti_b", f"{lost('half', 'now')} rti_a",
    ]
    ratios = ", ".join(
        f"case when playtime_avg_{t}=0 then 0 else afk_avg_{t}/playtime_avg_{t} end afk_{t}, "
        f"case when regular_playtime_avg_{t}=0 then 0 else regular_afk_avg_{t}/regular_playtime_avg_{t} end regular_afk_{t}"
        for t in ("then", "now")
    )
    pairs = ["total_players", "regular_players", "playtime_avg", "afk", "regular_playtime_avg", "regular_session_avg", "regular_afk"]
    head = "server_id, " if key else ""
    return f"""with {cte}, n as (select {key} {', '.join(inner)} {source}), m as (select *, {ratios} from n)
 select {head} {', '.join(f'{p}_{t}' for p in pairs for t in ('then', 'now'))}, {', '.join(trend(p, f'{p}_then', f'{p}_now') for p in pairs)},
 new_to_regular, regular_to_inactive, {trend('new_to_regular', 'ntr_b', 'ntr_a')}, {trend('regular_to_inactive', 'rti_b', 'rti_a')} from m"""


AFK = "afk_then afk_now afk_trend regular_afk_then regular_afk_now regular_afk_trend"


@query("rep_4_playerbase", _playerbase_sql(AT, "user_info", "v.id server_id,", "from servers v", server_index, " and r.server_id=x.server_id"), doubles=AFK)
def _(d):
    return rep.playerbase(d.sessions, d.user_info, NOW, THRESHOLD, month=SPAN)


@query("rep_4_network_playerbase", _playerbase_sql("true", "users", "", "", network_index, ""), doubles=AFK)
def _(d):
    people = d.users.select(F.col("id").alias("user_id"), "registered")
    return rep.playerbase(d.sessions, people, NOW, THRESHOLD, by=(), month=SPAN)


INSIGHTS = "low_tps_players low_tps_tps low_tps_cpu low_tps_entities low_tps_chunks low_tps_mspt"


@query("rep_5_performance", f"""select * from ({performance_sql()}) p left join (select server_id, avg(players_online) low_tps_players, avg(tps) filter (where tps>=0) low_tps_tps,
 avg(cpu_usage) filter (where cpu_usage>=0) low_tps_cpu, avg(entities) low_tps_entities, avg(chunks_loaded) low_tps_chunks, avg(mspt_average) low_tps_mspt
 from samples where date between {NOW - MONTH} and {NOW} and tps>-1 and tps<{LOW} group by server_id) i using (server_id)""", doubles=NUMBER_DOUBLES + " " + INSIGHTS)
def _(d):
    return rep.performance(d.samples, NOW, LOW)


def _combat_sql():
    inner = []
    for t, a in (("total", 0), ("30d", NOW - MONTH), ("7d", NOW - WEEK)):
        inner += [
            f"{kills(a, NOW)} player_kills_{t}", f"{mobs('mob_kills', a, NOW)} mob_kills_{t}", f"{mobs('deaths', a, NOW)} deaths_{t}",
            f"""(select coalesce(avg(k/d),0) from (select killer_uuid u, count(*) k from kills x where {AT} and date between {a} and {NOW} group by 1) p
 join (select victim_uuid u, count(*) d from kills x where {AT} and date between {a} and {NOW} group by 1) q on p.u=q.u join users w on w.uuid=p.u) player_kdr_{t}""",
        ]
    for i in (1, 2, 3):
        inner.append(f"(select weapon from (select weapon, row_number() over (order by count(*) desc, weapon) r from kills x where {AT} and date between {NOW - MONTH} and {NOW} group by 1) q where r={i}) weapon_{i}")
    tail = ", ".join(
        f"deaths_{t}-player_kills_{t} mob_deaths_{t}, mob_kills_{t}/case when deaths_{t}=player_kills_{t} then 1 else deaths_{t}-player_kills_{t} end mob_kdr_{t}" for t in ("total", "30d", "7d")
    )
    return f"with n as (select v.id server_id, {', '.join(inner)} from servers v) select *, {tail} from n"


@query("rep_6_combat_overview", _combat_sql(), doubles=" ".join(f"{c}_{t}" for t in ("total", "30d", "7d") for c in ("player_kdr", "mob_kdr")))
def _(d):
    return rep.combat_overview(d.kills, d.sessions, d.users, NOW)


MA = NOW - MONTH
MODES = {"SURVIVAL": "survival_time", "CREATIVE": "creative_time", "ADVENTURE": "adventure_time", "SPECTATOR": "spectator_time"}


@query("rep_7_sessions_overview", f"""with g as (select server_id, date-lag(date) over (partition by server_id order by date) g, p from (select server_id, date, max(players_online) p from samples
 where date between {MA} and {NOW} group by 1,2) x), t as (select server_id, sum(g) filter (where g<120000) u, sum(g) filter (where p>0 and g<=180000) o from g group by 1),
 m as (select x.server_id, sum(survival_time) s, sum(creative_time) c, sum(adventure_time) a, sum(spectator_time) p from world_times x join sessions z on z.id=x.session_id
 where session_start>={MA} and session_end<={NOW} group by 1),
 n as (select v.id server_id, cast(coalesce(o,0) as bigint) occupied, coalesce(u,0) u, {play(MA, NOW)} playtime, {mobs('afk_time', MA, NOW)} afk_time, greatest(s,c,a,p) mt,
 case when greatest(s,c,a,p)<=0 then null when s>=greatest(c,a,p) then 'SURVIVAL' when c>=greatest(a,p) then 'CREATIVE' when a>=p then 'ADVENTURE' else 'SPECTATOR' end mode
 from servers v left join t on t.server_id=v.id left join m on m.server_id=v.id)
 select server_id, occupied, case when u=0 then -1 else occupied/u end occupied_perc, playtime, afk_time, case when playtime=0 then -1 else afk_time/playtime end afk_perc, mode,
 case when playtime=0 then -1 else coalesce(mt,-1)/playtime end mode_perc from n""", doubles="occupied_perc afk_perc mode_perc")
def _(d):
    return rep.sessions_overview(d.sessions, d.samples, d.world_times, NOW)


@query("rep_7_network_sessions", f"""with n as (select {play(MA, NOW, 'true')} playtime, {mobs('afk_time', MA, NOW, 'true')} afk_time)
 select *, afk_time/playtime afk_perc from n""", doubles="afk_perc")
def _(d):
    return rep.network_sessions_overview(d.sessions, NOW)


def _series_sql(width):
    return f"""with p as (select server_id, 'unique' kind, session_start-session_start%{width} date, count(distinct user_id) n from sessions where session_start>={A} and session_end<={NOW} group by 1,3
 union all select server_id, 'new', registered-registered%{width}, count(*) from user_info where registered between {A} and {NOW} group by 1,3),
 l as (select *, coalesce(lead(date) over (partition by server_id, kind order by date), {NOW}) nx from p)
 select server_id, kind, date, n players from p union all select server_id, kind, t, 0 from (select server_id, kind, unnest(generate_series(date+{width}, nx-1, {width})) t from l where nx-date>{width}) q"""


@query("rep_10_unique_and_new_per_day", _series_sql(DAY))
def _(d):
    return rep.unique_and_new_series(d.sessions, d.user_info, A, NOW)


@query("rep_10_unique_and_new_per_hour", _series_sql(HOUR))
def _(d):
    return rep.unique_and_new_series(d.sessions, d.user_info, A, NOW, HOUR)


CA = NOW - 730 * DAY


@query("rep_11_calendar", f"""with s as (select server_id, session_start-session_start%{DAY} date, 'unique' kind, count(distinct user_id) as value from sessions where session_start>={CA} and session_end<={NOW} group by 1,2
 union all select server_id, session_start-session_start%{DAY}, 'playtime', sum(session_end-session_start) from sessions where session_start>={CA} and session_end<={NOW} group by 1,2
 union all select server_id, session_start-session_start%{DAY}, 'sessions', count(*) from sessions where session_start>={CA} and session_start<{NOW} group by 1,2
 union all select server_id, registered-registered%{DAY}, 'new', count(*) from user_info where registered between {CA} and {NOW} group by 1,2)
 select server_id, date, kind, cast(value as bigint) as value from s where value>0""")
def _(d):
    return rep.calendar(d.sessions, d.user_info, NOW)


@query("rep_12_player_calendar", f"""select id user_id, 'registered' kind, registered as value, registered+{HOUR} as start, cast(null as bigint) "end" from users
 union all select user_id, 'sessions', count(*), cast(floor((session_start+{HOUR})/{DAY})*{DAY} as bigint), null from sessions group by 1, 4
 union all select user_id, 'playtime', cast(sum(session_end-session_start) as bigint), cast(floor((session_start+{HOUR})/{DAY})*{DAY} as bigint), null from sessions group by 1, 4
 union all select user_id, 'session', session_end-session_start, session_start+{HOUR}, session_end+{HOUR} from sessions
 union all select u.id, 'kill', null, k.date, k.date+300000 from kills k join users u on u.uuid=k.killer_uuid""")
def _(d):
    return rep.player_calendar(d.sessions, d.users, d.kills, HOUR)


@query("rep_13_server_graphs", f"""with l as ({LATEST}), c as (select geolocation, count(*) n from l group by 1),
 top as (select * from c order by n desc, geolocation limit 20)
 select 'geolocation_bars' graph, count(*) points, cast(sum(n) as bigint) total from top
 union all select 'geolocation_map', count(*), cast(sum(n) as bigint) from c join country_codes k on lower(k.name)=lower(c.geolocation)
 union all select 'ping', count(*), cast(sum(m) as bigint) from (select max(case when max_ping>0 and max_ping<=4000 then max_ping else -1 end) m from ping where date between {A} and {B} group by server_id, floor(date/60000)) p
 union all select 'punch_card', 168*count(distinct server_id), count(*) from sessions where session_start between {A} and {B}
 union all select 'server_pie', count(distinct server_id), cast(sum(least(session_end,{B})-greatest(session_start,{A})) as bigint) from sessions where session_end>={A} and session_start<={B}
 union all select 'join_addresses', count(*), cast(sum(n) as bigint) from (select count(distinct user_id) n from sessions where session_start>{A} and session_start<={B} group by server_id, join_address_id, floor(session_start/{DAY})) j""")
def _(d):
    graphs = rep.server_graphs(d, A, B)
    measure = {"geolocation_bars": "users", "geolocation_map": "users", "ping": "max_ping", "punch_card": "n", "server_pie": "playtime", "join_addresses": "players"}
    parts = [graphs[g].agg(F.lit(g).alias("graph"), F.count("*").alias("points"), F.sum(m).cast("bigint").alias("total")) for g, m in measure.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("rep_14_ping_table", f"""select geolocation, min(min_ping) min_ping, max(max_ping) max_ping, cast(trunc(avg(avg_ping)) as bigint) avg_ping
 from ping p join ({LATEST}) l on l.user_id=p.user_id group by 1""")
def _(d):
    return rep.ping_table(d.ping, d.geolocations)


def _network_performance_sql():
    sql = f"select * exclude ({', '.join(f'{c}_{t}' for t in rep.tps.WINDOWS for c in ('max_disk', 'min_disk'))})"
    parts = []
    for t, span in rep.tps.WINDOWS.items():
        where = f"date between {NOW - span} and {NOW}"
        pooled = f"""(select count(*) filter (where l and not coalesce(pl,false)) from (select l, lag(l) over (order by server_id, date) pl from (
 select server_id, date, min(tps)>=0 and min(tps)<{LOW} l from samples where {where} group by 1,2) z) y) low_tps_spikes_{t}"""
        servers = f"(select count(distinct server_id) from samples where date between {NOW - MONTH} and {NOW})"
        gap = window_gap_sql(t, span)
        parts.append(pooled)
        for c in ("server_downtime", "server_uptime"):
            parts.append(f"(select cast(sum({c}_{t}) as bigint) from ({gap}) q) {c}_{t}")
            parts.append(f"(select cast(sum({c}_{t})//{servers} as bigint) from ({gap}) q) avg_{c}_{t}")
    return f"{sql}, {', '.join(parts)} from ({numbers_sql('')}) n"


@query("rep_15_network_performance", _network_performance_sql(), doubles=NUMBER_DOUBLES)
def _(d):
    return rep.network_performance(d.samples, NOW, LOW)
