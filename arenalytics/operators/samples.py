"""Per-minute server samples: down-sampling, up-time, peaks, averages, load ratios.

Missing metrics are stored as −1 (or null for tick times). They stay null inside and become −1 only in
results, as reports expect.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arenalytics.functions.clock import DAY, HOUR, MINUTE, bucket
from arenalytics.functions.ordered import step_totals, with_previous
from arenalytics.functions.stats import ratio
from arenalytics.functions.windows import scope, strictly_inside
from arenalytics.operators.sessions import merge_rows

# Neighbouring samples at most this far apart are one run / at least this far apart are a stop.
UP_GAP = 120_000
DOWN_GAP = 180_000
METRICS = [
    "tps", "players_online", "cpu_usage", "ram_usage", "entities", "chunks_loaded", "free_disk_space",
    "mspt_average", "mspt_95th", "mspt_jitter_avg", "mspt_jitter_max",
]


def dated(samples, a, b, servers=None) -> DataFrame:
    return scope(samples, servers).where(F.col("date").between(a, b))


def tps_between(samples, above: float, below: float) -> DataFrame:
    return samples.where((F.col("tps") > above) & (F.col("tps") < below))


def online_activity(samples, kind: str | None) -> DataFrame:
    """ACTIVE keeps samples with players online, IDLE those without."""
    if kind is None:
        return samples
    return samples.where(F.col("players_online") > 0 if kind == "ACTIVE" else F.col("players_online") == 0)


def in_resolution(samples, a, b, resolution: int, servers=None) -> DataFrame:
    """One row per server and ``resolution`` bucket keeping the worst TPS and the highest load."""
    chosen = scope(samples, servers).where((F.col("date") >= a) & (F.col("date") < b))
    highest = [m for m in METRICS if m not in ("tps", "mspt_jitter_avg")]
    return (
        chosen.groupBy("server_id", bucket("date", resolution).alias("_bucket"))
        .agg(
            F.min("date").alias("date"),
            F.min("tps").alias("tps"),
            F.avg("mspt_jitter_avg").alias("mspt_jitter_avg"),
            *[F.max(m).alias(m) for m in highest],
        )
        .select("server_id", "date", *METRICS)
    )


def raw_series(samples, a, b, servers=None) -> DataFrame:
    return dated(samples, a, b, servers).select("server_id", "date", *METRICS).orderBy("server_id", "date")


def stitched_series(samples, now: int, raw_span=30 * DAY, fine_span=60 * DAY, fine=5 * MINUTE, coarse=20 * MINUTE, servers=None) -> DataFrame:
    """Coarse buckets for old data, finer ones later, raw rows for the newest span."""
    old = in_resolution(samples, 0, now - fine_span, coarse, servers)
    middle = in_resolution(samples, now - fine_span, now - raw_span, fine, servers)
    new = dated(samples, now - raw_span, now, servers).select("server_id", "date", *METRICS)
    tagged = [f.withColumn("resolution", F.lit(r)) for f, r in ((old, coarse), (middle, fine), (new, 0))]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


def preview(samples, width=15 * MINUTE, servers=None) -> DataFrame:
    return (
        scope(samples, servers)
        .groupBy("server_id", bucket("date", width).alias("_bucket"))
        .agg(F.min("date").alias("date"), F.max("players_online").alias("players_online"))
        .drop("_bucket")
    )


def players_online_series(samples, a, b, servers=None) -> DataFrame:
    chosen = scope(samples, servers).where(strictly_inside("date", a, b))
    return chosen.select("server_id", "date", "players_online").orderBy("server_id", "date")


def _keys(merge_servers: bool) -> list[str]:
    return [] if merge_servers else ["server_id"]


def _gap(prev: Column, cur: Column) -> Column:
    return cur["date"] - prev["date"]


def _gap_totals(samples: DataFrame, keys: Sequence[str], sums: dict) -> DataFrame:
    """Sums over the gaps between neighbouring instants; keys with a single instant have no gap and no row."""
    return step_totals(samples, keys, "date", sums).where((F.col("steps") > 0) | F.lit(not keys)).select(*keys, *[F.coalesce(n, F.lit(0)).alias(n) for n in sums])


def occupied_time(samples, a, b, servers=None, merge_servers: bool = False) -> DataFrame:
    """Total length of the runs of samples with players online.

    A run ends at a gap of three minutes or more, so its length is the sum of its shorter inner gaps.
    """
    busy = dated(samples, a, b, servers).where(F.col("players_online") > 0)
    return _gap_totals(busy, _keys(merge_servers), {"occupied": lambda p, c: F.when(_gap(p, c) < DOWN_GAP, _gap(p, c))})


def up_and_down_time(samples, a, b, servers=None, merge_servers: bool = False, exclusive: bool = False) -> DataFrame:
    """Sum of the gaps that count as up-time and of those that count as down-time.

    Limits are ≤ 2 min and ≥ 3 min; ``exclusive`` uses < 2 min and > 3 min as the in-memory form does.
    ``merge_servers`` interleaves the samples of all servers.
    """

    def up(p, c):
        return F.when(_gap(p, c) < UP_GAP if exclusive else _gap(p, c) <= UP_GAP, _gap(p, c))

    def down(p, c):
        return F.when(_gap(p, c) > DOWN_GAP if exclusive else _gap(p, c) >= DOWN_GAP, _gap(p, c))

    return _gap_totals(dated(samples, a, b, servers), _keys(merge_servers), {"uptime": up, "downtime": down})


def _instants(samples: DataFrame, *aggs: Column) -> DataFrame:
    """One row per server and instant; samples of the same instant count as one."""
    return samples.groupBy("server_id", "date").agg(*aggs)


def occupied_time_by_sample(samples, a, b, servers=None) -> DataFrame:
    """The in-memory form: gaps of at most three minutes that end in a sample with players online."""
    busy = {"occupied": lambda p, c: F.when((c["players_online"] > 0) & (_gap(p, c) <= DOWN_GAP), _gap(p, c))}
    most = {"players_online": F.max("players_online")}
    return step_totals(dated(samples, a, b, servers), ["server_id"], "date", busy, state=most).select("server_id", "occupied")


def _lowest() -> dict[str, Column]:
    """The lowest TPS stands for an instant."""
    return {"tps": F.min("tps")}


def _counted(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def low_tps_spikes(samples, threshold: float, a, b, servers=None) -> DataFrame:
    """Transitions into ``0 < tps < threshold`` from the start or from ``tps >= threshold``."""

    def entered(p, c):
        return _counted((c["tps"] > 0) & (c["tps"] < threshold) & (p.isNull() | (p["tps"] >= threshold)))

    return step_totals(dated(samples, a, b, servers), ["server_id"], "date", {"spikes": entered}, state=_lowest()).select("server_id", "spikes")


def is_low(tps: Column, threshold: float) -> Column:
    return (tps >= 0) & (tps < threshold)


def low_tps_spikes_by_sample(samples, threshold: float, a, b, servers=None) -> DataFrame:
    """The in-memory form: any sample that is not low (−1 included) ends a spike."""

    def entered(p, c):
        return _counted(is_low(c["tps"], threshold) & ~F.coalesce(is_low(p["tps"], threshold), F.lit(False)))

    return step_totals(dated(samples, a, b, servers), ["server_id"], "date", {"spikes": entered}, state=_lowest()).select("server_id", "spikes")


def peaks(samples, now: int | None = None, recent: int = 2 * DAY, by=("server_id",)) -> DataFrame:
    """Best and recent peak with their latest dates, and the newest player count, from one aggregation.

    Dates are reduced per player count first, which keeps the large aggregation on plain hash maps.
    """
    seen = F.col("date") >= now - recent if now is not None else F.lit(True)
    levels = samples.groupBy(*by, "players_online").agg(F.max("date").alias("d"), F.max(F.when(seen, F.col("date"))).alias("r"))
    best = F.max(F.struct("players_online", "d"))
    last = F.max(F.when(F.col("r").isNotNull(), F.struct("players_online", "r")))
    newest = F.max(F.struct("d", "players_online"))
    return levels.groupBy(*by).agg(best.alias("b"), last.alias("l"), newest.alias("n")).select(
        *by, F.col("b.d").alias("best_peak_date"), F.col("b.players_online").alias("best_peak_players"),
        F.col("l.r").alias("last_peak_date"), F.col("l.players_online").alias("last_peak_players"),
        F.col("n.d").alias("newest_date"), F.col("n.players_online").alias("newest_players"),
    )


def peak_players(samples, a, b, servers=None, by=("server_id",)) -> DataFrame:
    """Highest player count and the latest date it was seen."""
    found = peaks(dated(samples, a, b, servers), by=by)
    return found.select(*by, F.col("best_peak_date").alias("date"), F.col("best_peak_players").alias("players_online")).where(F.col("date").isNotNull())


def network_peak(samples, a, b, servers=None) -> DataFrame:
    """The date with the highest sum of players over the servers, the latest one on ties."""
    totals = dated(samples, a, b, servers).groupBy("date").agg(F.sum("players_online").alias("players_online"))
    return totals.orderBy(F.col("players_online").desc(), F.col("date").desc()).limit(1)


def latest_sample(samples, servers=None) -> DataFrame:
    """The newest sample of each server. Its date is found on two columns; full rows are read for that date only."""
    chosen = scope(samples, servers)
    newest = chosen.groupBy("server_id").agg(F.max("date").alias("date"))
    columns = [c for c in samples.columns if c not in ("server_id", "date")]
    tie = F.col("id") if "id" in columns else F.col("date")
    return (
        chosen.join(newest, ["server_id", "date"], "left_semi")
        .groupBy("server_id", "date")
        .agg(F.max_by(F.struct(*columns), tie).alias("m"))
        .select("server_id", "date", "m.*")
    )


def _present(name: str) -> Column:
    return F.when(F.col(name) >= 0, F.col(name).cast("double"))


def average_columns() -> list[Column]:
    """Averages, maxima and minima, −1 where nothing was measured."""
    means = [m for m in METRICS if m not in ("mspt_95th", "mspt_jitter_max")]
    return [F.coalesce(F.avg(_present(m)), F.lit(-1.0)).alias(f"average_{m}") for m in means] + [
        F.coalesce(F.max(_present("mspt_jitter_max")), F.lit(-1.0)).alias("max_jitter"),
        F.coalesce(F.max(_present("mspt_95th")), F.lit(-1.0)).alias("max_mspt_95th"),
        F.coalesce(F.max(F.when(F.col("free_disk_space") >= 0, F.col("free_disk_space"))), F.lit(-1)).alias("max_disk"),
        F.coalesce(F.min(F.when(F.col("free_disk_space") >= 0, F.col("free_disk_space"))), F.lit(-1)).alias("min_disk"),
    ]


def low_tps_columns(threshold: float) -> list[Column]:
    low = F.col("tps") < threshold
    return [
        F.coalesce(F.avg(F.when(low, _present("mspt_average"))), F.lit(-1.0)).alias("low_average_mspt"),
        F.coalesce(F.max(F.when(low, _present("mspt_95th"))), F.lit(-1.0)).alias("low_max_mspt_95th"),
    ]


RATIOS = ["cpu_per_player", "chunks_per_player", "entities_per_chunk", "mspt_per_player", "mspt_per_chunk"]


def ratio_columns() -> list[Column]:
    """Load per player and per chunk. The idle CPU baseline is taken from the same pass, because
    ``avg((cpu − idle) / players) = avg(cpu / players) − idle · avg(1 / players)``; −1 without a baseline.
    """
    players, chunks = F.col("players_online").cast("double"), F.col("chunks_loaded").cast("double")
    cpu = _present("cpu_usage")

    def per(metric: Column, amount: Column) -> Column:
        return F.avg(F.when(amount > 0, metric / F.when(amount != 0, amount)))

    idle = F.avg(F.when(players == 0, cpu))
    inverse = F.avg(F.when((players > 0) & cpu.isNotNull(), 1 / F.when(players != 0, players)))
    return [
        F.coalesce(per(cpu, players) - idle * inverse, F.lit(-1.0)).alias("cpu_per_player"),
        F.coalesce(per(_present("chunks_loaded"), players), F.lit(-1.0)).alias("chunks_per_player"),
        F.coalesce(per(_present("entities"), chunks), F.lit(-1.0)).alias("entities_per_chunk"),
        F.coalesce(per(_present("mspt_average"), players), F.lit(-1.0)).alias("mspt_per_player"),
        F.coalesce(per(_present("mspt_average"), chunks), F.lit(-1.0)).alias("mspt_per_chunk"),
    ]


def in_window(samples, a, b, servers=None, activity: str | None = None, closed: bool = False) -> DataFrame:
    inside = F.col("date").between(a, b) if closed else strictly_inside("date", a, b)
    return online_activity(scope(samples, servers).where(inside), activity)


def averages(samples, a, b, servers=None, by=("server_id",), activity: str | None = None, closed: bool = False) -> DataFrame:
    """All averages and extremes of a window in one aggregation."""
    return in_window(samples, a, b, servers, activity, closed).groupBy(*by).agg(*average_columns())


def under_low_tps(samples, a, b, threshold: float, servers=None, by=("server_id",)) -> DataFrame:
    chosen = in_window(samples, a, b, servers).where(F.col("tps") < threshold).groupBy(*by).agg(*low_tps_columns(threshold))
    return chosen.withColumnsRenamed({"low_average_mspt": "average_mspt", "low_max_mspt_95th": "max_mspt_95th"})


def load_ratios(samples, a, b, servers=None, by=("server_id",)) -> DataFrame:
    return in_window(samples, a, b, servers).groupBy(*by).agg(*ratio_columns())


def sample_block(samples, a, b, threshold: float, servers=None, by=()) -> DataFrame:
    """Averages, extremes, low-TPS values and load ratios of a window from one scan."""
    return in_window(samples, a, b, servers).groupBy(*by).agg(*average_columns(), *low_tps_columns(threshold), *ratio_columns())


def _starts(samples, gap: int, servers) -> DataFrame:
    """(server_id, start, last): the newest sample that follows a gap longer than ``gap``, or the first one, and the last."""
    start = {"start": lambda p, c: F.when(p.isNull() | (_gap(p, c) > gap), c["date"])}
    return step_totals(scope(samples, servers), ["server_id"], "date", {}, start).select("server_id", "start", "last")


def latest_start(samples, gap: int = DOWN_GAP, servers=None) -> DataFrame:
    """The newest sample that follows a gap longer than ``gap``, else the first sample of the server."""
    return _starts(samples, gap, servers).select("server_id", "start")


def current_uptime(samples, now: int, gap: int = DOWN_GAP, servers=None) -> DataFrame:
    """``now − latest start`` of the servers whose last sample is at most ``gap`` old."""
    found = _starts(samples, gap, servers)
    return found.where(F.lit(now) - F.col("last") <= gap).select("server_id", (F.lit(now) - F.col("start")).alias("uptime"))


def share_above(samples, threshold: float, a, b, servers=None, by=("server_id",)) -> DataFrame:
    chosen = dated(samples, a, b, servers)
    return chosen.groupBy(*by).agg(ratio(F.count_if(F.col("tps") >= threshold), F.count("*"), 1.0).alias("share"))


def low_tps_insights(samples, a, b, threshold: float, servers=None, by=("server_id",)) -> DataFrame:
    """Averages over the samples with ``-1 < tps < threshold``."""
    low = tps_between(dated(samples, a, b, servers), -1, threshold)
    return low.groupBy(*by).agg(
        F.coalesce(F.avg("players_online"), F.lit(-1.0)).alias("low_tps_players"),
        *[
            F.coalesce(F.avg(_present(c)), F.lit(-1.0)).alias(f"low_tps_{n}")
            for n, c in (("tps", "tps"), ("cpu", "cpu_usage"), ("entities", "entities"), ("chunks", "chunks_loaded"), ("mspt", "mspt_average"))
        ],
    )


WINDOWS = {"30d": 30 * DAY, "7d": 7 * DAY, "24h": 24 * HOUR}
NUMBER_COLUMNS = ["players", "tps", "cpu", "ram", "entities", "chunks", "max_disk", "min_disk", "mspt_average"]
GAP_COLUMNS = ["server_downtime", "server_uptime"]


def sample_numbers(samples, now: int, by=("server_id",), windows=WINDOWS) -> DataFrame:
    """Averages and extremes of every window from one pass."""
    aggs = []
    for tag, span in windows.items():
        inside = F.col("date").between(now - span, now)

        def mean(name, inside=inside):
            return F.coalesce(F.avg(F.when(inside, _present(name))), F.lit(-1.0))

        disk = F.when(inside & (F.col("free_disk_space") >= 0), F.col("free_disk_space"))
        aggs += [
            mean("players_online").cast("bigint").alias(f"players_{tag}"),
            mean("tps").alias(f"tps_{tag}"),
            mean("cpu_usage").alias(f"cpu_{tag}"),
            mean("ram_usage").alias(f"ram_{tag}"),
            mean("entities").cast("bigint").alias(f"entities_{tag}"),
            mean("chunks_loaded").cast("bigint").alias(f"chunks_{tag}"),
            F.coalesce(F.max(disk), F.lit(-1)).alias(f"max_disk_{tag}"),
            F.coalesce(F.min(disk), F.lit(-1)).alias(f"min_disk_{tag}"),
            mean("mspt_average").alias(f"mspt_average_{tag}"),
        ]
    return dated(samples, now - max(windows.values()), now).groupBy(*by).agg(*aggs)


def _gap_measures(now: int, windows) -> dict:
    """Up- and down-time of every window; a gap counts where both its ends lie inside."""
    out = {}
    for tag, span in windows.items():
        inside = lambda p, span=span: p["date"] >= now - span
        out[f"server_downtime_{tag}"] = lambda p, c, inside=inside: F.when(inside(p) & (_gap(p, c) > DOWN_GAP), _gap(p, c)).otherwise(0)
        out[f"server_uptime_{tag}"] = lambda p, c, inside=inside: F.when(inside(p) & (_gap(p, c) < UP_GAP), _gap(p, c)).otherwise(0)
    return out


def _spike_measures(now: int, threshold: float, windows) -> dict:
    def entered(span):
        def measure(p, c):
            was = F.coalesce((p["date"] >= now - span) & is_low(p["tps"], threshold), F.lit(False))
            return _counted((c["date"] >= now - span) & is_low(c["tps"], threshold) & ~was)

        return measure

    return {f"low_tps_spikes_{tag}": entered(span) for tag, span in windows.items()}


def gap_numbers(samples, now: int, windows=WINDOWS) -> DataFrame:
    """Per server up- and down-time of every window; a gap counts where both its ends lie inside."""
    return _gap_totals(dated(samples, now - max(windows.values()), now), ["server_id"], _gap_measures(now, windows))


def spike_numbers(samples, now: int, threshold: float, windows=WINDOWS) -> DataFrame:
    measures = _spike_measures(now, threshold, windows)
    found = step_totals(dated(samples, now - max(windows.values()), now), ["server_id"], "date", measures, state=_lowest())
    return found.select("server_id", *measures)


def step_numbers(samples, now: int, threshold: float, windows=WINDOWS) -> DataFrame:
    """Up-time, down-time and spikes per server from one pass."""
    measures = {**_gap_measures(now, windows), **_spike_measures(now, threshold, windows)}
    found = step_totals(dated(samples, now - max(windows.values()), now), ["server_id"], "date", measures, state=_lowest())
    return found.select("server_id", *measures)


def performance_numbers(samples, now: int, threshold: float, windows=WINDOWS) -> DataFrame:
    """The whole performance block per server: spikes, up- and down-time, averages, extremes."""
    columns = [f"{c}_{t}" for t in windows for c in [*NUMBER_COLUMNS, *GAP_COLUMNS, "low_tps_spikes"]]
    frames = [sample_numbers(samples, now, windows=windows), step_numbers(samples, now, threshold, windows)]
    merged = merge_rows(frames, ["server_id"], columns)
    return merged.fillna(0, [f"{c}_{t}" for t in windows for c in [*GAP_COLUMNS, "low_tps_spikes"]])


def _edge_measures(now: int, threshold: float, windows) -> dict:
    """The first and the last instant of every window, as structs that order by date, with whether it is low."""
    out = {}
    for tag, span in windows.items():
        for name, sign in (("first", -1), ("last", 1)):
            out[f"{name}_{tag}"] = lambda p, c, span=span, sign=sign: F.when(
                c["date"] >= now - span, F.struct((sign * c["date"]).alias("date"), is_low(c["tps"], threshold).alias("low"))
            )
    return out


def pooled_steps(samples, now: int, threshold: float, windows=WINDOWS) -> DataFrame:
    """One row, from one pass: per window the up- and down-time summed over the servers, the spikes over the samples of all servers
    laid end to end in server order, and the number of ``servers``.

    Spikes are those per server, less one for every server that starts low right after a server that ended low.
    """
    measures = {**_gap_measures(now, windows), **_spike_measures(now, threshold, windows)}
    chosen = dated(samples, now - max(windows.values()), now)
    found = step_totals(chosen, ["server_id"], "date", measures, _edge_measures(now, threshold, windows), state=_lowest())
    order = Window.partitionBy().orderBy("server_id").rowsBetween(Window.unboundedPreceding, -1)
    for tag in windows:
        joined = F.col(f"first_{tag}.low") & F.last(f"last_{tag}.low", ignorenulls=True).over(order)
        again = F.when(F.coalesce(joined, F.lit(False)), 1).otherwise(0)
        found = found.withColumn(f"low_tps_spikes_{tag}", F.col(f"low_tps_spikes_{tag}") - again)
    return found.agg(F.count("*").alias("servers"), *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in measures])


def pooled_spikes(samples, now: int, threshold: float, windows=WINDOWS) -> DataFrame:
    """Spikes over the samples of all servers laid end to end in server order."""
    return pooled_steps(samples, now, threshold, windows).select(*[f"low_tps_spikes_{t}" for t in windows])


def metric_series(samples, metric: str, a, b, servers=None) -> DataFrame:
    """``(server_id, date, y)`` of one metric without missing points."""
    y = F.col(metric).cast("double")
    return dated(samples, a, b, servers).select("server_id", "date", y.alias("y")).where(F.col("y").isNotNull() & (F.col("y") != -1))


def tick_jitter(samples) -> DataFrame:
    """Mean and largest absolute change of the mean tick time between neighbouring samples of a server."""
    measured = _instants(samples.where(F.col("mspt_average").isNotNull()), F.max("mspt_average").alias("mspt"))
    steps = with_previous(measured, ["server_id"], "date", ["mspt"])
    change = F.abs(F.col("mspt") - F.col("prev.mspt"))
    return steps.groupBy("server_id").agg(F.avg(change).alias("jitter_average"), F.max(change).alias("jitter_max"))
