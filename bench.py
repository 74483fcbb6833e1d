"""Time the headline queries on stored tables: prints one JSON line.

The domain tables are derived from the test tables and stored as parquet once, untimed; the queries then read
stored tables as a user's would. Each value is the median of warm runs, in seconds.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import catalog  # noqa: E402
from arenalytics.session import get_session  # noqa: E402
from catalog.domain import Domain  # noqa: E402

HEADLINE = [
    "act_5_group_counts", "act_5_regular_players", "act_10_regular_turned_inactive", "act_13_weekly_group_counts",
    "ses_5_playtime_per_server", "ses_21_length_stats", "ses_23_activity_block", "pc_2_unique_per_day", "pc_7_retained_players",
    "ret_3_curve_by_time", "ret_6_alive_by_date",
    "tps_1_in_resolution", "tps_6_occupied_time", "tps_7_uptime", "tps_8_downtime", "tps_9_low_tps_spikes", "tps_14_averages",
    "tps_18_latest_start", "tps_23_performance_numbers",
    "join_2_assembled_sessions", "join_7b_lonely_joins", "join_8_ping_per_session", "png_2_by_geolocation",
    "kil_3_average_kdr", "ja_1_latest_counts_per_server", "top_1_playtime", "wld_1_server_totals", "clk_1_clock_segments",
    "seg_0_path", "tbl_1_network_players", "kpi_network", "rep_1_online_activity_numbers", "rep_4_playerbase",
    "str_1_sessions_batch", "str_2_afk_batch", "str_5_minute_rollup_batch",
]
STORED = [
    "servers", "ev", "sessions", "users", "user_info", "samples", "ping", "kills", "geolocations", "nicknames", "join_address",
    "worlds", "world_times", "session_events", "pulses", "country_codes",
]
RUNS = 3


class Stored(Domain):
    """The domain tables read back from parquet."""

    def __init__(self, spark, sf_dir: str, root: str):
        super().__init__(spark, sf_dir)
        for name in STORED:
            self._made[name] = spark.read.parquet(os.path.join(root, name))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    catalog.load()
    spark = get_session(
        "bench",
        **{
            "spark.master": f"local[{cpus}]", "spark.driver.memory": "16g", "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": cpus, "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    root = tempfile.mkdtemp(prefix="bench-", dir="/tmp")
    derived = Domain(spark, sf_dir)
    for name in STORED:
        getattr(derived, name).write.parquet(os.path.join(root, name))
    times, jobs = {}, {}
    for name in HEADLINE:
        runs = []
        for i in range(RUNS + 1):
            stored = Stored(spark, sf_dir, root)
            spark.sparkContext.setJobGroup(f"{name}-{i}", name)
            started = time.perf_counter()
            catalog.FUNCTIONS[name](stored).write.format("noop").mode("overwrite").save()
            if i:
                runs.append(time.perf_counter() - started)
        times[name] = round(statistics.median(runs), 4)
        jobs[name] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"{name}-{RUNS}"))
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                "spark_jobs": jobs, "sf": float(Path(sf_dir).name.removeprefix("sf")), "runs": RUNS, "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
