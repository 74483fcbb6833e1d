"""Declared table schemas as DDL. Timestamps and durations are bigint milliseconds."""

from __future__ import annotations

from pyspark.sql.types import StructType

TABLES = {
    "users": "id bigint, uuid string, registered bigint, name string, times_kicked int",
    "servers": "id int, uuid string, name string, web_address string, is_installed boolean, is_proxy boolean, plan_version string",
    "user_info": "id bigint, user_id bigint, server_id int, join_address string, registered bigint, opped boolean, banned boolean",
    "sessions": "id bigint, user_id bigint, server_id int, session_start bigint, session_end bigint, mob_kills int, "
    "deaths int, afk_time bigint, join_address_id int",
    "world_times": "user_id bigint, world_id int, server_id int, session_id bigint, survival_time bigint, "
    "creative_time bigint, adventure_time bigint, spectator_time bigint",
    "worlds": "id int, world_name string, server_uuid string",
    "kills": "id bigint, killer_uuid string, victim_uuid string, server_uuid string, server_id int, weapon string, date bigint, session_id bigint",
    "samples": "id bigint, server_id int, date bigint, tps double, players_online int, cpu_usage double, ram_usage bigint, "
    "entities int, chunks_loaded int, free_disk_space bigint, mspt_average double, mspt_95th double, "
    "mspt_jitter_avg double, mspt_jitter_max double",
    "ping": "id bigint, user_id bigint, server_id int, date bigint, max_ping int, min_ping int, avg_ping double",
    "geolocations": "user_id bigint, geolocation string, last_used bigint",
    "nicknames": "uuid string, nickname string, server_uuid string, last_used bigint",
    "join_address": "id int, join_address string",
    "allowlist_bounce": "uuid string, name string, server_id int, times bigint, last_bounce bigint",
    "plugin_versions": "id bigint, server_id int, plugin_name string, version string, modified bigint",
    "statistic": "id int, name string",
    "statistic_value": "statistic_id int, user_id bigint, server_id int, value int",
    "access_log": "id bigint, time bigint, from_ip string, method string, uri string, response_code int",
    "metric_plugins": "id int, name string, last_updated bigint, server_id int, version string",
    "metric_providers": "id int, name string, text string, type string, plugin_id int, format string, show_in_table boolean, "
    "provided_condition string, condition string, tab string, icon string, priority int, hidden boolean",
    "metric_user_values": "user_id bigint, provider_id int, boolean_value boolean, double_value double, "
    "percentage_value double, long_value bigint, string_value string, component_value string, group_value string",
    "metric_server_values": "server_id int, provider_id int, boolean_value boolean, double_value double, "
    "percentage_value double, long_value bigint, string_value string, component_value string",
    "metric_groups": "user_id bigint, provider_id int, group_name string",
    "metric_history": "id bigint, provider_id int, server_id int, date bigint, double_value double, long_value bigint",
    "metric_table_headers": "id int, name string, col_1 string, col_2 string, col_3 string, col_4 string, col_5 string, plugin_id int",
    "metric_user_table_rows": "table_id int, user_id bigint, row_number bigint, col_1 string, col_2 string, col_3 string, col_4 string, col_5 string",
    "metric_server_table_rows": "table_id int, server_id int, row_number bigint, col_1 string, col_2 string, col_3 string, col_4 string, col_5 string",
    "session_events": "event_id bigint, user_id bigint, server_id int, kind string, date bigint, world string, mode int",
}


def struct(name: str) -> StructType:
    """The schema as a StructType (needs a running session)."""
    return StructType.fromDDL(TABLES[name])
