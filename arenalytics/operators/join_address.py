"""Join addresses: clean-up, redaction, latest address, distribution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arenalytics.functions.clock import day
from arenalytics.functions.windows import after_until, scope

UNKNOWN = "unknown"
# Fixed value: the sample pattern of the default configuration switches redaction off.
SAMPLE_PATTERN = r"play\.example\.com"


def _full_match(c: Column, patterns: Sequence[str]) -> Column:
    return c.rlike("^(?:" + "|".join(f"(?:{p})" for p in patterns) + ")$")


def sanitize(address: Column, blocked: Sequence[str] = (), keep_case: bool = False) -> Column:
    """Drop the port, proxy data after NUL and mod-loader suffixes, lower-case, blank blocked addresses."""
    c = F.regexp_replace(address, ":[^:]*$", "")
    c = F.substring_index(c, "\u0000", 1)
    c = F.regexp_replace(c, "(?s)fml(?!.*fml).*$", "")
    c = c if keep_case else F.lower(c)
    c = F.when(_full_match(c, blocked), F.lit("")).otherwise(c) if blocked else c
    return F.coalesce(c, F.lit(""))


def is_valid(address: Column, accept_any: bool = False) -> Column:
    """Not empty and, read as a URI, with a dot in its path."""
    if accept_any:
        return address != ""
    path = F.regexp_replace(F.regexp_replace(address, "[?#].*$", ""), "^//[^/]*", "")
    legal = ~address.rlike(r"[\s\"<>\\^`{|}\x00-\x1f\x7f]") & ~address.rlike("^[^/?#]*:(?!/)")
    return legal & path.contains(".")


def sanitized_table(join_address: DataFrame, blocked: Sequence[str] = ()) -> DataFrame:
    clean = sanitize(F.col("join_address"), blocked)
    return join_address.select("id", clean.alias("join_address"), is_valid(clean).alias("valid"))


def redact(df: DataFrame, patterns: Sequence[str], column: str = "join_address") -> DataFrame:
    """Replace addresses that match a pattern by "unknown"."""
    if not patterns or list(patterns) == [SAMPLE_PATTERN]:
        return df
    c = F.col(column)
    return df.withColumn(column, F.when(_full_match(c, patterns), F.lit(UNKNOWN)).otherwise(c))


def redact_counts(counts: DataFrame, patterns: Sequence[str], by: Sequence[str] = (), measure: str = "players") -> DataFrame:
    """Fold the counts of matching addresses into the "unknown" row."""
    folded = redact(counts, patterns)
    return folded.groupBy(*by, "join_address").agg(F.sum(measure).alias(measure))


def latest_counts(sessions: DataFrame, join_address: DataFrame) -> DataFrame:
    """Users per address of their session with the greatest id."""
    latest = sessions.groupBy("user_id").agg(F.max_by("join_address_id", "id").alias("id"))
    per_id = latest.groupBy("id").agg(F.count("*").alias("n"))
    return per_id.join(join_address, "id").groupBy("join_address").agg(F.sum("n").alias("players"))


def _newest(sessions: DataFrame, keys: Sequence[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("session_start").desc())
    ranked = sessions.select(*keys, "join_address_id", "session_start", F.rank().over(order).alias("_r"))
    return ranked.where(F.col("_r") == 1).drop("_r", "session_start")


def latest_counts_per_server(sessions: DataFrame, join_address: DataFrame) -> DataFrame:
    """Per server, users by the address of their newest session there (ties kept)."""
    per_id = _newest(sessions, ["user_id", "server_id"]).groupBy("server_id", "join_address_id").agg(F.count("*").alias("n"))
    named = per_id.join(join_address.select(F.col("id").alias("join_address_id"), "join_address"), "join_address_id")
    return named.groupBy("server_id", "join_address").agg(F.sum("n").alias("players"))


def latest_of_users(sessions: DataFrame, join_address: DataFrame, keys: Sequence[str] = ("user_id",)) -> DataFrame:
    names = join_address.select(F.col("id").alias("join_address_id"), "join_address")
    return _newest(sessions, list(keys)).join(names, "join_address_id").select(*keys, "join_address")


def per_day(sessions: DataFrame, join_address: DataFrame, a: int, b: int, offset=0, servers=None, addresses: Sequence[str] = (), by=()) -> DataFrame:
    """Distinct users per local day and address, window ``(a, b]``."""
    chosen = scope(sessions, servers).where(after_until("session_start", a, b))
    names = join_address.select(F.col("id").alias("join_address_id"), "join_address")
    if addresses:
        named = chosen.join(names.where(F.col("join_address").isin(list(addresses))), "join_address_id")
    else:
        named = chosen.join(names, "join_address_id", "left")
    return named.groupBy(*by, day("session_start", offset).alias("date"), "join_address").agg(F.countDistinct("user_id").alias("players"))


def all_addresses(join_address: DataFrame, sessions: DataFrame | None = None, servers=None) -> DataFrame:
    """Distinct addresses (of the servers' sessions) with "unknown" always present."""
    if sessions is not None:
        used = scope(sessions, servers).select(F.col("join_address_id").alias("id")).distinct()
        join_address = join_address.join(used, "id", "left_semi")
    unknown = join_address.sparkSession.range(1).select(F.lit(UNKNOWN).alias("join_address"))
    return join_address.select("join_address").unionByName(unknown).distinct()


def users_with_addresses(sessions: DataFrame, join_address: DataFrame, addresses: Sequence[str]) -> DataFrame:
    ids = join_address.where(F.col("join_address").isin(list(addresses))).select(F.col("id").alias("join_address_id"))
    return sessions.join(ids, "join_address_id", "left_semi").select("user_id").distinct()
