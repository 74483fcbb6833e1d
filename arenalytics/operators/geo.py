"""Geolocations of users and of addresses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arenalytics.functions.ordered import last_known
from arenalytics.functions.windows import restrict


def last_used(geolocations) -> DataFrame:
    return geolocations.groupBy("user_id", "geolocation").agg(F.max("last_used").alias("last_used"))


def latest_geolocations(geolocations) -> DataFrame:
    """``(user_id, geolocation)`` last used by each user, ties kept."""
    newest = Window.partitionBy("user_id").orderBy(F.col("last_used").desc())
    ranked = last_used(geolocations).withColumn("_r", F.rank().over(newest))
    return ranked.where(F.col("_r") == 1).select("user_id", "geolocation")


def counts(geolocations, users: DataFrame | None = None) -> DataFrame:
    """Users per latest geolocation, optionally of a user set."""
    latest = restrict(latest_geolocations(geolocations), users)
    return latest.groupBy("geolocation").agg(F.count("*").alias("users"))


def counts_per_server(geolocations, user_info) -> DataFrame:
    placed = user_info.select("user_id", "server_id").distinct().join(latest_geolocations(geolocations), "user_id")
    return placed.groupBy("server_id", "geolocation").agg(F.count("*").alias("users"))


def unique(geolocations) -> DataFrame:
    return geolocations.select("geolocation").distinct().orderBy("geolocation")


def users_in(geolocations, wanted: Sequence[str]) -> DataFrame:
    """Users that ever used one of the geolocations, compared case-insensitively."""
    return geolocations.where(F.lower("geolocation").isin([w.lower() for w in wanted])).select("user_id").distinct()


def most_recent(geolocations) -> DataFrame:
    return geolocations.groupBy("user_id").agg(F.max_by("geolocation", F.struct("last_used", "geolocation")).alias("geolocation"))


def top(location_counts: DataFrame, n: int = 20) -> DataFrame:
    return location_counts.orderBy(F.col("users").desc(), F.col("geolocation").asc()).limit(n)


def with_codes(location_counts: DataFrame, codes: DataFrame) -> DataFrame:
    """Counts by country code; ``codes`` has (name, code). Unknown names are dropped."""
    names = codes.select(F.lower("name").alias("_name"), "code")
    return location_counts.join(names, F.lower("geolocation") == F.col("_name")).select("code", "users")


def ip_number(ip: Column) -> Column:
    """IPv4 text as a bigint, null when it is something else."""
    parts = F.split(ip, r"\.")
    number = sum((F.get(parts, F.lit(i)).cast("bigint") * 256 ** (3 - i) for i in range(4)), F.lit(0).cast("bigint"))
    return F.when(ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), number)


def _inside(number: Column, first: str, bits: int) -> Column:
    a = sum(int(p) * 256 ** (3 - i) for i, p in enumerate(first.split(".")))
    return (number >= a) & (number < a + 2 ** (32 - bits))


V4 = "00000000000000000000ffff"
"""The first 96 bits of an IPv4 address as an IPv6 one, in hexadecimal digits."""


def address_bits(ip: Column) -> Column:
    """An IPv4 or IPv6 text as 128 binary digits, IPv4 as its mapped IPv6 form; null when it is neither."""

    def dotted(text: Column) -> Column:
        parts = F.split(text, r"\.")
        return F.concat(*[F.lpad(F.lower(F.hex(F.get(parts, F.lit(i)).cast("int"))), 2, "0") for i in range(4)])

    def groups(text: Column) -> Column:
        """Groups of four digits; a dotted end is two groups."""
        listed = F.filter(F.split(text, ":"), lambda g: g != "")
        return F.flatten(F.transform(listed, lambda g: F.when(g.contains("."), F.array(F.substring(dotted(g), 1, 4), F.substring(dotted(g), 5, 4))).otherwise(F.array(F.lpad(F.lower(g), 4, "0")))))

    sides = F.split(ip, "::", -1)
    left, right = groups(F.get(sides, F.lit(0))), groups(F.coalesce(F.get(sides, F.lit(1)), F.lit("")))
    missing = F.lit(8) - F.size(left) - F.size(right)
    zeros = F.array_repeat(F.lit("0000"), F.when(F.size(sides) == 2, missing).otherwise(0))
    digits = F.array_join(F.concat(left, zeros, right), "")
    octet = r"(25[0-5]|2[0-4]\d|1?\d?\d)"
    v4 = ip.rlike(rf"^{octet}(\.{octet}){{3}}$")
    group = "[0-9a-fA-F]{1,4}"
    end = rf"({group}|{octet}(\.{octet}){{3}})"
    v6 = ip.rlike(rf"^(({group}:)+{end}|(({group}:)*{group})?::(({group}:)*{end})?)$") & (F.length(digits) == 32)
    v6 = v6 & ((F.size(sides) == 1) | (missing > 0))
    whole = F.when(v4, F.concat(F.lit(V4), dotted(ip))).when(v6, digits)
    words = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.lpad(F.conv(F.substring(whole, i * 8 + 1, F.lit(8)), 16, 2), 32, "0"))
    return F.when(whole.isNotNull(), F.array_join(words, ""))


def prefixes(networks: DataFrame, cidr: str = "cidr") -> DataFrame:
    """Adds to networks ``prefix``, the digits that all their addresses begin with, and its length ``bits``; null where it isn't a network."""
    parts = F.split(cidr, "/")
    digits = address_bits(F.get(parts, F.lit(0)))
    own = F.coalesce(F.get(parts, F.lit(1)).try_cast("int"), F.when(F.get(parts, F.lit(0)).contains(":"), 128).otherwise(32))
    bits = F.when(F.get(parts, F.lit(0)).contains(":"), own).otherwise(own + 96)
    named = networks.withColumn("bits", F.when(digits.isNotNull() & bits.between(0, 128), bits))
    return named.withColumn("prefix", F.substring(digits, F.lit(1), F.col("bits")))


def locate_by_prefix(addresses: DataFrame, networks: DataFrame, ip: str = "ip") -> DataFrame:
    """Distinct addresses with the country of the longest network that holds them; IPv4, IPv6 and networks within networks.

    Networks are (cidr, country); of equal ones the first country in order counts. For every length that occurs, at most 129 of
    them, an address looks its first digits up by hash, so no address is compared with a range. What is no address is "Not Found".
    """
    known = prefixes(networks).where("prefix is not null").groupBy("bits", "prefix").agg(F.min("country").alias("country"))
    lengths = sorted(r.bits for r in known.select("bits").distinct().collect())
    named = addresses.select(ip).distinct().withColumn("digits", address_bits(F.col(ip)))
    asked = named.select(ip, "digits", F.explode(F.array(*[F.lit(n) for n in lengths]).cast("array<int>")).alias("bits"))
    asked = asked.select(ip, "bits", F.substring("digits", F.lit(1), F.col("bits")).alias("prefix"))
    found = asked.join(known, ["bits", "prefix"]).groupBy(ip).agg(F.max_by("country", "bits").alias("country"))
    return named.select(ip).join(found, ip, "left").select(ip, F.coalesce("country", F.lit("Not Found")).alias("country"))


def locate(addresses: DataFrame, ranges: DataFrame, ip: str = "ip") -> DataFrame:
    """Distinct addresses with their country. ``ranges`` holds disjoint (first, last, country) numbers.

    Every address looks up the last range that starts at or before it; the lookup is cut into /16 blocks.
    """
    c = F.col(ip)
    named = addresses.select(ip).distinct().withColumn("_n", ip_number(c))
    states = ranges.select(F.col("first").alias("_n"), F.struct("last", "country").alias("range"))
    found = last_known(states, named.where(F.col("_n").isNotNull()).select("_n"), [], "_n", "range", 65536)
    n = F.col("_n")
    private = _inside(n, "10.0.0.0", 8) | _inside(n, "172.16.0.0", 12) | _inside(n, "192.168.0.0", 16)
    return named.join(found, "_n", "left").select(
        ip,
        F.when(c.contains("127.0.0.1"), "Local Machine")
        .when(private, "Local Private Network")
        .when(F.col("range.last") >= n, F.col("range.country"))
        .otherwise("Not Found")
        .alias("country"),
    )
