"""Repeated runs of lines across documents, found by winnowing over line hashes.

A run is long enough if it has 50 words or three non-blank lines. Its fingerprint is the least of its line hashes, so equal
runs have equal fingerprints wherever they stand. The least lines of all windows are counted once per place; only
windows whose least line stands at a second place are compared, by two 64-bit hashes of all their lines. Every occurrence of a window but the first is
deleted. Documents are ordered by id.

With ``whole_runs`` the windows are all long enough runs of one, two or three lines. A line of a longer repeated run is in
three lines of it that are repeated too, so every line of every maximal repeated run goes, however far it extends both ways.
Without, a window is only the shortest long enough run from a line on: up to two short lines at the end of a repeated
run stay if they start no window.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arenalytics.llm.common import stored

LINES = 3
WORDS = 50


def line_list(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _lines(text: Column) -> Column:
    """Non-blank lines: place, two hashes, number of words (blanks and one)."""

    def one(line: Column, place: Column) -> Column:
        words = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1
        blank = F.trim(line) == ""
        return F.struct(
            place.alias("place"), F.xxhash64(line).alias("h"), F.xxhash64(F.lit(LINES), line).alias("g"),
            F.when(blank, 0).otherwise(words).alias("words"),
        )

    return F.filter(F.transform(line_list(text), one), lambda x: x["words"] > 0)


def _windows(lines: str, whole_runs: bool) -> Column:
    """Windows: the places of their lines, their least line hash and its place, and two hashes of all their lines."""

    def of(size: int) -> Callable[[Column, Column], Column]:
        return lambda first, i: one(size, first, i)

    def one(size: int, first: Column, i: Column) -> Column:
        own = [first, *[F.get(F.col(lines), i + k) for k in range(1, size)]]
        words = reduce(add, [x["words"] for x in own])
        long = F.lit(True) if size == LINES else words >= WORDS
        if not whole_runs and size > 1:
            long = long & (words - own[-1]["words"] < WORDS)
        least = F.array_min(F.array(*[F.struct(x["h"].alias("h"), x["place"].alias("place")) for x in own]))
        window = F.struct(
            i.alias("i"), F.array(*[x["place"] for x in own]).alias("places"),
            least["h"].alias("fingerprint"), least["place"].alias("least"),
            F.xxhash64(*[x["h"] for x in own]).alias("c"), F.xxhash64(*[x["g"] for x in own]).alias("d"),
        )
        return F.when(own[-1].isNotNull() & long, window)

    return F.array_compact(F.concat(*[F.transform(lines, of(size)) for size in range(1, LINES + 1)]))


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", whole_runs: bool = False) -> DataFrame:
    """(key, tie, places): per document the places of lines in windows that stand earlier, in it or in another document."""
    own = docs.select(F.col(doc_id).alias("key"), F.xxhash64(text).alias("tie"), _lines(F.col(text)).alias("lines"))
    own = stored(own.where(F.size("lines") > 0), "lines").withColumn("windows", _windows("lines", whole_runs))
    places = F.array_distinct(F.transform("windows", lambda w: F.struct(w["fingerprint"].alias("fingerprint"), w["least"].alias("least"))))
    anchors = own.select(F.explode(places).alias("anchor")).select("anchor.fingerprint")
    again = anchors.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").select("fingerprint")
    each = own.select("key", "tie", F.explode("windows").alias("w")).select("key", "tie", "w.i", "w.places", "w.fingerprint", "w.c", "w.d")
    met = stored(each.join(stored(again, "fingerprints"), "fingerprint", "left_semi").drop("fingerprint"), "windows")
    where = F.struct("key", "tie", "i")
    first = met.groupBy("c", "d").agg(F.min(where).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = met.join(stored(first, "first-windows"), ["c", "d"]).where(where > F.col("first"))
    places = later.select("key", "tie", F.explode("places").alias("place")).distinct()
    return places.groupBy("key", "tie").agg(F.collect_list("place").alias("places"))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", whole_runs: bool = False) -> DataFrame:
    """All columns of ``docs`` with the repeated lines taken out of ``text``, as column ``row``, and n_lines, n_deleted.

    ``whole_runs`` takes out every line of a repeated run, also the short ones at its end.

    A null text stays null and has one empty line; blank lines are never part of a run and stay. Rows with the same id
    and text are one document: they give repeated rows with one result. Rows with the same id are ordered by a hash
    of their text; null ids come first. An empty table gives an empty result. Other columns keep their names, as
    they only appear inside ``row``.
    """
    places = repeated_lines(docs, doc_id, text, whole_runs).select(F.col("key").alias("k"), F.col("tie").alias("t"), "places")
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("key"), F.xxhash64(text).alias("tie"))
    found = rows.join(places, F.col("key").eqNullSafe(F.col("k")) & (F.col("tie") == F.col("t")), "left")
    old = F.col("row").getField(text)
    # A column of its own that is used twice, or Spark would split the text anew for each line.
    found = found.withColumn("all", line_list(old))
    left = F.array_except(F.sequence(F.lit(0), F.size("all") - 1), "places")
    kept = F.transform(left, lambda i: F.get("all", i))
    new = F.when(F.col("places").isNull(), old).otherwise(F.array_join(kept, "\n"))
    return found.select(
        F.col("row").withField(f"`{text}`", new).alias("row"),
        F.size("all").cast("bigint").alias("n_lines"),
        F.coalesce(F.size("places"), F.lit(0)).cast("bigint").alias("n_deleted"),
    )
