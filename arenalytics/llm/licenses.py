"""Known licences by the digest of their canonical text.

A line is lower-cased, its signs become blanks and equivalent spellings one. A text is its lines joined by blanks, without copyright
lines and empty lines, so line breaks don't matter. The digest of the whole text, and of each of its lines, is looked up among
those of known licence texts and notices.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arenalytics.llm.common import stored
from arenalytics.llm.decontamination import LOWER, PARTS, UPPER
from arenalytics.llm.licence_texts import EQUIVALENTS, NOTICES, TEXTS

BROADCAST_DIGESTS = 100_000
"""Up to so many known digests, of some 100 bytes, are sent to every executor; more are joined by a shuffle of all lines' digests."""

COPYRIGHT = r"^(all rights reserved|(portions )?(c )?copyright ((c|by) |©|[0-9]).*|© .*)$"


def canonical_line(line: Column) -> Column:
    plain = F.octet_length(line) == F.char_length(line)
    lowered = F.when(plain, F.lower(line)).otherwise(F.translate(line, UPPER, LOWER))
    words = F.trim(F.regexp_replace(lowered, PARTS, " "))
    return reduce(lambda text, pair: F.replace(text, F.lit(pair[0]), F.lit(pair[1])), EQUIVALENTS.items(), words)


def canonical_lines(text: Column) -> Column:
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), canonical_line)


def canonical_text(lines: Column) -> Column:
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~x.rlike(COPYRIGHT)), " ")


def known_rows() -> list[tuple[str, str]]:
    """Built-in licence texts, also under their title, and notices."""
    titles = {"MIT": "MIT License", "ISC": "ISC License", "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License"}
    rows = [(name, text) for name, text in TEXTS.items()]
    rows += [(name, f"{titles[name]}\n\n{text}") for name, text in TEXTS.items() if name in titles]
    rows += [(name, text) for name, texts in NOTICES.items() for text in texts]
    return rows


def known_licences(spark: SparkSession) -> DataFrame:
    """(licence, text) of the built-in rows; any such table will do."""
    return spark.createDataFrame(known_rows(), "licence string, text string")


def digests(licences: DataFrame) -> DataFrame:
    """(known, licence): digests of the canonical texts, and of one-line texts as lines; the least name of equal texts."""
    lines = licences.select("licence", canonical_lines(F.col("text")).alias("lines"))
    whole = lines.select("licence", canonical_text(F.col("lines")).alias("text"))
    single = lines.where(F.size("lines") == 1).select("licence", F.get("lines", F.lit(0)).alias("text"))
    every = whole.union(single).where("text != ''").select(F.sha2("text", 256).alias("known"), "licence")
    return every.groupBy("known").agg(F.min("licence").alias("licence"))


def license_scan(
    docs: DataFrame, licences: DataFrame, doc_id: str = "doc_id", text: str = "text", broadcast_digests: int = BROADCAST_DIGESTS
) -> DataFrame:
    """(key, digest, licence, notices) per document.

    ``digest`` is that of the whole canonical text, ``licence`` the licence whose text it is, or null; ``notices`` the sorted names
    of licences and notices that stand on a line of their own. Null, empty and blank texts have the digest of the empty
    text and no licence. Rows with the same id and text give repeated rows. Other columns aren't read. Empty tables give
    empty results, an empty licence table finds nothing. Known digests are counted first; while they are few, lines meet
    them where they are, and only whole texts and hits are shuffled.
    """
    known = stored(digests(licences), "digests")
    known = F.broadcast(known) if known.count() <= broadcast_digests else known
    own = docs.select(F.col(doc_id).alias("key"), F.xxhash64(text).alias("tie"), canonical_lines(F.col(text)).alias("lines"))
    own = own.withColumn("texts", F.concat(F.array(canonical_text(F.col("lines"))), "lines"))
    each = own.select("key", "tie", F.posexplode_outer("texts").alias("place", "text"))
    each = each.where((F.col("place") == 0) | (F.col("text") != ""))
    each = each.select("key", "tie", (F.col("place") == 0).alias("whole"), F.sha2("text", 256).alias("digest"))
    found = each.join(known, F.col("digest") == F.col("known"), "left").where(F.col("whole") | F.col("licence").isNotNull())
    merged = found.groupBy("key", "tie").agg(
        F.max(F.when(F.col("whole"), F.col("digest"))).alias("digest"),
        F.max(F.when(F.col("whole"), F.col("licence"))).alias("licence"),
        F.array_sort(F.collect_set(F.when(~F.col("whole"), F.col("licence")))).alias("notices"),
        F.count_if("whole").cast("int").alias("copies"),
    )
    return merged.select("key", "digest", "licence", "notices", F.explode(F.sequence(F.lit(1), "copies"))).drop("col")
