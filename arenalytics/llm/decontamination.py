"""Passages of benchmark items in documents, found by winnowing.

A window is 10 consecutive item words. Its fingerprint is the least hash of the 5-word runs in it; a run of windows with one
fingerprint is kept once. Documents and items choose fingerprints by the same rule, so every shared window has a
shared fingerprint, and only windows with one are compared, word by word. Items of fewer words are one window each and
are anchored at their first 5-word run, or first word, instead.

All steps are built-in functions on arrays: words, their hashes, 5-word hashes, window minima, runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arenalytics.llm.common import stored

WINDOW = 10
GRAM = 5
# What parts words, and the letters that are lower-cased.
PARTS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DOCUMENT, RUN, GRAM_START, WORD_START = range(4)
BROADCAST_ANCHORS = 4_000_000
"""Up to so many anchors (of some 24 bytes) are sent to every executor; more are joined by a shuffle."""


def words(text: Column) -> Column:
    """Words of a text with A-Z in lower case; null has none."""
    plain = F.octet_length(text) == F.char_length(text)
    lowered = F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(F.coalesce(lowered, F.lit("")), PARTS), "")


def _places(count: Column) -> Column:
    """0 .. count - 1, empty if there are none."""
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))


def hashed(frame: DataFrame) -> DataFrame:
    """Adds to ``words``: hashes of the words, of their 5-word runs, and the least of each window.

    Each column refers to the one before it more than once, or Spark would compute that anew inside the lambda.
    """
    word = F.transform("words", lambda w: F.xxhash64(w))
    gram = F.transform(
        _places(F.size("hashes") - (GRAM - 1)), lambda i: F.xxhash64(*[F.get(F.col("hashes"), i + k) for k in range(GRAM)])
    )
    least = F.transform(
        _places(F.size("grams") - (WINDOW - GRAM)), lambda i: F.array_min(F.slice("grams", i + 1, F.lit(WINDOW - GRAM + 1)))
    )
    return frame.withColumn("hashes", word).withColumn("grams", gram).withColumn("least", least)


def _anchor(kind: int, first: Column, last: Column, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), first.alias("first"), last.alias("last"), value.alias("anchor"))


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, n, window, kind, anchor): the windows of every item as texts of ``n`` words, and where they are anchored."""
    frame = hashed(items.select(F.col(item_id).cast("string").alias("item_id"), words(F.col(text)).alias("words")))
    frame = frame.where(F.size("words") > 0).withColumn("n", F.least(F.size("words"), F.lit(WINDOW)))
    frame = frame.withColumn("first", F.explode(_places(F.size("words") - F.col("n") + 1)))
    full, gram = F.col("n") == WINDOW, F.col("n") >= GRAM
    return frame.select(
        "item_id", "n",
        F.array_join(F.slice("words", F.col("first") + 1, F.col("n")), " ").alias("window"),
        F.when(full, RUN).when(gram, GRAM_START).otherwise(WORD_START).alias("kind"),
        F.when(full, F.get("least", F.col("first")))
        .when(gram, F.get("grams", F.lit(0))).otherwise(F.get("hashes", F.lit(0))).alias("anchor"),
    )


def document_anchors(frame: DataFrame, kinds: set[int]) -> Column:
    """The anchors of a document: one for itself (its number of words), its fingerprint runs, and short starts if asked for."""
    starts = F.filter(
        _places(F.size("least")), lambda i: (i == 0) | (F.get("least", i) != F.get("least", i - 1))
    )
    size = F.size("words")
    lists = [F.array(_anchor(DOCUMENT, size, size, F.lit(0).cast("bigint")))]
    if RUN in kinds:
        end = lambda j: F.coalesce(F.get("starts", j + 1), F.size("least")) - 1
        lists.append(F.transform("starts", lambda i, j: _anchor(RUN, i, end(j), F.get("least", i))))
    if GRAM_START in kinds:
        lists.append(F.transform("grams", lambda g, i: _anchor(GRAM_START, i, i, g)))
    if WORD_START in kinds:
        lists.append(F.transform("hashes", lambda h, i: _anchor(WORD_START, i, i, h)))
    return frame.withColumn("starts", starts).withColumn("anchors", F.concat(*lists))


def _windows(frame: DataFrame) -> DataFrame:
    """(key, tie, kind, first, n, window): a document row as it is, and the windows of anchors that were met."""
    own = F.when(F.col("kind") != DOCUMENT, F.sequence("first", F.least(F.col("last"), F.size("words") - F.col("n"))))
    ends = (F.col("kind") == DOCUMENT) | (F.col("first") + F.col("n") <= F.size("words"))
    frame = frame.where(ends).withColumn("at", F.explode_outer(own))
    text = F.when(F.col("at").isNotNull(), F.array_join(F.slice("words", F.col("at") + 1, F.col("n")), " "))
    return frame.select("key", "tie", "kind", F.coalesce("at", "first").alias("first"), "n", text.alias("window"))


def contamination(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", broadcast_anchors: int = BROADCAST_ANCHORS,
) -> tuple[DataFrame, DataFrame]:
    """Two tables: (key, tie, n_words, n_hit, item_ids) per document, and its hit spans (key, tie, first, n, window).

    ``key`` is the document's id and ``tie`` the hash of its text. A word is hit if it lies in any occurrence of a window
    of any item. Documents and items without words (null, empty, signs only) have no hits and no windows. Repeated rows
    give repeated rows; an item without an id marks words but isn't listed. Other columns aren't read. Empty
    tables give empty results, an empty item table no hits.
    """
    windows = stored(item_windows(items, item_id, item_text), "item-windows")
    anchors = windows.select(F.col("kind").alias("item_kind"), F.col("anchor").alias("item_anchor"), "n").distinct()
    found = windows.groupBy("kind").agg(F.countDistinct("anchor").alias("n")).collect()
    kinds = {r.kind for r in found}

    own = docs.select(F.col(doc_id).alias("key"), F.xxhash64(text).alias("tie"), words(F.col(text)).alias("words"))
    # The outer form keeps Spark from repeating the whole calculation in a filter of empty lists; no list is empty.
    rows = document_anchors(hashed(own), kinds).select("key", "tie", "words", F.explode_outer("anchors").alias("a"))
    rows = rows.select("key", "tie", "words", "a.*")
    met = (F.col("kind") == F.col("item_kind")) & (F.col("anchor") == F.col("item_anchor"))
    wanted = (F.col("kind") == DOCUMENT) | F.col("n").isNotNull()
    if sum(r.n for r in found) <= broadcast_anchors:
        candidates = _windows(rows.join(F.broadcast(anchors), met, "left").where(wanted))
    else:
        places = rows.drop("words").where(F.col("kind") != DOCUMENT).join(anchors, met)
        places = places.select("key", "tie", "kind", "first", "last", "n").distinct()
        again = own.select(F.col("key").alias("own_key"), F.col("tie").alias("own_tie"), "words").distinct()
        same = F.col("key").eqNullSafe(F.col("own_key")) & (F.col("tie") == F.col("own_tie"))
        size = F.size("words")
        whole = own.select("key", "tie", F.lit(DOCUMENT).alias("kind"), size.alias("first"), F.lit(None).cast("int").alias("n"))
        candidates = _windows(places.join(again, same)).union(whole.withColumn("window", F.lit(None).cast("string")))
    candidates = stored(candidates, "candidates")

    known = windows.select("n", "window").distinct()
    hits = candidates.where(F.col("kind") != DOCUMENT).join(known, ["n", "window"]).select("key", "tie", "first", "n", "window").distinct()
    hits = stored(hits, "hits")
    before = Window.partitionBy("key", "tie").orderBy("first", "n").rowsBetween(Window.unboundedPreceding, -1)
    stop = F.col("first") + F.col("n")
    fresh = F.greatest(stop - F.greatest(F.col("first"), F.coalesce(F.max(stop).over(before), F.lit(0))), F.lit(0))
    covered = hits.withColumn("fresh", fresh).groupBy("key", "tie").agg(F.sum("fresh").alias("n_hit"))
    named = hits.select("key", "tie", "n", "window").join(windows.select("n", "window", "item_id"), ["n", "window"])
    named = named.select("key", "tie", "item_id").distinct().groupBy("key", "tie").agg(F.collect_list("item_id").alias("item_ids"))
    whole = candidates.where(F.col("kind") == DOCUMENT).select("key", "tie", F.col("first").alias("n_words"))
    for part in (covered, named):
        part = part.select(F.col("key").alias("k"), F.col("tie").alias("t"), part.columns[-1])
        whole = whole.join(part, F.col("key").eqNullSafe(F.col("k")) & (F.col("tie") == F.col("t")), "left").drop("k", "t")
    empty = F.array().cast("array<string>")
    return whole.select(
        "key", "tie", F.col("n_words").cast("bigint").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.array_sort(F.coalesce("item_ids", empty)).alias("item_ids"),
    ), hits
