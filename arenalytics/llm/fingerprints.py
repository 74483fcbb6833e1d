"""Mergeable document fingerprints: every shingle hash below a fixed fraction of all hashes.

A sketch holds all hashes of 5-word shingles in the lowest eighth of the range, and the least hash, so that a short text's sketch is
not empty. Sketches of parts merge into that of the whole by union; shared hashes estimate likeness and containment, also
between texts of very unequal length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arenalytics.llm.common import stored
from arenalytics.llm.decontamination import words

SHINGLE = 5
FRACTION = 8
"""One hash in so many is kept."""
_BOUND = -(1 << 63) + (1 << 64) // FRACTION


def with_sketch(frame: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the sorted sketch of ``text``.

    Fewer words than a shingle are one shingle; a text of signs only is one as it stands; a null or empty text has an empty
    sketch. The columns on the way are named ``_hashes`` and ``_shingles`` and dropped.
    """
    size = F.size("_hashes")
    last = size - SHINGLE
    runs = F.transform(
        F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(F.col("_hashes"), i + k) for k in range(SHINGLE)])
    )
    none = F.array().cast("array<bigint>")
    shingles = (
        F.when(last >= 0, runs)
        .when(size > 0, F.array(F.xxhash64("_hashes")))
        .when(F.octet_length(F.col(text)) > 0, F.array(F.xxhash64(F.col(text))))
        .otherwise(none)
    )
    low = F.filter("_shingles", lambda h: h < _BOUND)
    kept = F.when(F.size("_shingles") > 0, F.array_sort(F.array_distinct(F.concat(low, F.array(F.array_min("_shingles"))))))
    frame = frame.withColumn("_hashes", F.transform(words(F.col(text)), lambda w: F.xxhash64(w)))
    frame = frame.withColumn("_shingles", shingles)
    return frame.withColumn(name, F.coalesce(kept, none)).drop("_hashes", "_shingles")


def merged(a: Column, b: Column) -> Column:
    """Sketch of two parts together."""
    return F.array_sort(F.array_union(a, b))


def likeness(a: Column, b: Column) -> Column:
    """Shared share of all hashes of two sketches, 1 if both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def containment(a: Column, b: Column) -> Column:
    """Share of the hashes of ``a`` that ``b`` has, 1 if ``a`` is empty."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def as_text(sketch: Column) -> Column:
    """A sketch as the hexadecimal digits of its hashes, 16 each."""
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def neighbours(ids: DataFrame) -> DataFrame:
    """(key, name, tie, n_chars, next_name, next_tie): the next document by descending id of (key, name, tie, n_chars).

    Ranges of ids are ordered in parallel; only the first row of each range is put in order with the others. Rows of one id
    are ordered by the hash of their text, null ids come last, the first document follows the last.
    """
    rows = ids.repartitionByRange(F.desc("key"), "tie").withColumn("range", F.spark_partition_id())
    rows = stored(rows, "ordered-ids")
    within = Window.partitionBy("range").orderBy(F.desc("key"), "tie")
    own = F.struct("name", "tie")
    rows = rows.withColumn("next", F.lead(own).over(within)).withColumn("nth", F.row_number().over(within))
    heads = rows.where("nth = 1").select("range", own.alias("head"))
    over = Window.orderBy("range")
    follow = F.coalesce(F.lead("head").over(over), F.first("head").over(over))
    heads = heads.select(F.col("range").alias("after"), follow.alias("follow"))
    rows = rows.join(heads, F.col("range") == F.col("after")).withColumn("next", F.coalesce("next", "follow"))
    return rows.select("key", "name", "tie", "n_chars", F.col("next.name").alias("next_name"), F.col("next.tie").alias("next_tie"))


def edited_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, sketch, edited, edited_sketch, next_sketch) of every document.

    ``edited`` is the text with its last floor(n / 2) code points replaced by as many first ones (or all) of the next document by
    descending id. A null text is empty. Rows with the same id and text are one document and give repeated rows. Other
    columns aren't read; an empty table gives an empty result. Texts are shuffled once by id and text hash for both joins.
    """
    plain = F.coalesce(F.col(text), F.lit(""))
    # An empty id is another than none.
    name = F.coalesce(F.concat(F.lit("="), F.col(doc_id).cast("string")), F.lit(""))
    base = docs.select(F.col(doc_id).alias("key"), name.alias("name"), F.xxhash64(plain).alias("tie"), plain.alias("text"))
    links = neighbours(base.select("key", "name", "tie", F.char_length("text").alias("n_chars")).distinct())
    # Both joins need the same columns of the texts, so that Spark deals them out once.
    texts = with_sketch(base.drop("key"), "text", "sketch").repartition("name", "tie")
    copy = F.row_number().over(Window.partitionBy("name", "tie").orderBy("name"))
    source = texts.withColumn("copy", copy).where("copy = 1")
    source = source.select(F.col("name").alias("next_name"), F.col("tie").alias("next_tie"), F.col("text").alias("next_text"), F.col("sketch").alias("next_sketch"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    parts = links.join(source, ["next_name", "next_tie"]).select(
        "key", "name", "tie", "n_chars", F.substring("next_text", F.lit(1), half).alias("part"), "next_sketch"
    )
    whole = texts.join(parts, ["name", "tie"])
    whole = whole.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars") - half), "part"))
    whole = whole.select("key", F.col("n_chars").cast("bigint").alias("n_chars"), "sketch", "edited", "next_sketch")
    return with_sketch(whole, "edited", "edited_sketch")
