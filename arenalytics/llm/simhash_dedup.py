"""Near duplicates by SimHash and covering locality-sensitive hashing.

Bit i of a 64-bit fingerprint gets a non-zero vector m(i) of radius + 1 bits. For each non-zero vector v there is one table
whose mask keeps the bits with an odd product <m(i), v>. For up to ``radius`` bits some v has an even product
with all of them, so any two fingerprints that differ in those bits only meet in the table of that v.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arenalytics.llm.common import map_blocks, result, stored
from arenalytics.llm.graph import components, links

SEED = 42
# The multipliers of a public 64-bit finaliser, which derives further hashes from the first.
MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
STEP = 0x9E3779B97F4A7C15
CHUNK = 1 << 15


def masks(radius: int) -> list[int]:
    """The covering masks, as signed 64-bit integers."""
    vectors = range(1, 1 << (radius + 1))
    own = [1 + i % len(vectors) for i in range(64)]
    kept = [sum(1 << i for i in range(64) if (own[i] & v).bit_count() % 2) for v in vectors]
    return [k - (1 << 64) if k >> 63 else k for k in kept]


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """Hashes of all runs of ``words`` words (all words, if fewer; repeats included), words joined by one blank."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts])
    n = max(1, len(parts) - words + 1)
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[-n:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64)


def majority(hashes: np.ndarray, blocks: int) -> np.ndarray:
    """``blocks`` fingerprints: the bits set in over half of the hashes; block 0 takes the hashes as they are."""
    out = np.zeros(blocks, np.uint64)
    for b in range(blocks):
        count = np.zeros(64, np.int64)
        for i in range(0, len(hashes), CHUNK):
            part = hashes[i : i + CHUNK]
            if b:
                part = part ^ np.uint64(b * STEP & (1 << 64) - 1)
                for factor in MIX:
                    part = (part ^ (part >> np.uint64(33))) * np.uint64(factor)
                part = part ^ (part >> np.uint64(33))
            bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            count += bits.sum(axis=0, dtype=np.int64)
        out[b] = np.packbits(2 * count > len(hashes), bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, words: int = 3, blocks: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(``doc_id``, marks): SimHash blocks of every whole text as an array of bigint.

    A-Z are lower-cased; words are what ASCII white space leaves. A null, empty or blank text has the fingerprint zero.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def start():
        def work(block):
            texts = block.column("text").cast(pa.binary()).to_pylist()
            marks = np.array([majority(shingle_hashes(t or b"", words), blocks) for t in texts], np.uint64).view(np.int64)
            lists = pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32) * blocks, marks.ravel())
            key = block.column("key")
            return result([("key", key.type), ("marks", pa.list_(pa.int64()))], key, lists)

        return work

    frame = docs.select(F.col(doc_id).alias("key"), F.col(text).alias("text"))
    return map_blocks(frame, f"key {kind}, marks array<bigint>", start).withColumnRenamed("key", doc_id)


def table_keys(marks: Column, blocks: int, radius: int) -> Column:
    """One key per block and covering table."""
    kept = masks(radius)
    literal = F.array(*[F.lit(m) for m in kept])

    def key(i: Column) -> Column:
        masked = F.get(marks, (i / len(kept)).cast("int")).bitwiseAND(F.get(literal, i % len(kept)))
        return F.xxhash64(i, masked)

    return F.transform(F.sequence(F.lit(0), F.lit(blocks * len(kept) - 1)), key)


def collisions(classes: DataFrame, blocks: int, radius: int) -> DataFrame:
    """(key, id, centre) for the members of all table keys with two classes or more; the centre is the smallest."""
    rows = classes.select("id", F.explode_outer(table_keys(F.col("marks"), blocks, radius)).alias("key"))
    shared = rows.groupBy("key").agg(F.min("id").alias("centre"), F.max("id").alias("last"))
    shared = shared.where("centre != last").select(F.col("key").alias("shared"), "centre")
    return rows.join(shared, F.col("key") == F.col("shared")).select("key", "id", "centre")


def exact_links(classes: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of fingerprints with at most ``radius`` differing bits.

    ``radius`` is 2. The members of shared keys send themselves to their fingerprint and to each fingerprint one bit
    away. Two fingerprints meet there exactly if they differ in two bits or fewer, and at most 65 can meet, so a
    star per meeting place holds every link and no group of pairs is ever formed.
    """
    if radius != 2:
        raise ValueError("links are exact for radius 2")
    chosen = collisions(classes, 1, radius).select("id").distinct()
    near = classes.join(chosen, "id").select("id", F.element_at("marks", 1).alias("mark"))
    flips = F.array(F.lit(0), *[F.lit((1 << i) - (1 << 64 if i == 63 else 0)) for i in range(64)])
    places = near.select("id", F.explode_outer(F.transform(flips, lambda f: F.col("mark").bitwiseXOR(f))).alias("place"))
    met = places.groupBy("place").agg(F.collect_set("id").alias("ids")).where(F.size("ids") > 1)
    return met.select(F.array_min("ids").alias("a"), F.explode("ids").alias("b")).where("a != b").distinct()


def close_links(classes: DataFrame, blocks: int, radius: int, total: int) -> DataFrame:
    """Edges (a, b) whose components are those of all members of shared keys that differ in at most ``total`` bits of all blocks.

    A class has one row in each of many tables, so even a key that all classes share is a small part of all rows.
    """
    rows = classes.select("id", F.explode_outer(table_keys(F.col("marks"), blocks, radius)).alias("key"))
    left = classes.select(F.col("id").alias("a"), F.col("marks").alias("left"))
    right = classes.select(F.col("id").alias("b"), F.col("marks").alias("right"))
    differ = F.zip_with("left", "right", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    distance = F.aggregate(differ, F.lit(0), lambda total, x: total + x)
    return links(rows, lambda pairs: pairs.join(left, "a").join(right, "b").where(distance <= total))


def near_duplicates(
    docs: DataFrame, words: int = 3, radius: int = 2, blocks: int = 1, total: int | None = None,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(``doc_id``, marks, component_id) of every document; documents of one component are near duplicates.

    With one block, documents are linked exactly if their fingerprints differ in at most ``radius`` bits. With more
    blocks, documents that meet in a covering table of any block are linked if all blocks together differ in at most
    ``total`` bits. Equal fingerprints are one class from the start, however many documents have them; only classes are
    compared. ``component_id`` is the smallest id reachable. Null, empty and blank texts have the fingerprint zero
    and are linked like any other. Rows with the same id are one node. Rows without an id get the component of their
    class, null if no row of the class has an id. An empty table gives an empty result.
    """
    marks = stored(fingerprints(docs, words, blocks, doc_id, text).withColumnRenamed(doc_id, "id"), "fingerprints")
    classes = stored(marks.groupBy("marks").agg(F.min("id").alias("id")), "classes")
    known = classes.where("id is not null")
    edges = exact_links(known, radius) if blocks == 1 else close_links(known, blocks, radius, total)
    linked = components(edges).withColumnRenamed("node", "id")
    named = classes.join(linked, "id", "left").select("marks", F.coalesce("component", "id").alias("component_id"))
    return marks.join(named, "marks").select(F.col("id").alias(doc_id), "marks", "component_id")
