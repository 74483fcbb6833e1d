"""Importance resampling towards a target text: hashed one- and two-word features, Gumbel keys, distributed selection.

A document's weight is the mean gain of its features, the log ratio of their share in the target and in the corpus. The
rows with the largest keys, weight plus Gumbel noise, are a weighted sample without replacement. The cutoff key is found by
a weighted median of medians: each task gives the median of the keys it has left and their number; at least a quarter of
all keys lie on either side of the weighted median of these, so every round discards a fixed fraction for certain.
"""

from __future__ import annotations

import math
import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arenalytics.llm.common import map_blocks, result, split, stored
from arenalytics.llm.words import byte_words
from arenalytics.session import ship_package

BUCKETS = 10_000
SCALE = 1000
GROUP = 1 << 20
"""Keys that one median stands for at most."""
LAST = 5_000
"""So few remaining keys are put in order at once."""
NO_ID = (1 << 63) - 1
"""Documents without an id come last among equal scores."""


def features(text: bytes | None, buckets: int) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of every word and of every two consecutive words joined by a blank."""
    words = byte_words(text)
    one = list(map(zlib.crc32, words))
    two = list(map(zlib.crc32, words[1:], map(zlib.crc32, repeat(b" "), one)))
    return len(words), np.array(one + two, np.int64) % buckets


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket. Each task sums its own; only the sums of ``buckets`` keys are shuffled."""
    ship_package(texts.sparkSession)

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for block in split(batch, "text"):
                parts = [features(t, buckets)[1] for t in block.column("text").cast(pa.binary()).to_pylist()]
                total += np.bincount(np.concatenate(parts), minlength=buckets)
        seen = np.flatnonzero(total)
        yield result([("bucket", pa.int32()), ("n", pa.int64())], seen.astype(np.int32), total[seen])

    counts = texts.select(F.col(text).alias("text")).mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in counts.collect():
        out[row.bucket] = row.n
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in the corpus."""
    size = len(corpus)
    whole = float(int(corpus.sum()) + size), float(int(target.sum()) + size)
    pairs = zip(corpus.tolist(), target.tolist(), strict=True)
    return np.array([math.floor(SCALE * math.log((t + 1) * whole[0] / ((s + 1) * whole[1]))) for s, t in pairs], np.int64)


def noise(doc_id: Column, seed: int) -> Column:
    """floor of 1000 times Gumbel noise, drawn from the seed and the id (null: the empty text)."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296))).cast("bigint")


def weighted(docs: DataFrame, gains: np.ndarray, seed: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every document."""
    size = len(gains)

    def start():
        def work(block):
            found = [features(t, size) for t in block.column("text").cast(pa.binary()).to_pylist()]
            counts = [len(b) for _, b in found]
            weight = [int(gains[b].sum()) // len(b) if len(b) else 0 for _, b in found]
            kinds = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())]
            return result(kinds, block.column("doc_id"), [n for n, _ in found], counts, weight)

        return work

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    found = map_blocks(rows, "doc_id bigint, n_words bigint, n_features bigint, weight bigint", start)
    return found.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def _medians(keys: DataFrame, low, high, pivot) -> list:
    """One row per group of keys between the bounds: keys below, at and above the pivot, and the medians of both sides."""

    def group(first, second):
        order = np.lexsort((second, first))
        first, second = first[order], second[order]
        below = int(np.count_nonzero((first < pivot[0]) | ((first == pivot[0]) & (second < pivot[1]))))
        equal = int(np.count_nonzero((first == pivot[0]) & (second == pivot[1])))
        out = [below, equal, len(first) - below - equal]
        for a, b in ((0, below), (below + equal, len(first))):
            at = (a + b) // 2 if b > a else None
            out += [None if at is None else int(first[at]), None if at is None else int(second[at])]
        return out

    names = ["below", "equal", "above", "low_first", "low_second", "high_first", "high_second"]

    def run(batches):
        held, size, rows = [], 0, []
        for batch in batches:
            first, second = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            inside = (first > low[0]) | ((first == low[0]) & (second > low[1]))
            inside &= (first < high[0]) | ((first == high[0]) & (second < high[1]))
            held.append((first[inside], second[inside]))
            size += len(held[-1][0])
            if size >= GROUP:
                rows.append(group(*map(np.concatenate, zip(*held, strict=True))))
                held, size = [], 0
        if size:
            rows.append(group(*map(np.concatenate, zip(*held, strict=True))))
        if rows:
            yield result([(n, pa.int64()) for n in names], *map(list, zip(*rows, strict=True)))

    near = keys.where(F.col("first").between(low[0], high[0])).select("first", "second")
    return near.mapInArrow(run, ", ".join(f"{n} bigint" for n in names)).collect()


def cutoff(keys: DataFrame, rank: int, last: int = LAST) -> tuple[int, int]:
    """The key of the given rank, from 1, of (first, second) in ascending order; equal keys count each.

    The driver holds one median per task or ``GROUP`` keys, and ``last`` keys at the end.
    """
    ship_package(keys.sparkSession)
    low, high, pivot, left = (-(1 << 62), 0), (1 << 62, 0), (-(1 << 62), 0), None
    while left is None or left > last:
        rows = _medians(keys, low, high, pivot)
        below, equal, above = (sum(r[c] for r in rows) for c in ("below", "equal", "above"))
        if rank <= below:
            high, left, medians = pivot, below, [(r.low_first, r.low_second, r.below) for r in rows if r.below]
        elif rank <= below + equal:
            return pivot
        else:
            rank, low, left = rank - below - equal, pivot, above
            medians = [(r.high_first, r.high_second, r.above) for r in rows if r.above]
        medians.sort()
        seen = 0
        for first, second, size in medians:
            seen += size
            if 2 * seen >= left:
                pivot = (first, second)
                break
    f, s = F.col("first"), F.col("second")
    inside = ((f > low[0]) | ((f == low[0]) & (s > low[1]))) & ((f < high[0]) | ((f == high[0]) & (s < high[1])))
    return tuple(sorted(tuple(r) for r in keys.where(inside).select("first", "second").collect())[rank - 1])


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """The rows and ``nth``, their place from 1 in ascending order of the columns, from ranges that are put in order in parallel."""
    schema = rows.schema
    ship_package(rows.sparkSession)

    def run(batches):
        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            own = [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seen + 1, seen + n + 1, dtype=np.int64))]
            seen += n
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], names=[*batch.schema.names, "range", "place"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    made = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, f"{kinds}, range int, place bigint")
    made = stored(made, "in-order")
    sizes = made.groupBy("range").agg(F.max("place").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = made.join(sizes.select("range", before.alias("before")), "range")
    return joined.select(*schema.names, (F.col("before") + F.col("place")).alias("nth"))


def resampled(
    docs: DataFrame, target: DataFrame, percent: int = 25, seed: int = 7, buckets: int = BUCKETS, least_words: int = 20,
    doc_id: str = "doc_id", text: str = "text", target_text: str = "text", last: int = LAST,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; ``rank`` is null for those not drawn.

    Of the documents with ``least_words`` words or more, ``percent`` of a hundred, rounded down, are drawn by highest score,
    ties to the smaller id. Ids are integers; documents without one come last among equal scores. A null or empty text has
    no features and weight 0. Rows that repeat are rows of their own; rows of the same id share their noise. Empty
    tables give an empty result or, for the target, gains of the corpus alone. Other columns aren't read.
    """
    gains = bucket_gains(bucket_counts(docs, text, buckets), bucket_counts(target, target_text, buckets))
    rows = stored(weighted(docs, gains, seed, doc_id, text), "weights")
    able = F.col("n_words") >= least_words
    drawn = rows.where(able).count() * percent // 100
    names = ["doc_id", "n_features", "weight", "score"]
    nowhere = F.lit(None).cast("bigint").alias("rank")
    if not drawn:
        return rows.select(*names, nowhere)
    first, second = (-F.col("score")).alias("first"), F.coalesce("doc_id", F.lit(NO_ID)).alias("second")
    keyed = rows.withColumns({"first": first, "second": second})
    a, b = cutoff(keyed.where(able).select("first", "second"), drawn, last)
    won = able & ((F.col("first") < a) | ((F.col("first") == a) & (F.col("second") <= b)))
    ranked = numbered(keyed.where(won).select(*names, "first", "second"), "first", "second", "n_features", "weight")
    ranked = ranked.select(*names, F.when(F.col("nth") <= drawn, F.col("nth")).alias("rank"))
    return ranked.union(keyed.where(~won).select(*names, nowhere))
