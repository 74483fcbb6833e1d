"""Ranked lexical search by norm buckets.

A document's vector holds the impact of each item term, so a score is the product of an item's and a document's vector.
Vectors are dealt out and put in order by length. A bucket of vectors of about one length is skipped for an item if even the
longest of them, times the item's length, stays below the item's twentieth score so far (Cauchy-Schwarz). Inside
a bucket the item's largest coordinates are multiplied out and the others bounded by their lengths; what survives is
scored exactly, in 64-bit integers. Bounds are doubles with a margin, and equal scores survive, so nothing is lost.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arenalytics.llm.common import map_blocks, result, stored
from arenalytics.llm.words import byte_words
from arenalytics.session import ship_package

TOP = 20
BUCKET, BUCKET_ENTRIES = 2048, 1 << 20
"""Vectors of a bucket, and their coordinates in all, at most."""
FOCUS = 6
BLOCK_ITEMS, BLOCK_TERMS = 1000, 100_000
"""Items are searched in blocks of so many items or terms, so what the workers hold does not grow with the item table."""
MARGIN = 1 + 1e-9
NO_ID = (1 << 63) - 1
VECTOR = "doc_id bigint, n bigint, terms binary, counts binary"


@dataclass
class Items:
    """A block of items: ids, and for each its distinct terms by number and how often it has them."""

    ids: list
    terms: list[np.ndarray]
    repeats: list[np.ndarray]
    vocabulary: dict[bytes, int]


def item_blocks(items: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator[Items]:
    """Items with terms, a block at a time; no more than a block and one partition of the items is held."""
    block = Items([], [], [], {})
    for row in items.select(F.col(item_id).alias("id"), F.col(text).alias("text")).toLocalIterator():
        counts = Counter(byte_words((row.text or "").encode()))
        if not counts:
            continue
        numbers = [block.vocabulary.setdefault(w, len(block.vocabulary)) for w in counts]
        block.ids.append(row.id)
        block.terms.append(np.array(numbers, np.int64))
        block.repeats.append(np.array(list(counts.values()), np.int64))
        if len(block.ids) >= BLOCK_ITEMS or len(block.vocabulary) >= BLOCK_TERMS:
            yield block
            block = Items([], [], [], {})
    if block.ids:
        yield block


def vectors(docs: DataFrame, vocabulary: dict[bytes, int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, terms, counts) of documents with terms: ``n`` counts all their terms, the others only the vocabulary's."""
    size = len(vocabulary)

    def start():
        def work(block):
            parts = [byte_words(t) for t in block.column("text").cast(pa.binary()).to_pylist()]
            n = np.array([len(p) for p in parts], np.int64)
            flat = np.array([vocabulary.get(w, -1) for p in parts for w in p], np.int64)
            own = np.repeat(np.arange(len(parts)), n)[flat >= 0] * size + flat[flat >= 0]
            pairs, counts = np.unique(own, return_counts=True)
            edges = np.searchsorted(pairs, np.arange(len(parts) + 1) * size).tolist()
            terms, counts = (pairs % size).astype("<i4"), counts.astype("<i4")
            cut = lambda x: [x[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)]
            kinds = [("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.binary()), ("counts", pa.binary())]
            made = result(kinds, block.column("doc_id"), n, cut(terms), cut(counts))
            return made.filter(pa.array(n > 0))

        return work

    return map_blocks(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")), VECTOR, start)


def document_frequencies(found: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term; every task sums its own."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4"), minlength=size)
        seen = np.flatnonzero(total)
        yield result([("term", pa.int32()), ("n", pa.int64())], seen.astype(np.int32), total[seen])

    out = np.zeros(size, np.int64)
    for row in found.select("terms").mapInArrow(run, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[row.term] = row.n
    return out


@dataclass
class Corpus:
    """What scores need of all documents: their number, all terms, and the weight of each item term."""

    documents: int
    length: int
    weights: np.ndarray

    def impacts(self, counts: np.ndarray, n: np.ndarray) -> np.ndarray:
        m = 100 - 25 + 25 * n * self.documents // self.length
        return 1_000_000_000 * counts // (1000 * counts + 12 * m)


def by_length(found: DataFrame, corpus: Corpus) -> DataFrame:
    """The vectors with their ``norm`` and ``range``, longest first, dealt out in ranges of lengths."""

    def run(batches):
        kinds = [("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.binary()), ("counts", pa.binary()), ("norm", pa.float64())]
        for batch in batches:
            terms, counts, rows = _flat(batch, 2, 3)
            n = batch.column(1).to_numpy(zero_copy_only=False)
            x = corpus.impacts(counts, n[rows])
            squares = np.bincount(rows, corpus.weights[terms] * x.astype(float) ** 2, minlength=batch.num_rows)
            yield result(kinds, *[batch.column(i) for i in range(4)], np.sqrt(squares))

    measured = found.mapInArrow(run, f"{VECTOR}, norm double").where("norm > 0")
    ordered = measured.repartitionByRange(F.desc("norm"), "doc_id").sortWithinPartitions(F.desc("norm"), "doc_id")
    return stored(ordered.withColumn("range", F.spark_partition_id()), "by-length")


def _flat(batch: pa.RecordBatch, terms: int, counts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms and counts of all vectors one after the other, and the row of each."""
    lists = batch.column(terms).to_pylist()
    rows = np.repeat(np.arange(len(lists)), [len(x) // 4 for x in lists])
    flat = [np.frombuffer(b"".join(x), "<i4").astype(np.int64) for x in (lists, batch.column(counts).to_pylist())]
    return *flat, rows


class Search:
    """The best documents of every item among the buckets seen so far."""

    def __init__(self, items: Items, corpus: Corpus, floors: np.ndarray, top: int):
        self.items, self.corpus, self.top = items, corpus, top
        self.floors = floors.copy()
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in items.ids]
        root = np.sqrt(corpus.weights.astype(float))
        self.lengths, self.focus, self.rest = [], [], []
        for terms, repeats in zip(items.terms, items.repeats, strict=True):
            values = root[terms] * repeats
            first = np.argsort(-values, kind="stable")[:FOCUS]
            self.lengths.append(math.sqrt(float((values**2).sum())))
            self.focus.append([(int(terms[i]), float(values[i])) for i in first])
            self.rest.append(math.sqrt(max(float((values**2).sum() - (values[first] ** 2).sum()), 0.0)))
        self.root = root

    def bucket(self, ids, n, terms, counts, rows, norms) -> None:
        order = np.argsort(terms, kind="stable")
        terms, rows = terms[order], rows[order]
        x = self.corpus.impacts(counts[order], n[rows])
        edges = np.searchsorted(terms, np.arange(len(self.root) + 1))
        longest, squares, columns = float(norms.max()), norms**2, {}

        def column(t: int) -> np.ndarray:
            if t not in columns:
                columns[t] = np.zeros(len(ids))
                columns[t][rows[edges[t] : edges[t + 1]]] = self.root[t] * x[edges[t] : edges[t + 1]]
            return columns[t]

        for q, floor in enumerate(self.floors.tolist()):
            least = max(floor, 1)
            if longest * self.lengths[q] * MARGIN < least:
                continue
            near, left = np.zeros(len(ids)), squares.copy()
            for t, value in self.focus[q]:
                near += value * column(t)
                left -= column(t) ** 2
            alive = (near + self.rest[q] * np.sqrt(np.maximum(left, squares * 1e-12))) * MARGIN >= least
            if alive.any():
                self.exact(q, least, ids, x, rows, edges, alive)

    def exact(self, q: int, least: int, ids, x, rows, edges, alive) -> None:
        scores = np.zeros(len(ids), np.int64)
        for t, repeats in zip(self.items.terms[q].tolist(), self.items.repeats[q].tolist(), strict=True):
            own = slice(edges[t], edges[t + 1])
            scores[rows[own]] += int(self.corpus.weights[t]) * repeats * x[own]
        good = np.flatnonzero(alive & (scores >= least))
        if not len(good):
            return
        have = np.concatenate((self.best[q][0], scores[good])), np.concatenate((self.best[q][1], ids[good]))
        order = np.lexsort((have[1], -have[0]))[: self.top]
        self.best[q] = have[0][order], have[1][order]
        if len(order) == self.top:
            self.floors[q] = max(int(self.floors[q]), int(have[0][order[-1]]))


def _searched(vectors: DataFrame, items: Items, corpus: Corpus, floors: np.ndarray, top: int) -> DataFrame:
    """(item, score, doc_id): the best ``top`` of each item in every task, none below its floor."""

    def run(batches):
        search = Search(items, corpus, floors, top)
        for batch in batches:
            sizes = np.array([len(x) // 4 for x in batch.column(2).to_pylist()], np.int64)
            cell = np.maximum(np.cumsum(sizes) // BUCKET_ENTRIES, 0) * batch.num_rows + np.arange(batch.num_rows) // BUCKET
            cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(a, b - a)
                if part.num_rows:
                    ids = part.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
                    n, norms = (part.column(i).to_numpy(zero_copy_only=False) for i in (1, 4))
                    search.bucket(ids, n, *_flat(part, 2, 3), norms)
        kinds = [("item", pa.int32()), ("score", pa.int64()), ("doc_id", pa.int64())]
        item = np.repeat(np.arange(len(items.ids), dtype=np.int32), [len(s) for s, _ in search.best])
        if len(item):
            yield result(kinds, item, np.concatenate([s for s, _ in search.best]), np.concatenate([d for _, d in search.best]))

    return vectors.select("doc_id", "n", "terms", "counts", "norm").mapInArrow(run, "item int, score bigint, doc_id bigint")


def _ranked(found: DataFrame, top: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", nth).where(F.col("rank") <= top)


def search(
    docs: DataFrame, items: DataFrame, top: int = TOP, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item with a score above 0, ties by ascending id.

    Ids of documents are integers; documents without one come last among equal scores. Every row is a document of its own, also
    where rows repeat, and every item row an item. Null and empty texts have no terms: such items have no rows. Empty
    tables give an empty result. Other columns aren't read. The range of the longest vectors is searched first; its
    scores are the floors that the others start with.
    """
    spark = docs.sparkSession
    ship_package(spark)
    kind = items.schema[item_id].dataType
    out = spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id bigint, score bigint")
    for block in item_blocks(items, item_id, item_text):
        found = stored(vectors(docs, block.vocabulary, doc_id, text), "vectors")
        sums = found.agg(F.count("*").alias("documents"), F.sum("n").alias("length")).first()
        if not sums.documents:
            return out
        df = document_frequencies(found, len(block.vocabulary))
        weights = [math.floor(1000 * math.log((2 * sums.documents + 2) / (2 * n + 1))) for n in df.tolist()]
        corpus = Corpus(sums.documents, sums.length, np.array(weights, np.int64))
        ordered = by_length(found, corpus)
        none = np.zeros(len(block.ids), np.int64)
        longest = stored(_ranked(_searched(ordered.where("range = 0"), block, corpus, none, top), top), "longest")
        floors = none.copy()
        for row in longest.where(F.col("rank") == top).select("item", "score").collect():
            floors[row.item] = row.score
        rest = _searched(ordered.where("range > 0"), block, corpus, floors, top)
        best = _ranked(longest.drop("rank").union(rest), top)
        names = spark.createDataFrame([(i, x) for i, x in enumerate(block.ids)], f"item int, item_id {kind.simpleString()}")
        own = F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id")
        out = out.union(best.join(names, "item").select("item_id", "rank", own, "score"))
    return out
