"""Token counts of whole texts under a piece model, without moving pre-tokens.

No piece of the model holds a line break or a blank after another sign, so the count of a text is the sum over its
pre-tokens (blanks with the word they lead, or one line break). Lengths are looked up in two tiers: a table of the most
frequent pre-tokens, which every worker receives, then the worker's own cache, which encodes what it misses.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arenalytics.llm.common import Cache, map_blocks, result, split, strings
from arenalytics.session import ship_package

BLANK = "▁"
PRE_TOKEN = re.compile(r" *[^ \n]+|\n| +")
HEAD = 16_384
"""Entries of the frequent table: its whole size. It decides who encodes a pre-token, never the count."""
TASK_HEAD = 4_096
TASK_DISTINCT = 200_000


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens of a text with the model's leading blank; an empty text has none."""
    return PRE_TOKEN.findall(" " + text.replace(BLANK, " ")) if text else []


@lru_cache(2)
def model(path: str) -> sentencepiece.SentencePieceProcessor:
    """The piece model, once it has shown that texts may be cut at blanks and line breaks."""
    out = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [out.id_to_piece(i) for i in range(out.get_piece_size())]
    if any("\n" in p or BLANK in p.lstrip(BLANK) for p in pieces):
        raise ValueError("the model has pieces over blanks or line breaks")
    if len(out.encode("\n\n")) != 3 or out.encode("a  b") == out.encode("a b"):
        raise ValueError("the model changes white space")
    return out


def lengths(path: str, parts: list[str]) -> list[int]:
    """Tokens of each pre-token: a line break before it keeps the model's leading blank away (two tokens)."""
    return [len(x) - 2 for x in model(path).encode(["\n" + p for p in parts], num_threads=1)]


@lru_cache(2)
def _cache(path: str) -> Cache:
    return Cache(lambda parts: lengths(path, parts))


def frequent_lengths(docs: DataFrame, path: str, text: str = "text") -> dict[str, int]:
    """The ``HEAD`` most frequent pre-tokens of all texts and their lengths.

    Every task counts its own pre-tokens and passes on its ``TASK_HEAD`` most frequent ones; rare ones are forgotten
    whenever a task holds more than ``TASK_DISTINCT``.
    """
    ship_package(docs.sparkSession)

    def run(batches):
        counts: Counter[str] = Counter()
        for batch in batches:
            for block in split(batch, "text"):
                for t in strings(block, "text"):
                    counts.update(pre_tokens(t))
                if len(counts) > TASK_DISTINCT:
                    counts = Counter(dict(counts.most_common(TASK_DISTINCT // 2)))
        head = counts.most_common(TASK_HEAD)
        yield result([("part", pa.string()), ("n", pa.int64())], [p for p, _ in head], [n for _, n in head])

    heads = docs.select(F.col(text).alias("text")).mapInArrow(run, "part string, n long")
    top = heads.groupBy("part").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "part").limit(HEAD)
    parts = [r.part for r in top.select("part").collect()]
    return dict(zip(parts, lengths(path, parts), strict=True))


def token_counts(docs: DataFrame, path: str, limit: int = 4096, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(``doc_id``, n_bytes, n_tokens, over_limit) of every text, without begin and end tokens.

    A null or empty text has no bytes and no tokens. Repeated rows give repeated results, other columns are left out,
    an empty table gives an empty result.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    head = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path, text))

    def start():
        known, cache = head.value.get, _cache(path)

        def work(block):
            texts = [pre_tokens(t) for t in strings(block, "text")]
            parts = [p for own in texts for p in own]
            sizes = list(map(known, parts))
            places = [i for i, n in enumerate(sizes) if n is None]
            for i, n in zip(places, cache.all([parts[i] for i in places]), strict=True):
                sizes[i] = n
            totals = np.concatenate(([0], np.cumsum(np.array(sizes, np.int64))))
            n = np.diff(totals[np.concatenate(([0], np.cumsum([len(own) for own in texts])))])
            key = block.column("key")
            size = pc.cast(pc.fill_null(pc.binary_length(block.column("text")), 0), pa.int64())
            kinds = [("key", key.type), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())]
            return result(kinds, key, size, n)

        return work

    frame = docs.select(F.col(doc_id).alias("key"), F.col(text).alias("text"))
    out = map_blocks(frame, f"key {kind}, n_bytes long, n_tokens long", start)
    return out.withColumn("over_limit", F.col("n_tokens") > limit).withColumnRenamed("key", doc_id)
