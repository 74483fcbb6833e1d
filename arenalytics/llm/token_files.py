"""Token ids of a corpus as packed files, in document order.

The files are Parquet tables of blocks. A block holds whole documents: their ids (``doc_ids``), the number of token ids of
each (``lengths``) and the token ids, packed into 64-bit words of a 4-bit selector and 60 bits of equally wide values. A
value too wide for a word is an escape: its word only holds the selector, the value stands in a list after the words. So
word counts alone give the place of every value, and a block is unpacked without a loop over values. Next to
the blocks, an index holds the position of the first token id of each shard; shards and blocks are in document order.
"""

from __future__ import annotations

import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from arenalytics.llm.common import Cache, result, split, strings
from arenalytics.session import ship_package

BLOCK_IDS = 32_768
"""A block ends with the document that brings it to this many ids."""

# Values per word and bits per value, by selector; the last is the escape.
PER_WORD = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1], np.int64)
BITS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 64], np.int64)
ESCAPE = 14


def pack(values: np.ndarray) -> bytes:
    """Unsigned 64-bit values as: how many values, how many words, the words, the escaped values."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    # The exponent is the bit length; beyond 2 ** 53 rounding may make it one too large, never too small.
    bits = np.frexp(values.astype(np.float64))[1].astype(np.uint8)
    selector = np.full(n, ESCAPE, np.uint8)
    wide = np.zeros(n + int(PER_WORD[0]) + 1, np.int32)
    for s in range(ESCAPE - 1, -1, -1):
        np.cumsum(bits > BITS[s], out=wide[1 : n + 1])
        wide[n + 1 :] = wide[n]
        k = int(PER_WORD[s])
        selector[wide[k : n + k] == wide[:n]] = s
    steps = PER_WORD[selector].tolist()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += steps[i]
    starts = np.array(starts, np.int64)
    chosen = selector[starts]
    words = chosen.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate((values, np.zeros(int(PER_WORD[0]), np.uint64)))
    for s in np.unique(chosen):
        if s == ESCAPE:
            continue
        rows = np.flatnonzero(chosen == s)
        lanes = np.arange(PER_WORD[s])
        parts = padded[starts[rows, None] + lanes] << (lanes * BITS[s]).astype(np.uint64)
        words[rows] |= np.bitwise_or.reduce(parts, axis=1)
    escaped = values[starts[chosen == ESCAPE]]
    return np.concatenate((np.array([n, len(words)], np.uint64), words, escaped)).astype("<u8").tobytes()


def unpack(data: bytes) -> np.ndarray:
    """The values of ``pack``."""
    table = np.frombuffer(data, "<u8")
    n, n_words = int(table[0]), int(table[1])
    words, escaped = table[2 : 2 + n_words], table[2 + n_words :]
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = PER_WORD[selector]
    starts = np.cumsum(counts) - counts
    out = np.zeros(n + int(PER_WORD[0]), np.uint64)
    for s in np.unique(selector):
        rows = np.flatnonzero(selector == s)
        if s == ESCAPE:
            out[starts[rows]] = escaped
            continue
        lanes = np.arange(PER_WORD[s])
        mask = np.uint64((1 << int(BITS[s])) - 1)
        out[starts[rows, None] + lanes] = (words[rows, None] >> (lanes * BITS[s]).astype(np.uint64)) & mask
    return out[:n]


# The classes and contractions of the tokenizer's own pattern for words, for the code points below U+0100 in
# lower case: runs of letters, single digits, runs of anything else but white space.
LETTERS = "abcdefghijklmnopqrstuvwxyzªµºßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
DIGITS = "0123456789²³¹¼½¾"
BLANKS = "\t\n\x0b\x0c\r \x85\xa0"
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
BLANK, LETTER, DIGIT, OTHER = range(4)
CLASS = np.array([BLANK if chr(i) in BLANKS else LETTER if chr(i) in LETTERS else DIGIT if chr(i) in DIGITS else OTHER for i in range(256)], np.uint8)


def narrow(text: str) -> bool:
    """Whether the classes hold for a text: no wider code points, and nothing that may be a special token."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return "<|" not in text


def word_starts(data: np.ndarray) -> np.ndarray:
    """Where a word of the pattern starts in lower-case Latin-1 bytes.

    A word starts at a change of class and at every digit. A contraction is one word if its sign is not part of a longer run of
    signs; what letters follow it start a new word.
    """
    kind = CLASS[data]
    before = np.concatenate((np.zeros(1, np.uint8), kind[:-1]))
    start = (kind != BLANK) & ((kind != before) | (kind == DIGIT))
    at = np.flatnonzero((data == ord("'")) & (before != OTHER))
    padded = np.concatenate((data, np.zeros(3, np.uint8)))
    free = np.ones(len(at), bool)
    for word in CONTRACTIONS:
        held = free.copy()
        for k, letter in enumerate(word[1:].encode(), 1):
            held &= padded[at + k] == letter
        free &= ~held
        own = at[held]
        start[own + 1] = False
        after = own[own + len(word) < len(data)] + len(word)
        start[after[kind[after] == LETTER]] = True
    return start


class Coder:
    """Packed 32-bit ids of words and pieces, kept for all tasks of a worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.words = Cache(self._words, 400_000)
        self.pieces = Cache(self._pieces, 50_000)

    def _pieces(self, texts: list[str]) -> list[bytes]:
        coded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in coded]

    def _words(self, words: list[bytes]) -> list[bytes]:
        """Words of the pattern, in Latin-1: encoded as one text, and cut at the tokens that end words."""
        words = [w.decode("latin-1") for w in words]
        data = self._pieces([" ".join(words)])[0]
        stops = (np.flatnonzero(self.ends[np.frombuffer(data, "<u4")]) + 1) * 4
        if len(stops) != len(words) or stops[-1] != len(data):
            return self._pieces(words)
        stops = stops.tolist()
        return [data[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]

    def _narrow(self, texts: list[str]) -> list[bytes]:
        """All texts at once: words by their places, each different word looked up once, ids gathered by word number."""
        data = np.frombuffer("\n".join(texts).lower().encode("latin-1"), np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        start = word_starts(data)
        solid = CLASS[data] != BLANK
        places = (np.cumsum(solid) - 1)[start]
        offsets = np.append(places, np.count_nonzero(solid)).astype(np.int64)
        buffers = [None, pa.py_buffer(offsets), pa.py_buffer(data[solid])]
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(places), buffers).dictionary_encode()
        _, cuts, kept = words.dictionary.buffers()
        cuts = np.frombuffer(cuts, np.int64, len(words.dictionary) + 1).tolist()
        kept = kept.to_pybytes() if kept is not None else b""
        coded = self.words.all([kept[a:b] for a, b in zip(cuts, cuts[1:], strict=False)])
        ids = np.frombuffer(b"".join(coded), "<u4")
        sizes = np.array([len(c) // 4 for c in coded], np.int64)
        number = words.indices.to_numpy()
        counts = sizes[number]
        upto = np.concatenate((np.zeros(1, np.int64), np.cumsum(counts)))
        first = (np.cumsum(sizes) - sizes)[number] - upto[:-1]
        flat = ids[np.repeat(first, counts) + np.arange(upto[-1])]
        edges = upto[np.searchsorted(np.flatnonzero(start), ends)].tolist()
        return [flat[a:b].tobytes() for a, b in zip([0, *edges[:-1]], edges, strict=True)]

    def texts(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. No word goes across blanks or line breaks, so wide texts are cut there."""
        out: list[bytes] = [b""] * len(texts)
        plain = [i for i, t in enumerate(texts) if narrow(t)]
        if plain:
            for i, ids in zip(plain, self._narrow([texts[i] for i in plain]), strict=True):
                out[i] = ids
        wide = {i: texts[i].replace("\n", " ").split(" ") for i in sorted(set(range(len(texts))) - set(plain))}
        coded, at = self.pieces.all([p for own in wide.values() for p in own]), 0
        for i, own in wide.items():
            out[i] = b"".join(coded[at : at + len(own)])
            at += len(own)
        return out


@lru_cache(2)
def _coder(path: str) -> Coder:
    return Coder(path)


def encode_texts(texts: list[str], path: str) -> list[bytes]:
    """Packed 32-bit ids of each text, word by word, as the tokenizer gives them for the whole text."""
    return _coder(path).texts(texts)


def write_ids(
    docs: DataFrame, tokenizer: str, path: str, end_id: int = 1, doc_id: str = "doc_id", text: str = "text"
) -> None:
    """Write the ids of every whole text, each text ended by ``end_id``, below ``path`` in ascending ``doc_id`` order.

    ``tokenizer`` is a file every worker can read. A null or empty text has only its end id. Rows with a null id come
    first; rows with the same id are ordered by a hash of their text, repeated rows are kept. An empty table gives no blocks.
    The range shuffle moves each text once; a shard is one task's range.
    """
    spark = docs.sparkSession
    ship_package(spark)
    kind = docs.schema[doc_id].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()
    named = docs.select(F.col(doc_id).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("tie"))
    ordered = named.repartitionByRange("key", "tie").sortWithinPartitions("key", "tie").select("key", "text")

    def run(batches):
        shard, number = TaskContext.get().partitionId(), 0
        keys, coded, held = [], [], 0

        def block():
            kinds = [("shard", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(key_type)), ("lengths", pa.list_(pa.int32()))]
            kinds += [("n_ids", pa.int64()), ("words", pa.binary())]
            lengths = [len(c) // 4 for c in coded]
            words = pack(np.frombuffer(b"".join(coded), "<u4"))
            return result(kinds, [shard], [number], [keys], [lengths], [sum(lengths)], [words])

        for batch in batches:
            key_type = batch.schema.field("key").type
            for part in split(batch, "text"):
                for key, ids in zip(part.column("key").to_pylist(), encode_texts(strings(part, "text"), tokenizer), strict=True):
                    keys.append(key)
                    coded.append(ids + end)
                    held += len(ids) // 4 + 1
                    if held >= BLOCK_IDS:
                        yield block()
                        number, keys, coded, held = number + 1, [], [], 0
        if keys:
            yield block()

    schema = f"shard int, block int, doc_ids array<{kind}>, lengths array<int>, n_ids long, words binary"
    ordered.mapInArrow(run, schema).write.parquet(f"{path}/blocks")
    shards = spark.read.parquet(f"{path}/blocks").groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    before = F.sum("n_ids").over(Window.orderBy("shard")) - F.col("n_ids")
    shards.select("shard", before.alias("shard_start")).write.parquet(f"{path}/index")


def read_ids(spark: SparkSession, path: str, each: str = "ids", doc_id: str = "doc_id") -> DataFrame:
    """Documents of ``write_ids``: (``doc_id``, start, n_tokens, ids), ids packed as little-endian 32-bit integers.

    ``start`` is the number of ids before the document. With ``each="crc32"`` the ids are only summed up: the last column is
    ids_crc32, and no ids are moved.
    """
    ship_package(spark)
    blocks, index = spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/index")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    last = ("ids", pa.binary(), "binary") if each == "ids" else ("ids_crc32", pa.int64(), "long")

    def run(batches):
        for batch in batches:
            key_type = batch.schema.field("doc_ids").type.value_type
            kinds = [("shard", pa.int32()), ("block", pa.int32()), ("key", key_type), ("within", pa.int64()), ("n_tokens", pa.int64())]
            for i in range(batch.num_rows):
                shard, number, keys, lengths, words = (batch.column(c)[i].as_py() for c in range(5))
                ids = unpack(words).astype("<u4")
                ends = np.cumsum(np.array(lengths, np.int64))
                own = [ids[e - n : e].tobytes() for e, n in zip(ends.tolist(), lengths, strict=True)]
                values = own if each == "ids" else [zlib.crc32(x) for x in own]
                count = len(keys)
                yield result([*kinds, last[:2]], [shard] * count, [number] * count, keys, ends - lengths, lengths, values)

    own = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("block")) - F.col("n_ids")
    starts = blocks.select("shard", "block", "n_ids").withColumn("own", own).join(index, "shard")
    starts = starts.select("shard", "block", (F.col("own") + F.col("shard_start")).alias("first"))
    schema = f"shard int, block int, key {kind}, within long, n_tokens long, {last[0]} {last[2]}"
    rows = blocks.select("shard", "block", "doc_ids", "lengths", "words").mapInArrow(run, schema).join(starts, ["shard", "block"])
    return rows.select(F.col("key").alias(doc_id), (F.col("first") + F.col("within")).alias("start"), "n_tokens", last[0])
