"""Toxicity by subword embeddings.

A word is the mean of the vectors of its character n-grams and of itself, a window of 32 words the mean of its words, and a
linear softmax tells the classes apart; vectors and softmax are trained together. Misspelt or inflected words share
most n-grams with known ones. As log odds are linear in the vectors, a trained model is one number per hash bucket. A
document's mean hides few toxic words among many others, so its score is a logistic function of its highest word and of its
length, fitted on another fold.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arenalytics.llm.common import Cache, map_blocks, result, stored, strings
from arenalytics.llm.labels import fold, learnable

WORD = re.compile(r"[^\W_]+")
WINDOW = 32
NGRAMS = (3, 4, 5)
BITS = 18
BUCKETS = 1 << BITS
DIMENSIONS = 8
STEPS = 300
BATCH = 256
RATE = 0.05
STEADY = 1e-5
"""Slopes well below this move a vector little, so that buckets of rare words stay near their start."""
CALIBRATION_FOLD = 4
DOCUMENTS_PER_CLASS = 6_000
"""Bound of the training sample: so many labelled documents of each class, the first by a hash of their id."""
WINDOWS_PER_CLASS = 9_000
"""Bound of the windows that are learnt from, of each class, the first by a hash."""
CALIBRATION_DOCUMENTS = 20_000
"""Bound of the calibration sample, the first by a hash of their id."""
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    mixed = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(64 - BITS)).astype(np.int32)


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' n-grams (with word edges) and of the words themselves, and how many each word has."""
    framed = [f"<{w}>" for w in words]
    lengths = np.array([len(w) for w in framed], np.int64)
    points = np.frombuffer("".join(framed).encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
    word = np.repeat(np.arange(len(words)), lengths)
    ends = np.cumsum(lengths)
    left = ends[word] - np.arange(len(points))
    found, owner = [], []
    rolling = np.zeros(len(points), np.uint64)
    for n in range(1, max(NGRAMS) + 1):
        shifted = np.zeros(len(points), np.uint64)
        shifted[: max(0, len(points) - n + 1)] = points[n - 1 :]
        rolling = rolling * _PRIME + shifted
        if n in NGRAMS:
            inside = left >= n
            found.append(_bucket(rolling[inside] + np.uint64(n)))
            owner.append(word[inside])
    power = _PRIME ** np.arange(1, int(lengths.max(initial=1)) + 1, dtype=np.uint64)
    whole = np.zeros(len(words), np.uint64)
    np.add.at(whole, word, points * power[lengths[word] - left])
    found.append(_bucket(whole))
    owner.append(np.arange(len(words)))
    owners = np.concatenate(owner)
    order = np.argsort(owners, kind="stable")
    return np.concatenate(found)[order], np.bincount(owners, minlength=len(words))


@dataclass
class Model:
    """Log odds of a window: the sum of its words' scores; of a document: ``level`` of its highest word and log length."""

    weights: np.ndarray
    level: tuple[float, float, float]

    def word_scores(self, words: list[str]) -> list[float]:
        """Share of each word in its window: the mean of the weights of its buckets over the window's length."""
        if not words:
            return []
        ids, counts = subwords(words)
        return (np.add.reduceat(self.weights[ids], np.cumsum(counts) - counts) / counts / WINDOW).tolist()

    def peaks(self, texts: list[list[str]], cache: Cache) -> tuple[np.ndarray, np.ndarray]:
        """Highest word score, 0 without words, and log of one plus the number of words of each text."""
        scores = np.array(cache.all([w for words in texts for w in words]))
        sizes = np.array([len(words) for words in texts], np.int64)
        peak = np.zeros(len(texts))
        full = np.flatnonzero(sizes)
        if len(full):
            peak[full] = np.maximum.reduceat(scores, (np.cumsum(sizes) - sizes)[full])
        return peak, np.log1p(sizes)


def windows(frame: DataFrame) -> DataFrame:
    """(key, label, number, window): the windows of labelled documents."""

    def start():
        def work(block):
            keys, labels = block.column("key"), block.column("label").to_pylist()
            parts = [WORD.findall(t.lower()) for t in strings(block, "text")]
            cut = [(i, n, " ".join(w[n : n + WINDOW])) for i, w in enumerate(parts) for n in range(0, len(w), WINDOW)]
            kinds = [("key", keys.type), ("label", pa.float64()), ("number", pa.int32()), ("window", pa.string())]
            rows = [i for i, _, _ in cut]
            return result(kinds, keys.take(pa.array(rows, pa.int64())), [labels[i] for i in rows], [n for _, n, _ in cut], [w for _, _, w in cut])

        return work

    kind = frame.schema["key"].dataType.simpleString()
    return map_blocks(frame.select("key", "label", "text"), f"key {kind}, label double, number int, window string", start)


def train(texts: list[str], target: np.ndarray, seed: int = 7) -> np.ndarray:
    """Weights of all buckets: vectors and softmax fitted jointly by Adam on small batches of windows."""
    parts = [t.split(" ") for t in texts]
    ids, per_word = subwords([w for p in parts for w in p])
    words = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    share = np.repeat((1 / per_word / WINDOW).astype(np.float32), per_word)
    edges = np.concatenate(([0], np.cumsum(per_word)))[words]
    rng = np.random.default_rng(seed)
    state = [rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)), rng.normal(0, 0.5, (DIMENSIONS, 2)), np.zeros(2)]
    first, second = [np.zeros_like(v) for v in state], [np.zeros_like(v) for v in state]
    truth = np.stack([1 - target, target], axis=1)
    step = 0
    while step < STEPS:
        order = rng.permutation(len(parts))
        for at in range(0, min(len(order), BATCH * (STEPS - step)), BATCH):
            step += 1
            chosen = order[at : at + BATCH]
            counts = edges[chosen + 1] - edges[chosen]
            places = np.repeat(edges[chosen] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            own, weight = np.repeat(np.arange(len(chosen)), counts), share[places]
            used, bucket = np.unique(ids[places], return_inverse=True)
            near, softmax = state[0][used], state[1]
            hidden = np.stack([np.bincount(own, weight * near[bucket, d], len(chosen)) for d in range(DIMENSIONS)], axis=1)
            odds = hidden @ softmax + state[2]
            chance = np.exp(odds - odds.max(axis=1, keepdims=True))
            error = (chance / chance.sum(axis=1, keepdims=True) - truth[chosen]) / len(chosen)
            back = error @ softmax.T
            slope = np.stack([np.bincount(bucket, weight * back[own, d], len(used)) for d in range(DIMENSIONS)], axis=1)
            whole = slice(None)
            for i, (rows, grad) in enumerate(((used, slope), (whole, hidden.T @ error), (whole, error.sum(axis=0)))):
                first[i][rows] = 0.9 * first[i][rows] + 0.1 * grad
                second[i][rows] = 0.99 * second[i][rows] + 0.01 * grad**2
                scale = np.sqrt(second[i][rows] / (1 - 0.99**step)) + STEADY
                state[i][rows] -= RATE * first[i][rows] / (1 - 0.9**step) / scale
    apart = state[1][:, 1] - state[1][:, 0]
    return (state[0] @ apart).astype(np.float32)


def calibrate(peak: np.ndarray, log_words: np.ndarray, target: np.ndarray) -> tuple[float, float, float]:
    """Coefficients of a logistic regression by Newton steps with a little shrinkage."""
    x = np.stack([peak, log_words, np.ones_like(peak)], axis=1)
    w = np.zeros(3)
    keep = np.diag([1e-3, 1e-1, 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep + 1e-9 * np.eye(3), x.T @ (p - target) + keep @ w)
    return tuple(w.tolist())


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text") -> Model:
    """Train on windows of folds 1 to 3 and calibrate on fold 4; the held-out fold 0 is never read.

    The sample is drawn from the ids alone, so only its texts are cut into windows and no text is shuffled. At most
    ``WINDOWS_PER_CLASS`` windows of each class and two numbers of ``CALIBRATION_DOCUMENTS`` documents reach the driver.
    Without both classes in either part the score is the share of class 1, one half without any label.
    """
    spark = docs.sparkSession
    ids = learnable(docs.select(F.col(doc_id).alias("key")).where(F.col(doc_id).isNotNull()).distinct(), labels, label)
    late = F.col("fold") == CALIBRATION_FOLD
    ids = stored(ids.select("key", "label", late.alias("late")), "labelled-ids")
    counts = {(r.late, r.label): r.n for r in ids.groupBy("late", "label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 4:
        ones, total = sum(n for (_, y), n in counts.items() if y), sum(counts.values())
        share = ones / total if total else 0.5
        return Model(np.zeros(BUCKETS, np.float32), (0.0, 0.0, float(np.log((share + 1e-3) / (1.001 - share)))))
    first = lambda part, n: part.orderBy(F.xxhash64("key"), "key").limit(n)
    chosen = [first(ids.where(~F.col("late") & (F.col("label") == c)), DOCUMENTS_PER_CLASS) for c in (0.0, 1.0)]
    texts = docs.select(F.col(doc_id).alias("key"), F.col(text).alias("text"))
    cut = windows(texts.join(F.broadcast(chosen[0].union(chosen[1])), "key"))
    order = F.xxhash64("key", "number")
    keep = [cut.where(F.col("label") == c).orderBy(order, "window").limit(WINDOWS_PER_CLASS) for c in (0.0, 1.0)]
    rows = sorted((r.window, r.label) for r in keep[0].union(keep[1]).select("window", "label").collect())
    model = Model(train([w for w, _ in rows], np.array([y for _, y in rows])), (1.0, 0.0, 0.0))
    tried = texts.join(F.broadcast(first(ids.where("late"), CALIBRATION_DOCUMENTS)), "key")
    seen = measured(tried, spark.sparkContext.broadcast(model), "label").collect()
    seen = sorted((r.peak, r.log_words, r.label) for r in seen)
    return Model(model.weights, calibrate(*np.array(seen).T))


def measured(frame: DataFrame, sent, *kept: str) -> DataFrame:
    """(key, peak, log_words) and the kept columns of every text (key, text)."""
    fields = "".join(f", `{c}` {frame.schema[c].dataType.simpleString()}" for c in kept)

    def start():
        model = sent.value
        cache = Cache(model.word_scores)

        def work(block):
            peak, log_words = model.peaks([WORD.findall(t.lower()) for t in strings(block, "text")], cache)
            own = [block.column("key"), pa.array(peak, pa.float64()), pa.array(log_words, pa.float64()), *(block.column(c) for c in kept)]
            return pa.RecordBatch.from_arrays(own, names=["key", "peak", "log_words", *kept])

        return work

    kind = frame.schema["key"].dataType.simpleString()
    return map_blocks(frame.select("key", "text", *kept), f"key {kind}, peak double, log_words double{fields}", start)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(``doc_id``, held_out, score) of every whole text; a null or empty text, or one without words, has no odds of its own.

    Repeated rows give repeated results, other columns are left out, an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    out = measured(docs.select(F.col(doc_id).alias("key"), F.col(text).alias("text")), sent)
    a, b, c = (F.lit(float(x)) for x in model.level)
    chance = 1 / (1 + F.exp(-(a * F.col("peak") + b * F.col("log_words") + c)))
    return out.select(F.col("key").alias(doc_id), (fold(F.col("key")) == 0).alias("held_out"), chance.alias("score"))
