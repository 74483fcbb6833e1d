"""Quality scores from document statistics.

Statistics of each text (length, alphabet, repetition, lines) are standardised and mapped by random Fourier features, whose
products approximate a Gaussian kernel. Normal equations are summed per partition and fold, so that ridge models, with and
without each fold, come from one pass over the labelled rows. Scores of the models that have not seen a row's fold are
calibrated by isotonic regression.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arenalytics.llm.common import map_blocks, result, stored, strings
from arenalytics.llm.labels import FOLDS, fold, learnable
from arenalytics.session import ship_package

FEATURES = 192
RIDGES = (1e-4, 1e-3, 1e-2, 1e-1)
"""Candidates for the ridge, per row; the least error on unseen folds decides."""
BINS = 1024
"""Raw scores are counted in so many equal steps before calibration."""
CLIP = 6.0

BLANK, BREAK, LOWER, UPPER, DIGIT, MARK, WIDE = range(7)
_CLASS = np.full(256, MARK, np.uint8)
_CLASS[128:] = WIDE
_CLASS[[9, 11, 12, 13, 32]] = BLANK
_CLASS[10] = BREAK
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = LOWER, UPPER, DIGIT
STATISTICS = 18


def statistics(text: str) -> list[float]:
    """The statistics of one text; shares are of bytes, words or lines."""
    data = np.frombuffer(text.encode(), np.uint8)
    kind = _CLASS[data]
    n = max(1, len(data))
    share = (np.bincount(kind, minlength=7) / n).tolist()
    words = text.split()
    lines = text.split("\n")
    n_words, n_lines = max(1, len(words)), len(lines)
    mark, gap = kind == MARK, kind <= BREAK
    counts = np.bincount(data, minlength=256)
    counts = counts[counts > 0] / n
    return [
        np.log1p(len(data)), np.log1p(len(words)), *share,
        len(data) / n_words, len(set(words)) / n_words, sum(map(eq, words, words[1:])) / n_words,
        1 - len(set(lines)) / n_lines, np.log1p(n / n_lines),
        np.count_nonzero(mark[:-1] & gap[1:]) / n_words,
        np.count_nonzero(gap[:-2] & mark[1:-1] & gap[2:]) / n_words,
        np.count_nonzero(mark[1:] & (data[1:] == data[:-1])) / n_words,
        float(-(counts * np.log2(counts)).sum()),
    ]


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, statistics) of every whole text; null counts as the empty text."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def start():
        def work(block):
            values = [statistics(t) for t in strings(block, "text")]
            key = block.column("key")
            return result([("key", key.type), ("statistics", pa.list_(pa.float64()))], key, values)

        return work

    return map_blocks(docs.select(F.col(doc_id).alias("key"), F.col(text).alias("text")), f"key {kind}, statistics array<double>", start)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: tuple[np.ndarray, np.ndarray]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return expand(x, self.mean, self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated chance of label 1; a thousandth of the raw score keeps the order within flat parts."""
        raw = self.raw(x)
        return np.clip(0.999 * np.interp(raw, *self.knots) + 0.001 * np.clip(raw, 0, 1), 0, 1)


def _basis() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    return rng.normal(0, 1 / np.sqrt(STATISTICS), (STATISTICS, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)


def expand(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Random Fourier features and a constant."""
    directions, phases = _basis()
    standard = np.clip((x - mean) / scale, -CLIP, CLIP)
    waves = np.sqrt(2 / FEATURES) * np.cos(standard @ directions + phases)
    return np.concatenate((waves, np.ones((len(x), 1))), axis=1)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("statistics").flatten().to_numpy(zero_copy_only=False).reshape(-1, STATISTICS)


def task_sums(train: DataFrame, mean: np.ndarray, scale: np.ndarray) -> DataFrame:
    """(fold, total): by task and fold, sums of z z', z y and y y over its rows, as one symmetric matrix of (z, y).

    They are dealt out anew, so that no task needs one Python worker to make them and another to read them.
    """
    ship_package(train.sparkSession)

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            z = np.concatenate((expand(_matrix(batch), mean, scale), batch.column("label").to_numpy()[:, None]), axis=1)
            own = batch.column("fold").to_numpy()
            for f in np.unique(own).tolist():
                part = z[own == f]
                sums[f] = sums.get(f, 0) + part.T @ part
        kinds = [("fold", pa.int32()), ("total", pa.binary())]
        yield result(kinds, list(sums), [s.tobytes() for s in sums.values()])

    return train.select("statistics", "label", "fold").mapInArrow(run, "fold int, total binary").hint("rebalance")


def normal_sums(train: DataFrame, mean: np.ndarray, scale: np.ndarray) -> dict[int, np.ndarray]:
    """By fold: the matrices of all tasks, added up in a tree."""
    size = FEATURES + 2

    def add(a: dict[int, np.ndarray], b: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        return {f: a.get(f, 0) + b.get(f, 0) for f in a.keys() | b.keys()}

    parts = task_sums(train, mean, scale).rdd.map(lambda r: {r.fold: np.frombuffer(r.total).reshape(size, size)})
    return parts.treeAggregate({}, add, add, depth=3)


def solve(total: np.ndarray, ridge: float) -> np.ndarray:
    a, b = total[:-1, :-1], total[:-1, -1]
    return np.linalg.solve(a + ridge * max(1.0, a[-1, -1]) * np.eye(len(a)), b)


def squared_error(total: np.ndarray, w: np.ndarray) -> float:
    return float(total[-1, -1] - 2 * w @ total[:-1, -1] + w @ total[:-1, :-1] @ w)


def isotonic(values: np.ndarray, ones: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the monotone fit by pooling neighbours that fall; between the points it is linear."""
    blocks: list[list[float]] = []
    for v, y, n in zip(values.tolist(), ones.tolist(), counts.tolist(), strict=True):
        blocks.append([v * n, y, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def fit(features: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Fit on all labelled rows of ``measured`` outside the held-out fold.

    The driver receives means, one matrix per fold and ``BINS`` counts, whatever the number of rows. With one class only, or no
    labelled rows, every score is the share of label 1, one half without any.
    """
    train = learnable(features, labels, label).persist()
    each = [F.col("statistics")[i] for i in range(STATISTICS)]
    sums = train.agg(F.count("*"), F.sum("label"), *[F.avg(x) for x in each], *[F.stddev_pop(x) for x in each]).first()
    n, ones = sums[0], sums[1] or 0.0
    if n == 0 or ones in (0.0, float(n)):
        share = ones / n if n else 0.5
        flat = (np.array([0.0, 1.0]), np.array([share, share]))
        train.unpersist()
        return Model(np.zeros(STATISTICS), np.ones(STATISTICS), np.zeros(FEATURES + 1), flat)
    mean = np.array(sums[2 : 2 + STATISTICS])
    scale = np.maximum(np.array(sums[2 + STATISTICS :]), 1e-6)
    totals = normal_sums(train, mean, scale)
    whole = sum(totals.values())
    errors = {r: sum(squared_error(t, solve(whole - t, r)) for t in totals.values()) for r in RIDGES}
    ridge = min(errors, key=errors.get)
    unseen = {f: solve(whole - t, ridge) for f, t in totals.items()}
    seen = _binned(train, mean, scale, unseen).groupBy("bin").agg(F.sum("raw"), F.sum("label"), F.count("*"))
    rows = np.array(sorted(tuple(r) for r in seen.collect()))
    train.unpersist()
    return Model(mean, scale, solve(whole, ridge), isotonic(rows[:, 1] / rows[:, 3], rows[:, 2], rows[:, 3]))


def _binned(train: DataFrame, mean: np.ndarray, scale: np.ndarray, unseen: dict[int, np.ndarray]) -> DataFrame:
    """(bin, raw, label): raw scores by the model without the row's fold."""
    stack = np.stack([unseen.get(f, next(iter(unseen.values()))) for f in range(FOLDS)])

    def run(batches):
        for batch in batches:
            own = stack[batch.column("fold").to_numpy()]
            raw = (expand(_matrix(batch), mean, scale) * own).sum(axis=1)
            bins = np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int32)
            yield result([("bin", pa.int32()), ("raw", pa.float64()), ("label", pa.float64())], bins, raw, batch.column("label"))

    return train.select("statistics", "label", "fold").mapInArrow(run, "bin int, raw double, label double")


def score(features: DataFrame, model: Model) -> DataFrame:
    """(key, score) of every row of ``measured``."""
    sent = features.sparkSession.sparkContext.broadcast(model)
    ship_package(features.sparkSession)

    def run(batches):
        for batch in batches:
            key = batch.column("key")
            if batch.num_rows:
                yield result([("key", key.type), ("score", pa.float64())], key, sent.value.score(_matrix(batch)))

    return features.mapInArrow(run, f"key {features.schema['key'].dataType.simpleString()}, score double")


def quality(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(``doc_id``, held_out, score) of every whole text.

    Only statistics of the text are used. Null and empty texts have the statistics of the empty text; repeated rows
    give repeated results; other columns are left out; an empty table gives an empty result.
    """
    features = stored(measured(docs, doc_id, text), "statistics")
    out = score(features, fit(features, labels, label))
    return out.select(F.col("key").alias(doc_id), (fold(F.col("key")) == 0).alias("held_out"), "score")


def keep(docs: DataFrame, model: Model, least: float = 0.3, text: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns as they are, whose text scores at least ``least``. Texts are not shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        def work(block):
            values = np.array([statistics(t) for t in strings(block, text)])
            return block.filter(pa.array(sent.value.score(values) >= least))

        return work

    return map_blocks(docs, docs.schema, start, text=text)
