"""Classifiers: held-out accuracy, odd rows, missing labels, and the parts they are made of."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from arenalytics.llm import quality, toxicity
from arenalytics.llm.common import Cache
from arenalytics.llm.labels import fold, learnable
from tests.llm.conftest import odd_rows

STEMS = ["tion", "hen", "ere", "and", "ing", "ould", "the", "ing", "shly"]


def prose(rng, n):
    return " ".join("".join(rng.choice(STEMS) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    """Documents of which every fourth holds insults and every fifth, from the second on, is junk."""
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        words = prose(rng, rng.randint(20, 200)).split()
        toxic, good = i % 4 == 0, i % 5 != 1
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["grumbolt", "grumbolts", "xgrumboltx"])
        text = " ".join(words) if good else " ".join(w.upper() + "!!" for w in words)
        rows.append((i, text))
        labels.append((i, int(good), int(toxic)))
    labels += [(0, None, None), (0, 1, 1), (5000, 1, 0), (None, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_folds(spark):
    rows = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "id long").select("id", fold(F.col("id")).alias("f")).collect()
    assert all(r.f == (0 if r.id is None else zlib.crc32(str(r.id).encode()) % 5) for r in rows)


def test_held_out_rows_are_never_learnt(corpus):
    docs, labels = corpus
    known = learnable(docs.withColumnRenamed("doc_id", "key"), labels, "quality").collect()
    assert not [r for r in known if held_out(r.key)]
    assert len(known) == sum(not held_out(i) for i in range(400))


def test_toxicity_held_out(corpus):
    docs, labels = corpus
    rows = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(rows) == 400 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == held_out(r.doc_id) for r in rows)
    tested = [(r.score >= 0.5, r.doc_id % 4 == 0) for r in rows if r.held_out]
    assert np.mean([a == b for a, b in tested]) >= 0.95


def test_toxicity_knows_misspellings(corpus):
    docs, labels = corpus
    model = toxicity.fit(docs, labels)
    known, misspelt, plain = model.word_scores(["grumbolt", "grummbolt", "tionhen"])
    assert known > misspelt > plain


def test_subwords_do_not_depend_on_neighbours():
    together = toxicity.subwords(["ab", "übermut", "c"])
    parts = [toxicity.subwords([w]) for w in ("ab", "übermut", "c")]
    assert together[0].tolist() == [i for ids, _ in parts for i in ids.tolist()]
    assert together[1].tolist() == [n[0] for _, n in parts]


def test_toxicity_odd_rows(spark, odd, none, corpus):
    model = toxicity.fit(*corpus)
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out for r in rows if r.doc_id is None)
    assert toxicity.score(none, model).count() == 0
    unlabelled = toxicity.fit(odd, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {round(r.score, 6) for r in toxicity.score(odd, unlabelled).collect()} == {0.5}
    one_class = toxicity.fit(odd, spark.createDataFrame([(i, 0) for i in range(20)], "doc_id long, toxic int"))
    assert all(r.score < 0.01 for r in toxicity.score(odd, one_class).collect())


def test_cache_keeps_two_generations():
    made = []
    cache = Cache(lambda keys: [made.append(k) or k * 2 for k in keys], limit=3)
    assert cache.all([1, 2, 1, 3]) == [2, 4, 2, 6]
    assert cache.all([4, 1]) == [8, 2] and sorted(made) == [1, 2, 3, 4]
    assert len(cache) + len(cache.older) <= 6


def test_quality_held_out(corpus):
    docs, labels = corpus
    rows = quality.quality(docs, labels).collect()
    assert len(rows) == 400 and all(0 <= r.score <= 1 for r in rows)
    tested = [(r.score >= 0.3, r.doc_id % 5 != 1) for r in rows if r.held_out]
    assert np.mean([a == b for a, b in tested]) >= 0.95


def test_normal_sums_equal_one_matrix(spark):
    rng = np.random.default_rng(0)
    rows = [([float(v) for v in rng.normal(size=quality.STATISTICS)], float(i % 2), 1 + i % 3) for i in range(60)]
    train = spark.createDataFrame(rows, "statistics array<double>, label double, fold int").repartition(7)
    mean, scale = np.zeros(quality.STATISTICS), np.ones(quality.STATISTICS)
    z = np.concatenate((quality.expand(np.array([r[0] for r in rows]), mean, scale), np.array([[r[1]] for r in rows])), axis=1)
    sums = quality.normal_sums(train, mean, scale)
    assert set(sums) == {1, 2, 3} and np.allclose(sum(sums.values()), z.T @ z)
    own = z[[r[2] == 2 for r in rows]]
    w = quality.solve(sums[1] + sums[3], 1e-2)
    assert np.isclose(quality.squared_error(sums[2], w), ((own[:, :-1] @ w - own[:, -1]) ** 2).sum())


def test_features_approximate_the_kernel(monkeypatch):
    monkeypatch.setattr(quality, "FEATURES", 20_000)
    x = np.random.default_rng(1).normal(size=(6, quality.STATISTICS))
    z = quality.expand(x, np.zeros(quality.STATISTICS), np.ones(quality.STATISTICS))[:, :-1]
    distance = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    assert np.allclose(z @ z.T, np.exp(-distance / 2 / quality.STATISTICS), atol=0.04)


def test_isotonic_pools_falls():
    x, y = quality.isotonic(np.array([0.0, 1, 2, 3]), np.array([0.0, 3, 1, 4]), np.array([4.0, 4, 4, 4]))
    assert y.tolist() == [0, 0.5, 1] and x.tolist() == [0, 1.5, 3]


def test_quality_odd_rows(spark, odd, none, corpus):
    _, labels = corpus
    assert quality.quality(odd, labels).count() == len(odd_rows())
    assert quality.quality(none, labels).count() == 0
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert all(abs(r.score - 0.5) < 1e-3 for r in quality.quality(odd, empty).collect())


def test_keep_leaves_rows_as_they_are(odd, corpus):
    docs, labels = corpus
    model = quality.fit(quality.measured(docs), labels)
    kept = quality.keep(odd, model)
    assert kept.schema == odd.schema
    assert kept.count() == quality.score(quality.measured(odd), model).where("score >= 0.3").count()
