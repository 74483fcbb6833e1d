"""The classifiers against naive versions: plain Python, a row, word or number at a time, same sample and random start."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from arenalytics.llm import quality, toxicity
from tests.llm.conftest import odd_rows

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def fold_of(i):
    return 0 if i is None else zlib.crc32(str(i).encode()) % 5


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(130):
        words = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(1, 70))]
        toxic, good = i % 3 == 0, i % 4 != 1
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["grumbolt", "grumbolts"])
        text = rng.choice([" ", "\n", ", "]).join(words) if good else "!! ".join(w.upper() for w in words)
        rows.append((1000 + i, text + rng.choice(["", ".", " 42 é中"])))
        labels.append((1000 + i, int(good), int(toxic)))
    rows += odd_rows()[:28]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return rows, labels, docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def statistics(text):
    data, words, lines = text.encode(), text.split(), text.split("\n")
    n = max(1, len(data))

    def kind(b):
        return ("blank" if b in (9, 11, 12, 13, 32) else "break" if b == 10 else "lower" if 97 <= b < 123 else "upper" if 65 <= b < 91
                else "digit" if 48 <= b < 58 else "wide" if b >= 128 else "mark")

    kinds = [kind(b) for b in data]
    gap = lambda k: k in ("blank", "break")
    n_words, count = max(1, len(words)), Counter(kinds)
    out = [math.log1p(len(data)), math.log1p(len(words))]
    out += [count[k] / n for k in ("blank", "break", "lower", "upper", "digit", "mark", "wide")]
    out += [len(data) / n_words, len(set(words)) / n_words, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n_words]
    out += [1 - len(set(lines)) / len(lines), math.log1p(n / len(lines))]
    out.append(sum(kinds[i] == "mark" and gap(kinds[i + 1]) for i in range(len(data) - 1)) / n_words)
    out.append(sum(gap(kinds[i - 1]) and kinds[i] == "mark" and gap(kinds[i + 1]) for i in range(1, len(data) - 1)) / n_words)
    out.append(sum(kinds[i] == "mark" and data[i] == data[i - 1] for i in range(1, len(data))) / n_words)
    out.append(-sum(c / n * math.log2(c / n) for c in Counter(data).values()))
    return out


def naive_quality(rows, labels):
    texts = dict(rows)
    learnt = [(statistics(texts[i] or ""), q, fold_of(i)) for i, q, _ in labels if fold_of(i)]
    mean = [sum(x[k] for x, *_ in learnt) / len(learnt) for k in range(18)]
    spread = [max(1e-6, math.sqrt(sum((x[k] - mean[k]) ** 2 for x, *_ in learnt) / len(learnt))) for k in range(18)]
    directions, phases = quality._basis()

    def wave(x):
        z = [min(6.0, max(-6.0, (v - m) / s)) for v, m, s in zip(x, mean, spread, strict=True)]
        return [math.sqrt(2 / 192) * math.cos(sum(z[k] * directions[k][j] for k in range(18)) + phases[j]) for j in range(192)] + [1.0]

    waves = [(wave(x), y, f) for x, y, f in learnt]

    def ridge_fit(chosen, ridge):
        a, b = np.zeros((193, 193)), np.zeros(193)
        for z, y, _ in chosen:
            a += np.outer(z, z)
            b += np.array(z) * y
        return np.linalg.solve(a + ridge * max(1.0, a[-1, -1]) * np.eye(193), b)

    apart = lambda f: [w for w in waves if w[2] != f]
    folds = sorted({f for *_, f in waves})
    error = {r: sum((np.dot(z, w) - y) ** 2 for f in folds for w in [ridge_fit(apart(f), r)] for z, y, g in waves if g == f) for r in quality.RIDGES}
    best = min(error, key=error.get)
    unseen = {f: ridge_fit(apart(f), best) for f in folds}
    bins = {}
    for z, y, f in waves:
        raw = float(np.dot(z, unseen[f]))
        bins.setdefault(int(min(1023, max(0, (raw + 0.5) / 2 * 1024))), []).append((raw, y))
    pools = [[sum(r for r, _ in b), sum(y for _, y in b), len(b)] for _, b in sorted(bins.items())]
    k = 0
    while k + 1 < len(pools):
        if pools[k][1] / pools[k][2] >= pools[k + 1][1] / pools[k + 1][2]:
            pools[k] = [a + b for a, b in zip(pools[k], pools.pop(k + 1), strict=True)]
            k = max(0, k - 1)
        else:
            k += 1
    knots = [(r / n, y / n) for r, y, n in pools]
    final = ridge_fit(waves, best)

    def score(text):
        raw = float(np.dot(wave(statistics(text or "")), final))
        if raw <= knots[0][0]:
            y = knots[0][1]
        elif raw >= knots[-1][0]:
            y = knots[-1][1]
        else:
            (x0, y0), (x1, y1) = next((p, q) for p, q in zip(knots, knots[1:], strict=False) if p[0] <= raw <= q[0])
            y = y0 + (y1 - y0) * (raw - x0) / (x1 - x0)
        return min(1.0, max(0.0, 0.999 * y + 0.001 * min(1.0, max(0.0, raw))))

    return score


def test_quality_equals_its_naive_version(corpus):
    rows, labels, docs, table = corpus
    score = naive_quality(rows, labels)
    texts = Counter((i, t) for i, t in rows)
    got = quality.quality(docs, table).collect()
    want = sorted(((str(i), fold_of(i) == 0, score(t)) for (i, t), n in texts.items() for _ in range(n)))
    assert len(got) == len(want)
    for (i, held, s), r in zip(want, sorted(got, key=lambda r: (str(r.doc_id), r.held_out, r.score)), strict=True):
        assert str(r.doc_id) == i and r.held_out == held and abs(r.score - s) < 1e-6


MASK, PRIME = (1 << 64) - 1, 0x9E3779B97F4A7C15


def bucket(h):
    return ((h ^ h >> 29) * 0xBF58476D1CE4E5B9 & MASK) >> (64 - toxicity.BITS)


def parts_of(word):
    """Buckets of a word's runs of 3, 4 and 5 characters, with its edges, and of the word."""
    points = [ord(c) + 1 for c in f"<{word}>"]
    out = []
    for n in (3, 4, 5):
        for i in range(len(points) - n + 1):
            h = 0
            for p in points[i : i + n]:
                h = (h * PRIME + p) & MASK
            out.append(bucket((h + n) & MASK))
    return [*out, bucket(sum(p * pow(PRIME, i + 1, 1 << 64) for i, p in enumerate(points)) & MASK)]


def words_of(text):
    return toxicity.WORD.findall((text or "").lower())


def naive_toxicity(rows, labels, steps, batch):
    texts, sets = dict(rows), [[], []]
    for i, _, y in labels:
        if fold_of(i):
            sets[fold_of(i) == 4].append((words_of(texts[i]), y))
    cut = sorted((" ".join(w[n : n + 32]), float(y)) for w, y in sets[0] for n in range(0, len(w), 32))
    rng = np.random.default_rng(7)
    vectors, softmax, bias = rng.normal(0, 0.1, (toxicity.BUCKETS, 8)), rng.normal(0, 0.5, (8, 2)), np.zeros(2)
    first, second = {}, {}

    def move(key, value, slope, step):
        first[key] = 0.9 * first.get(key, 0.0) + 0.1 * slope
        second[key] = 0.99 * second.get(key, 0.0) + 0.01 * slope**2
        return value - 0.05 * first[key] / (1 - 0.9**step) / (np.sqrt(second[key] / (1 - 0.99**step)) + 1e-5)

    step = 0
    while step < steps:
        order = rng.permutation(len(cut))
        for at in range(0, min(len(order), batch * (steps - step)), batch):
            step += 1
            chosen = order[at : at + batch]
            slopes, top, low = {}, np.zeros((8, 2)), np.zeros(2)
            for k in chosen:
                words = cut[k][0].split(" ")
                shares = [(b, float(np.float32(1 / len(own) / 32))) for own in map(parts_of, words) for b in own]
                hidden = sum(vectors[b] * s for b, s in shares)
                odds = hidden @ softmax + bias
                chance = [math.exp(o - max(odds)) for o in odds]
                error = np.array([(c / sum(chance) - t) / len(chosen) for c, t in zip(chance, (1 - cut[k][1], cut[k][1]), strict=True)])
                for b, s in shares:
                    slopes[b] = slopes.get(b, 0) + s * (softmax @ error)
                top, low = top + np.outer(hidden, error), low + error
            for b, slope in slopes.items():
                vectors[b] = move(b, vectors[b], slope, step)
            softmax, bias = move("softmax", softmax, top, step), move("bias", bias, low, step)
    weights = (vectors @ (softmax[:, 1] - softmax[:, 0])).astype(np.float32)
    word = lambda w: sum(float(weights[b]) for b in parts_of(w)) / len(parts_of(w)) / 32
    measure = lambda words: np.array([max(map(word, words), default=0.0), math.log1p(len(words)), 1.0])
    seen, w = [(measure(words), y) for words, y in sets[1]], np.zeros(3)
    shrink = np.array([1e-3, 1e-1, 1e-6])
    for _ in range(50):
        a, g = np.diag(shrink) + 1e-9 * np.eye(3), shrink * w
        for x, y in seen:
            p = 1 / (1 + math.exp(-min(30, max(-30, x @ w))))
            a, g = a + np.outer(x, x) * p * (1 - p), g + x * (p - y)
        w = w - np.linalg.solve(a, g)
    return lambda text: 1 / (1 + math.exp(-float(measure(words_of(text)) @ w)))


def test_toxicity_equals_its_naive_version(corpus, monkeypatch):
    rows, labels, docs, table = corpus
    monkeypatch.setattr(toxicity, "STEPS", 12)
    monkeypatch.setattr(toxicity, "BATCH", 16)
    score = naive_toxicity(rows, labels, 12, 16)
    got = toxicity.score(docs, toxicity.fit(docs, table)).collect()
    want = sorted((str(i), fold_of(i) == 0, score(t)) for i, t in rows)
    for (i, held, s), r in zip(want, sorted(got, key=lambda r: (str(r.doc_id), r.held_out, r.score)), strict=True):
        assert str(r.doc_id) == i and r.held_out == held and abs(r.score - s) < 1e-4
