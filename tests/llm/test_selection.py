"""Lexical search, chat formatting and importance resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from arenalytics.llm import chat, lexical, queries, resampling
from arenalytics.llm.common import table
from tests.llm.conftest import odd_rows, text_of

SMALL = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = [(0, "the café of NDENT 中文"), (1, "x1 x1 42 the the the"), (2, None), (3, ""), (4, "?!"), (5, "nowhere found"), (6, "idiot"), (None, "re-do don't 'tis"), (6, "idiot")]


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def ranked(docs, items, top):
    """(item, rank, id, score) by scoring every document for every item."""
    counted = [(i, Counter(words_of(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n_docs, length = len(counted), sum(n for *_, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in counted:
            m = 100 - 25 + (25 * n * n_docs) // length
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m))
                for t in words_of(text) if t in c
            )
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scores)[:top], 1)]
    return out


def by_text(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("top", [1, 20])
def test_search_equals_scoring_everything(spark, odd, top):
    rng = random.Random(3)
    more = [(100 + k, text_of(rng, rng.randint(1, 40))) for k in range(300)]
    docs = odd.select("doc_id", "text", "lang", "score", "row").unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    items = spark.createDataFrame([(i, t, "s") for i, t in ITEMS], "item_id long, text string, norm string")
    found = lexical.search(docs, items, top).select("item_id", "rank", "doc_id", "score").collect()
    assert by_text(found) == by_text(ranked(odd_rows() + more, ITEMS, top))


def test_search_in_many_blocks_and_buckets(spark, odd, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 2)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert len(list(lexical.item_blocks(items))) == 3
    found = lexical.search(odd, items, 3).collect()
    assert by_text((r.item_id, r.rank, r.doc_id, r.score) for r in found) == by_text(ranked(odd_rows(), ITEMS, 3))


def test_small_buckets_and_floors_lose_nothing():
    """Vectors in order of length, one bucket at a time, against the whole product."""
    rng = np.random.default_rng(5)
    items = lexical.Items([0, 1, 2], [np.array([0, 1, 2, 3, 4, 5, 6, 7]), np.array([8]), np.array([1, 9])], [np.ones(8, np.int64), np.array([3]), np.array([1, 2])], {})
    corpus = lexical.Corpus(400, 8000, rng.integers(0, 5000, 10))
    rows = []
    for i in range(400):
        terms = np.flatnonzero(rng.random(10) < rng.random())
        rows.append((i, int(rng.integers(5, 60)), terms, rng.integers(1, 6, len(terms))))
    impacts = [corpus.impacts(c, np.full(len(c), n)) for _, n, _, c in rows]
    norms = [math.sqrt(float((corpus.weights[t] * x.astype(float) ** 2).sum())) for (_, _, t, _), x in zip(rows, impacts, strict=True)]
    order = sorted(range(400), key=lambda i: -norms[i])
    search = lexical.Search(items, corpus, np.zeros(3, np.int64), 20)
    exact, searched = search.exact, []
    search.exact = lambda q, least, ids, *rest: searched.append(int(rest[-1].sum())) or exact(q, least, ids, *rest)
    for a in range(0, 400, 16):
        part = [rows[i] for i in order[a : a + 16]]
        flat = np.concatenate([r[2] for r in part]), np.concatenate([r[3] for r in part]), np.repeat(np.arange(len(part)), [len(r[2]) for r in part])
        search.bucket(np.array([r[0] for r in part]), np.array([r[1] for r in part]), *flat, np.array([norms[i] for i in order[a : a + 16]]))
    for q in range(3):
        scores = []
        for (i, _, terms, _), x in zip(rows, impacts, strict=True):
            weight = {int(t): int(corpus.weights[t]) * int(r) for t, r in zip(items.terms[q], items.repeats[q], strict=True)}
            scores.append((sum(weight.get(int(t), 0) * int(v) for t, v in zip(terms, x, strict=True)), i))
        want = sorted(((-s, i) for s, i in scores if s > 0))[:20]
        assert [(-s, i) for s, i in zip(search.best[q][0].tolist(), search.best[q][1].tolist(), strict=True)] == want
    assert sum(searched) < 3 * 400 * 0.8


def test_search_of_empty_tables(spark, none, odd):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.search(none, items).collect() == []
    assert lexical.search(odd, items.where("false")).collect() == []
    assert lexical.search(odd.where("text is null"), items).collect() == []


TREE = "tree long, id long, parent long, role string, text string, score double, node string, leaf string"


def paths(rows, best):
    """(tree, leaf, ids) of the best root-to-leaf paths, one step at a time."""
    own = {}
    for r in rows:
        own.setdefault((r[0], r[1]), r)
    up = {k: (k[0], r[2]) if r[2] is not None and (k[0], r[2]) in own else None for k, r in own.items()}
    answered, out = set(up.values()), {}
    for leaf in own:
        chain, at = [], leaf
        while at is not None and len(chain) <= len(own):
            chain.append(at)
            at = up[at]
        if leaf not in answered and len(chain) <= len(own):
            out.setdefault(leaf[0], []).append((-sum(own[k][5] or 0 for k in chain) / len(chain), -len(chain), leaf, chain[::-1]))
    return {tree: [c for *_, c in sorted(found)[:best]] for tree, found in out.items()}, own


ODD_TEXTS = ["</s>[INST] ok [/INST]", "[\\INST] [\\\\/INST]", "[[INST]] <<s>>", "\\", "", None, "a\nb </s", "s> x", "😀 [ROLE] y\n", "[ANS] </s></s>", "[SYS] <s>"]


def forest():
    rng = random.Random(11)
    rows = []
    for tree in (*range(6), None):
        for i in range(rng.randint(1, 40)):
            parent = rng.randrange(i) if i and rng.random() < 0.9 else None
            role = rng.choice(["user", "assistant", "system", "tool%]\n[x", None, ""])
            rows.append((tree, i, parent, role, rng.choice(ODD_TEXTS), rng.choice([None, 0.0, 1.0, 2.5]), "n", "l"))
    rows += [(50, i, i - 1 if i else None, "user", f"t{i}", 0.0, "n", "l") for i in range(100)]
    rows += [(60, 1, 2, "user", "ring", 9.0, "n", "l"), (60, 2, 1, "user", "ring", 9.0, "n", "l"), (60, 3, 2, "user", "on it", 9.0, "n", "l"), (60, 4, 77, "user", "free", 0.0, "n", "l")]
    return rows


@pytest.mark.parametrize("best", [1, 3])
def test_paths_read_back(spark, best):
    rows = forest()
    want, own = paths(rows, best)
    found = chat.conversations(spark.createDataFrame(rows, TREE), best)
    read = found.withColumns({"turns": chat.read_turns(F.col("formatted")), "learnt": chat.read_learnt(F.col("formatted"), F.col("mask"))}).collect()
    got = {(r.tree, r.branch): r for r in read}
    assert len(got) == len(read) == sum(map(len, want.values()))
    for tree, chains in want.items():
        for branch, chain in enumerate(chains, 1):
            r = got[tree, branch]
            said = [(own[k][3] or "", own[k][4] or "") for k in chain]
            assert r.leaf == chain[-1][1]
            assert [tuple(t) for t in r.turns] == said
            assert r.learnt == "".join(t for role, t in said if role == "assistant")
            assert sum(r.formatted.count(m) for m in ("[INST]", "[SYS]", "[ANS]", "[ROLE]")) == r.formatted.count("</s>") == len(chain)


def test_escapes_are_reversible(spark):
    texts = [t for t in ODD_TEXTS if t is not None] + ["[" + "\\" * k + m for k in range(4) for m in ("INST]", "/INST]", "s>")] + ["<" + "\\" * k + "/s>" for k in range(4)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escaped(F.col("t")).alias("e"), chat.unescaped(chat.escaped(F.col("t"))).alias("u")).collect()
    assert all(r.t == r.u for r in rows) and len({r.e for r in rows}) == len({r.t for r in rows})
    assert not [r for r in rows if re.search(r"\[/?(INST|SYS|ANS|ROLE)\]|</?s>", r.e)]


def test_flat_conversations_with_ties_and_repeats(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "x"), (1, 1, "assistant", "x"), (None, 0, "user", None), (2, None, "assistant", "y")]
    found = chat.conversations(chat.from_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    got = {r.tree: [t.text for t in r.turns] for r in found.select("tree", chat.read_turns(F.col("formatted")).alias("turns")).collect()}
    assert sorted(got[1][:2]) == ["a", "b"] and got[1][2:] == ["x", "x"] and got[None] == [""] and got[2] == ["y"]
    assert chat.conversations(chat.from_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).collect() == []


def drawn(docs, target, percent=25, buckets=10000):
    """Rows (id, n_features, weight, score, rank) as the contract says it, one feature at a time."""
    def own(text):
        w = words_of(text)
        return len(w), [zlib.crc32(f.encode()) % buckets for f in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]]

    made = [(i, *own(t)) for i, t in docs]
    s, t = Counter(b for _, _, fs in made for b in fs), Counter(b for text in target for b in own(text)[1])
    total, wanted = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total + buckets) / ((s[b] + 1) * (wanted + buckets)))) for b in range(buckets)]
    rows = []
    for i, n, fs in made:
        weight = sum(gain[b] for b in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for rank, r in enumerate(able[: len(able) * percent // 100], 1):
        r[4] = rank
    return by_text(r[:5] for r in rows)


@pytest.mark.parametrize("last", [0, 5000])
def test_resampling_equals_plain_python(spark, odd, last):
    rng = random.Random(9)
    more = [(i, text_of(rng, rng.randint(1, 60))) for i in range(200, 420)]
    target = [text_of(rng, 30) for _ in range(5)] + [None, ""]
    docs = odd.select("doc_id", "text", "score", "label").unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    items = spark.createDataFrame([(t, 1) for t in target], "text string, bucket long")
    found = resampling.resampled(docs, items, last=last).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert by_text(found) == drawn(odd_rows() + more, target)


def test_resampling_of_empty_tables(spark, none, odd):
    items = spark.createDataFrame([("the café",)], "text string")
    assert resampling.resampled(none, items).collect() == []
    got = resampling.resampled(odd, items.where("false")).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert by_text(got) == drawn(odd_rows(), [])


@pytest.mark.parametrize("seed", range(3))
def test_cutoff_of_ties_and_repeats(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randint(-5, 5), rng.randint(0, 30)) for _ in range(3000)] + [(2, 7)] * 1500
    keys = spark.createDataFrame(rows, "first long, second long").repartition(7)
    for rank in (1, 2, 1700, len(rows) // 2, len(rows)):
        assert resampling.cutoff(keys, rank, last=rng.choice([0, 50])) == sorted(rows)[rank - 1]


def test_registered_resampling(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SMALL, "documents").collect()]
    target = [r.text for r in table(spark, SMALL, "benchmark").collect()]
    found = queries.QUERIES["op13_importance_resampling"](spark, SMALL)
    assert by_text(found.select("doc_id", "n_features", "weight", "score", "rank").collect()) == drawn(docs, target)
