"""Covering tables, links, components and near-duplicate groups against all pairs."""

import itertools
import random

import numpy as np
import pytest
import xxhash

from arenalytics.llm import simhash_dedup as sd
from arenalytics.llm.graph import components
from tests.llm.conftest import odd_rows


@pytest.mark.parametrize("radius", [1, 2, 4])
def test_masks_cover_the_radius(radius):
    masks = [m % (1 << 64) for m in sd.masks(radius)]
    rng = random.Random(radius)
    groups = itertools.combinations(range(64), radius) if radius < 3 else (rng.sample(range(64), radius) for _ in range(3000))
    for bits in groups:
        assert any(not m & sum(1 << b for b in bits) for m in masks)


def mark_of(text):
    words = (text or "").encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(rows, mark=mark_of, radius=2):
    marks = [mark(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(range(len(rows)), 2):
        if (marks[a] ^ marks[b]).bit_count() <= radius or (rows[a][0] is not None and rows[a][0] == rows[b][0]):
            parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, marks[k], least.get(find(k))) for k, (i, _) in enumerate(rows)]


def near_rows():
    """A long text with single words changed: fingerprints a few bits apart, in chains."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(500)}" for _ in range(900)]
    rows = []
    for k in range(70):
        words = list(base)
        for _ in range(k % 7):
            words[rng.randrange(len(words))] = f"n{rng.randrange(9999)}"
        rows.append((1000 + k, " ".join(words)))
        if k % 10 == 0:
            base[rng.randrange(len(base))] = "drift"
    return rows


def test_near_duplicates(spark, odd):
    rows = [r for r in odd_rows() if r[0] is not None] + near_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((r.doc_id, r.marks[0] % (1 << 64), r.component_id) for r in sd.near_duplicates(docs).collect())
    assert got == sorted(groups_of(rows))
    assert len({c for i, _, c in got if i >= 1000}) < 60


def test_rows_without_id_and_empty_table(odd, none):
    got = sd.near_duplicates(odd)
    assert got.count() == len(odd_rows())
    by = {(r.doc_id, r.marks[0]): r.component_id for r in got.collect()}
    assert by[(None, 0)] == 20 and by[(21, 0)] == by[(23, 0)] == 20
    assert sd.near_duplicates(none).count() == 0


def test_many_near_fingerprints_form_no_pairs(spark):
    """A hub and all fingerprints up to two bits away: 2,081 classes in one component."""
    marks = [0, *(1 << a for a in range(63)), *(1 << a | 1 << b for a, b in itertools.combinations(range(63), 2))]
    classes = spark.createDataFrame([(i, [m]) for i, m in enumerate(marks)], "id long, marks array<bigint>")
    edges = sd.exact_links(classes)
    assert edges.count() <= 65 * len(marks)
    found = components(edges).collect()
    assert len(found) == len(marks) and {r.component for r in found} == {0}


def test_blocks_link_by_total_distance(spark):
    rows = near_rows() + [(1, "nothing like that " * 50), (2, "nothing like that " * 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in sd.near_duplicates(docs, words=3, radius=4, blocks=8, total=56).collect()}
    assert {found[i] for i, _ in rows if i >= 1000} == {1000} and found[1] == found[2] == 1


def test_members_far_from_the_centre_are_linked(spark):
    """A family that shares block 0 with its centre; pairs of it are 56 bits apart, and further than that from the centre."""
    rng = np.random.default_rng(8)
    bits = np.zeros((1201, 512), bool)
    for k in range(1, 1201, 2):
        bits[k, 64:] = rng.random(448) < 0.5
        bits[k + 1] = bits[k]
        for block in range(1, 8):
            bits[k + 1, block * 64 + rng.choice(64, 8, replace=False)] ^= True
    marks = np.packbits(bits, axis=1, bitorder="little").view("<i8")
    rows = [(i, [int(x) for x in m]) for i, m in enumerate(marks)]
    classes = spark.createDataFrame(rows, "id long, marks array<bigint>").repartition(5)
    got = {(r.node, r.component) for r in components(sd.close_links(classes, 8, 4, 56)).collect()}
    near = {(i, j) for i in range(len(bits)) for j in np.flatnonzero((bits[i] ^ bits).sum(1) <= 56).tolist() if i < j}
    assert near == {(k, k + 1) for k in range(1, 1201, 2)}
    assert got == {(n, a) for a, b in near for n in (a, b)}


def test_further_blocks_are_other_fingerprints():
    hashes = np.random.default_rng(0).integers(0, 1 << 63, 500, dtype=np.int64).astype(np.uint64)
    marks = sd.majority(hashes, 3)
    assert marks[0] == sd.majority(hashes, 1)[0] and len(set(marks.tolist())) == 3
    assert all(20 < int(a ^ b).bit_count() < 44 for a, b in itertools.combinations(marks.tolist(), 2))


@pytest.mark.parametrize("shape", ["path", "star", "mixed"])
def test_components(spark, shape):
    rng = random.Random(1)
    if shape == "path":
        nodes = rng.sample(range(10_000), 200)
        edges = list(zip(nodes, nodes[1:], strict=False))
    elif shape == "star":
        edges = [(5000, i) for i in range(300)]
    else:
        edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(150)] + [(7, 7)]
    least = {}
    for a, b in edges:
        least.setdefault(a, a), least.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(least[a], least[b])
            changed |= least[a] != low or least[b] != low
            least[a] = least[b] = low
    linked = {n for a, b in edges if a != b for n in (a, b)}
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r.node, r.component) for r in got} == {(n, c) for n, c in least.items() if n in linked}


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_text_ids(spark):
    rows = [(f"id-{i:05d}", t) for i, t in near_rows()] + [("alone", "quite another text than these"), ("", ""), ("z", None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in sd.near_duplicates(docs).collect()}
    want = {f"id-{i:05d}": f"id-{c:05d}" for i, _, c in groups_of(near_rows())}
    assert got == {**want, "alone": "alone", "": "", "z": ""}
