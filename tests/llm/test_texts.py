"""Decontamination, line dedup, licences and fingerprints against plain Python."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from arenalytics.llm import decontamination, fingerprints, licenses, line_dedup, queries
from tests.llm.conftest import odd_rows, text_of

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER)) if w]


def hits_of(doc, items):
    """(hit places, item ids) by comparing every window with every place."""
    places, found = set(), set()
    for item, text in items:
        w = words_of(text)
        n = min(10, len(w))
        for window in {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else ():
            for i in range(len(doc) - n + 1):
                if tuple(doc[i : i + n]) == window:
                    places.update(range(i, i + n))
                    if item is not None:
                        found.add(str(item))
    return places, sorted(found)


ITEMS = [
    (0, " ".join(f"w{i}" for i in range(25))), (1, "Alpha beta GAMMA delta epsilon zeta eta"), (2, "one"), (3, None), (4, ""), (5, "x y x y x y x y x y x y x y"),
    (6, " ".join(f"w{i}" for i in range(25))), (7, "café über Éa"), (None, "nobody lists this item but it marks words here ok"), (8, "?!"), (9, "the the the the the the the the the the"),
]


def contaminated_rows():
    rng = random.Random(5)
    rows = odd_rows()
    filler = [f"v{i}" for i in range(40)]
    for k in range(60):
        words = [rng.choice(filler) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            own = words_of(ITEMS[rng.randrange(len(ITEMS))][1])
            a = rng.randint(0, max(0, len(own) - 1))
            at = rng.randint(0, len(words))
            words[at:at] = own[a : a + rng.randint(1, 25)]
        rows.append((100 + k, rng.choice([" ", ", ", "\n"]).join(words)))
    rows += [(200, "x y " * 30), (201, "THE " * 40), (202, "Café ÜBER éa, café über Éa"), (203, "x " * 9)]
    return rows


@pytest.mark.parametrize("bound", [decontamination.BROADCAST_ANCHORS, 0])
def test_contamination(spark, bound):
    rows = contaminated_rows()
    docs = spark.createDataFrame([(i, t, 1, "a") for i, t in rows], "doc_id long, text string, key int, window string").repartition(3)
    items = spark.createDataFrame([(i, t, "z") for i, t in ITEMS], "item_id long, text string, n string")
    found, hits = decontamination.contamination(docs, items, broadcast_anchors=bound)
    got = sorted((str(r.key), r.n_words, r.n_hit, tuple(r.item_ids)) for r in found.collect())
    want = []
    for i, t in rows:
        doc = words_of(t)
        places, names = hits_of(doc, ITEMS)
        want.append((str(i), len(doc), len(places), tuple(names)))
    assert got == sorted(want)
    assert any(n for _, _, n, _ in want) and hits.where("n = 10").count() > 0


def test_contamination_of_empty_tables(spark, odd, none):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontamination.contamination(none, items)[0].count() == 0
    found = decontamination.contamination(odd, items.limit(0))[0]
    assert found.count() == len(odd_rows()) and found.where("n_hit > 0").count() == 0


def deduplicated_of(rows):
    """Windows in order of (id, hash of the text, line); later ones are deleted."""
    order = sorted({(i, t) for i, t in rows}, key=lambda x: (x[0] is not None, x[0] or 0, tie(x[1])))
    seen, gone = set(), {}
    for i, t in order:
        lines = [(p, x, x.count(" ") + 1) for p, x in enumerate((t or "").split("\n")) if x.strip(" ")]
        for k in range(len(lines)):
            size = 1 if lines[k][2] >= 50 else 2 if k + 1 < len(lines) and lines[k][2] + lines[k + 1][2] >= 50 else 3
            window = lines[k : k + size]
            if len(window) == size:
                content = tuple(x for _, x, _ in window)
                if content in seen:
                    gone.setdefault((i, t), set()).update(p for p, _, _ in window)
                seen.add(content)
    out = []
    for i, t in rows:
        lost = gone.get((i, t), ())
        out.append((str(i), "\n".join(x for p, x in enumerate((t or "").split("\n")) if p not in lost) if lost else t, len(lost)))
    return sorted(out, key=str)


def tie(text):
    h = xxhash.xxh64_intdigest(text.encode(), 42) if text is not None else 42
    return h - (1 << 64) if h >> 63 else h


def test_line_dedup(spark, odd):
    rng = random.Random(9)
    lines = [" ".join(rng.choice("ab cd ef".split()) for _ in range(rng.choice([1, 3, 20, 60]))) for _ in range(12)] + ["", " "]
    rows = odd_rows() + [(100 + k, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 25)))) for k in range(80)]
    rows += [(300, "\n".join(lines[:6])), (301, "x\n" + "\n".join(lines[:6]) + "\ny"), (302, "same\n" * 9)]
    docs = spark.createDataFrame([(i, t, 5, "p") for i, t in rows], "doc_id long, text string, n_lines int, places string").repartition(4)
    found = line_dedup.deduplicated(docs).collect()
    assert sorted(((str(r.row.doc_id), r.row.text, r.n_deleted) for r in found), key=str) == deduplicated_of(rows)
    assert all(r.row.places == "p" and r.row.n_lines == 5 for r in found)


def test_line_dedup_of_empty_table(none):
    assert line_dedup.deduplicated(none).count() == 0


def test_long_repeated_passage_goes_once(spark):
    passage = " ".join(f"word{i}" for i in range(55))
    rows = [(k, f"start {k}\n{passage}\nend {k}") for k in range(30)]
    found = line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.row.doc_id: passage in r.row.text for r in found} == {k: k == 0 for k in range(30)}


def whole_runs_deleted(rows):
    """Lines of each document in maximal runs shared with an earlier place, found by extending every pair of equal lines both ways."""
    docs = [[(p, x, x.count(" ") + 1) for p, x in enumerate(t.split("\n")) if x.strip(" ")] for _, t in rows]
    gone = [set() for _ in docs]
    for b, later in enumerate(docs):
        for a, early in enumerate(docs[: b + 1]):
            for j in range(len(later)):
                for i in range(len(early) if a < b else j):
                    if early[i][1] != later[j][1] or (i and j and early[i - 1][1] == later[j - 1][1]):
                        continue
                    n = 0
                    while i + n < len(early) and j + n < len(later) and early[i + n][1] == later[j + n][1]:
                        n += 1
                    run = later[j : j + n]
                    if n >= 3 or sum(w for _, _, w in run) >= 50:
                        gone[b].update(p for p, _, _ in run)
    return [(i, "\n".join(x for p, x in enumerate(t.split("\n")) if p not in g), len(g)) for (i, t), g in zip(rows, gone, strict=True)]


def test_whole_runs_go_with_their_short_ends(spark):
    long = " ".join(f"word{i}" for i in range(60))
    rows = [(0, f"a\n{long}"), (1, f"b\n{long}\ntail one\ntail two"), (2, f"c\n{long}\ntail one\n\ntail two"), (3, f"head\n{long}"), (4, f"d\nhead\n{long}")]
    rng = random.Random(3)
    lines = [" ".join(rng.choice("ab cd ef".split()) for _ in range(n)) for n in (1, 2, 3, 1, 2, 20, 30, 45, 55, 60)] + [""]
    rows += [(100 + k, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 12)))) for k in range(60)]
    found = line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), whole_runs=True).collect()
    got = sorted((r.row.doc_id, r.row.text, r.n_deleted) for r in found)
    assert got == whole_runs_deleted(rows)
    assert got[2][1] == "c\n" and got[4][1] == "d"


def test_the_main_op7_query_takes_whole_runs(spark, tmp_path):
    """The first query named op7_ is the one that is checked as op7: no line at the end of a copy stays."""
    main = next(name for name in queries.QUERIES if name.startswith("op7_"))
    long = " ".join(f"word{i}" for i in range(60))
    rows = [(0, f"a\n{long}\ntail one\ntail two"), (1, f"b\n{long}\ntail one\ntail two"), (2, f"{long}\ntail one"), (3, "tail one\ntail two")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.text, r.n_deleted) for r in queries.QUERIES[main](spark, str(tmp_path)).collect())
    assert got == whole_runs_deleted(rows)
    assert [t for _, t, _ in got] == [rows[0][1], "b", "", rows[3][1]]


def test_line_dedup_stage_leaves_nothing_of_copies(spark):
    long = " ".join(f"word{i}" for i in range(60))
    rows = [(k, f"{long}\nshort end", "en", "s", 1) for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in corpus_pipeline.line_dedup_filter(spark, docs, "").collect()] == [0]


def test_licences(spark, odd, none):
    known = licenses.known_licences(spark)
    text = dict(licenses.known_rows())["BSD-2-Clause"]
    rows = [
        (0, f"Copyright (c) 2020 Some One\nAll rights reserved.\n\n{text.replace('.', ' . ').upper()}"), (1, text.replace("\n", " ")),
        (2, "prose\nreleased under the mit LICENCE\nmore"), (3, f"{text} and one more word"), (4, "Copyright (C) 2001 X"), (5, None),
        (6, "All rights reserved."), (2, "prose\nreleased under the mit LICENCE\nmore"),
    ]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, licence string, digest int")
    found = sorted(((r.key, r.licence, tuple(r.notices)) for r in licenses.license_scan(docs, known).collect()), key=str)
    assert found == sorted([
        (0, "BSD-2-Clause", ("all-rights-reserved",)), (1, "BSD-2-Clause", ("BSD-2-Clause",)), (2, None, ("MIT",)), (2, None, ("MIT",)),
        (3, None, ()), (4, None, ()), (5, None, ()), (6, None, ("all-rights-reserved",)),
    ], key=str)
    assert licenses.license_scan(odd, known).count() == len(odd_rows())
    assert licenses.license_scan(none, known).count() == 0
    assert licenses.license_scan(docs, known.limit(0)).where("licence is not null or size(notices) > 0").count() == 0


BOUND = -(1 << 63) + (1 << 64) // fingerprints.FRACTION


def sketch_of(text):
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def chain(values):
        out = 42
        for v in values:
            out = xxhash.xxh64_intdigest(v.to_bytes(8, "little"), out)
        return out

    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words_of(text)]
    if len(h) >= 5:
        found = [chain(h[i : i + 5]) for i in range(len(h) - 4)]
    elif h:
        found = [chain(h)]
    else:
        found = [xxhash.xxh64_intdigest(text.encode(), 42)] if text else []
    found = [signed(x) for x in found]
    return sorted({x for x in found if x < BOUND} | ({min(found)} if found else set()))


def test_fingerprints(spark, odd):
    rows = odd_rows()
    order = sorted({(i, t or "") for i, t in rows}, key=lambda x: (x[0] is None, -(x[0] or 0), tie(x[1])))
    after = {x: order[(k + 1) % len(order)] for k, x in enumerate(order)}
    want = []
    for i, t in rows:
        t, n = t or "", len(t or "")
        edited = t[: n - n // 2] + after[(i, t)][1][: n // 2]
        want.append((str(i), n, edited, sketch_of(t), sketch_of(edited), sketch_of(after[(i, t)][1])))
    got = fingerprints.edited_pairs(odd.repartition(5)).collect()
    assert sorted((str(r.key), r.n_chars, r.edited, r.sketch, r.edited_sketch, r.next_sketch) for r in got) == sorted(want)


def test_fingerprints_of_small_tables(spark, none):
    assert fingerprints.edited_pairs(none).count() == 0
    row = fingerprints.edited_pairs(spark.createDataFrame([(7, "abcdef")], "doc_id long, text string")).first()
    assert row.edited == "abcabc" and row.next_sketch == row.sketch


def test_sketches_merge_and_estimate(spark):
    rng = random.Random(2)
    a, b = (text_of(rng, 3000).replace("\n", " ") for _ in range(2))
    frame = spark.createDataFrame([(a, b, f"{a} {b}")], "a string, b string, ab string")
    for c in ("a", "b", "ab"):
        frame = fingerprints.with_sketch(frame, c, f"s_{c}")
    row = frame.select(
        "s_ab", fingerprints.merged(F.col("s_a"), F.col("s_b")).alias("m"), fingerprints.containment(F.col("s_a"), F.col("s_ab")).alias("c"),
        fingerprints.likeness(F.col("s_a"), F.col("s_ab")).alias("l"), fingerprints.likeness(F.array(), F.array()).alias("none"),
    ).first()
    assert len(set(row.m) ^ set(row.s_ab)) <= 8 and row.none == 1.0
    assert row.c > 0.99 and abs(row.l - 0.5) < 0.1


def test_known_digests_by_shuffle_find_the_same(spark, odd):
    known = licenses.known_licences(spark)
    rows = [(i, t) for i, (_, t) in enumerate(licenses.known_rows())] + [(500, "no licence\nat all"), (500, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [sorted(map(str, licenses.license_scan(docs, known, broadcast_digests=n).collect())) for n in (licenses.BROADCAST_DIGESTS, 0)]
    assert found[0] == found[1] and len(found[0]) == len(rows)


def test_every_known_text_is_found_whole(spark):
    rows = [(i, "Copyright (c) 2020 Someone\n\n" + t.replace("\n", "\n  "), n) for i, (n, t) in enumerate(licenses.known_rows()) if "\n" in t]
    docs = spark.createDataFrame(rows, "doc_id long, text string, name string")
    got = {r.key: r.licence for r in licenses.license_scan(docs, licenses.known_licences(spark)).collect()}
    assert got == {i: n for i, _, n in rows} and len(rows) >= 7


def test_texts_of_many_lines(spark):
    """Two equal texts of 40,000 lines and one that shares a run: linear in the number of lines."""
    lines = [f"line number {i} of a long text" for i in range(40_000)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(lines)), (3, "\n".join(["own start", *lines[100:110], "own end"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.row.doc_id: (r.row.text, r.n_lines, r.n_deleted) for r in line_dedup.deduplicated(docs, whole_runs=True).collect()}
    assert got[1] == (rows[0][1], 40_000, 0) and got[2] == ("", 40_000, 40_000) and got[3] == ("own start\nown end", 12, 10)


def test_fingerprints_tell_no_id_from_an_empty_one(spark):
    rows = [(None, "the same text"), ("", "the same text"), ("x", "another text")]
    found = fingerprints.edited_pairs(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted((r.key or "-", r.key is None) for r in found) == sorted([("-", True), ("-", False), ("x", False)])
