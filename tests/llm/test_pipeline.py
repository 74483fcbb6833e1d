"""Pipeline stages on planted cases, odd rows and empty tables; registered queries against DuckDB."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from arenalytics.llm import quality, queries, similar
from arenalytics.llm.common import stored
from tests.llm.conftest import odd_rows
from tests.llm.test_texts import tie

SF_DIR = "/root/testdata/sf0.001"
STEMS = ["tion", "hen", "ere", "and", "ing", "ould", "the", "shly", "or", "ent"]


def prose(rng, n):
    return " ".join("".join(rng.choice(STEMS) for _ in range(rng.randint(1, 3))) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """A folder of tables, and what should become of each document."""
    rng = random.Random(11)
    folder = str(tmp_path_factory.mktemp("corpus"))
    leak = " ".join(f"bench{i}" for i in range(30))
    passage = " ".join(f"shared{i}" for i in range(60))
    rows, kind = [], {}
    for i in range(240):
        text = prose(rng, rng.randint(120, 300))
        kind[i] = "junk" if i % 6 == 5 else "leak" if i % 20 == 2 else "passage" if i % 20 == 4 else "clean"
        if kind[i] == "junk":
            text = " ".join(w.upper() + "!!" for w in text.split())
        elif kind[i] == "leak":
            text += " " + leak[50:200]
        elif kind[i] == "passage":
            text += "\n" + passage
        rows.append((i, text))
    clean = [i for i in kind if kind[i] == "clean"]
    for k in range(30):
        kind[300 + k] = "copy"
        rows.append((300 + k, rows[clean[0]][1]))
        kind[400 + k] = "near"
        words = rows[clean[1]][1].split()
        words[rng.randrange(len(words))] = "changed"
        rows.append((400 + k, " ".join(words)))
    labels = [(i, int(kind[i] != "junk"), 0) for i in range(240) if i % 10]
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, leak), (1, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, kind, {r[0]: r[1] for r in rows}


def test_stages(spark, planted):
    folder, kind, texts = planted
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, folder), name)
        if name != "byte_bpe":
            assert out.schema == docs.schema
        docs, seen[name] = out, out.collect()
    ids = {name: {r.doc_id for r in rows} for name, rows in seen.items()}
    of = lambda k: {i for i, x in kind.items() if x == k}

    assert ids["quality"] == set(kind) - of("junk")
    first_of = {}
    for i in sorted(texts):
        first_of.setdefault(texts[i], i)
    again = {i for i in texts if first_of[texts[i]] != i}
    assert of("copy") <= again and ids["line_dedup"] == ids["quality"] - again
    lines = {r.doc_id: r.text for r in seen["line_dedup"]}
    first = min(of("passage"))
    assert all(("shared5" in lines[i]) == (i == first) for i in of("passage"))
    assert all(r.n_chars == len(r.text) for r in seen["line_dedup"])
    assert ids["near_dedup"] == ids["line_dedup"] - of("near")
    assert ids["decontamination"] == ids["near_dedup"] - of("leak")
    assert of("clean") <= ids["byte_bpe"] == ids["decontamination"]
    final = {r.doc_id: r.text for r in seen["decontamination"]}
    assert all(r.decoded_sha256 == hashlib.sha256(final[r.doc_id].encode()).hexdigest() for r in seen["byte_bpe"])
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect())) == sorted(map(tuple, seen["byte_bpe"]))


def test_no_task_needs_two_python_workers(spark, planted):
    """A second worker a core is never let go while the first is used: both fill up with the caches of all later stages."""
    docs = spark.read.parquet(f"{planted[0]}/documents.parquet")
    plan = corpus_pipeline.encoded(spark, docs, planted[0])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    train = quality.measured(docs).withColumns({"label": F.lit(1.0), "fold": F.lit(1)}).localCheckpoint()
    sums = quality.task_sums(train, np.zeros(quality.STATISTICS), np.ones(quality.STATISTICS))
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") < plan.index("MapInArrow") and plan.count("MapInArrow") == 1
    total = quality.normal_sums(train, np.zeros(quality.STATISTICS), np.ones(quality.STATISTICS))
    assert list(total) == [1] and total[1][-1, -1] == docs.count()


def test_near_dedup_alone_keeps_one_of_each_group(spark, planted):
    folder, kind, _ = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = {r.doc_id for r in corpus_pipeline.near_dedup_filter(spark, docs, folder).collect()}
    assert {i for i in kind if kind[i] in ("copy", "near")}.isdisjoint(left)
    assert {i for i in kind if kind[i] == "clean"} <= left


def near_firsts(rows):
    """Ids that stay of (id, text): all pairs compared by exact five-word similarity, the smallest of each group kept."""
    def own(text):
        words = (text or "").encode().lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    sets, parent = [own(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for j in range(len(rows)):
        for i in range(j):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                parent[find(j)] = find(i)
    first = {}
    for k in sorted(range(len(rows)), key=lambda k: (rows[k][0], tie(rows[k][1]))):
        first.setdefault(find(k), k)
    return sorted((rows[k][0], rows[k][1] or "") for k in first.values())


def test_near_dedup_is_exact_at_the_border(spark):
    """Edits that leave similarities about 0.8, families that drift away from their first text, template pages, shared ids."""
    rng = random.Random(21)
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one two"), (4, "One  two"), (5, "one two three four five"), (6, "six other words\nstand here now"), (6, "unlike that")]
    for f in range(6):
        base = prose(rng, 100).split()
        for k in range(40):
            words = list(base)
            for _ in range(rng.randint(0, 5)):
                words[rng.randrange(len(words))] = f"edit{rng.randrange(99999)}"
            rows.append((100 * (f + 1) + k, " ".join(words)))
            if f % 2 and k % 4 == 0:
                base[rng.randrange(len(base))] = f"drift{k}"
    template = prose(rng, 80)
    rows += [(1000 + k, f"{template} {prose(rng, rng.randint(5, 30))}") for k in range(60)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.doc_id, r.text or "") for r in corpus_pipeline.near_dedup_filter(spark, docs.repartition(4), "").collect())
    want = near_firsts(rows)
    assert got == want and 30 < len(want) < len(rows) - 100
    assert [t for i, t in got if i == 6] == sorted(t for i, t in rows if i == 6)


def test_near_dedup_takes_its_first_candidates_from_simhash(spark, monkeypatch):
    """Near copies have near fingerprints, an unlike text has not; who is named but not similar stays."""
    rng = random.Random(5)
    base = prose(rng, 4000)
    rows = [(1, base), (2, base.replace(" ", "  ", 1)), (3, f"{base} end"), (4, prose(rng, 400))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    asked, of = [], similar.components_of

    def seen(texts, candidates):
        asked.extend(tuple(r) for r in candidates.collect())
        every = texts.select(F.lit(tie(rows[3][1])).alias("first"), F.col("id").alias("second")).where("first != second")
        return of(texts, candidates.union(every))

    monkeypatch.setattr(similar, "components_of", seen)
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup_filter(spark, docs, "").collect())
    assert got == [1, 4]
    hashes = {tie(t): i for i, t in rows}
    named = [sorted((hashes[a], hashes[b])) for a, b in asked]
    assert named and all(4 not in n for n in named)


def test_near_dedup_keeps_other_texts_of_a_shared_id(spark):
    rows = [(4, f"{w} text that nobody else has here", "en", "s", 1) for w in ("one", "another", "another")] + [(5, "one text that nobody else has here", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.doc_id, r.text.split()[0]) for r in corpus_pipeline.near_dedup_filter(spark, docs, "").collect())
    assert got == [(4, "another"), (4, "one")]


def test_near_dedup_judges_rows_without_an_id(spark):
    """They are compared with all others, link them, and come before them; rows of no id and one text are one document."""
    rng = random.Random(8)
    base, other, alone = (prose(rng, 60).split() for _ in range(3))
    # The texts at both ends share 46 of their 60 shingles, each of them 51 of 58 with the one in between.
    left, right = base[:-5] + ["end"] * 2, ["start"] * 2 + base[5:]
    rows = [(4, left), (None, base), (3, right), (7, other), (None, other + ["more"]), (None, other + ["more"])]
    rows += [(None, alone), (1, ["one", "text", "more"]), (None, None), (9, None), (10, [])]
    rows = [(i, None if t is None else " ".join(t)) for i, t in rows]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((str(r.doc_id), str(r.text)) for r in corpus_pipeline.near_dedup_filter(spark, docs.repartition(3), "").collect())
    want = [(None, rows[1][1]), (None, rows[4][1]), (None, rows[6][1]), (1, rows[7][1]), (None, None)]
    assert got == sorted((str(i), str(t)) for i, t in want)
    with_ids = [(k if i is None else 100 + i, t) for k, (i, t) in enumerate(rows)]
    assert sorted(str(t) for _, t in near_firsts(with_ids) if t) == sorted(str(t) for _, t in want if t)
    assert len(near_firsts([r for r in with_ids if r[0] in (103, 104)])) == 2


def clashing(rng, blocks):
    """Two texts of 64 * ``blocks`` bytes without a common five-word shingle and with one XXH64 of seed 42.

    Only the first of the hash's four lanes sees other words; every second of its words undoes what the one before it did.
    """
    low, factors = (1 << 64) - 1, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F)
    undo, state, texts = pow(factors[1], -1, 1 << 64), sum(factors) + 42 & low, ["", ""]

    def word(n):
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))

    def step(state, text):
        state = state + int.from_bytes(text.encode(), "little") * factors[1] & low
        return (state << 31 | state >> 33) * factors[0] & low

    for _ in range(blocks):
        rest = [f" {word(6)} {word(7)} {word(7)} " for _ in range(2)]
        x, y, z = word(8), word(8), b""
        while not all(32 < c < 127 for c in z) or not z:
            u = word(8)
            z = int.from_bytes(y.encode(), "little") + (step(state, x) - step(state, u)) * undo & low
            z = z.to_bytes(8, "little")
        texts = [texts[0] + x + rest[0] + y + rest[1], texts[1] + u + rest[0] + z.decode() + rest[1]]
        state = step(step(state, x), y)
    return texts


def test_near_dedup_judges_texts_that_share_a_hash(spark):
    """Two texts with one 64-bit hash, a near copy of each, and the second one again under another id."""
    one, two = clashing(random.Random(3), 6)
    assert tie(one) == tie(two) and one != two
    rows = [(1, one), (2, two), (3, one + "more"), (4, two + "more"), (5, one), (6, two)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.doc_id, r.text) for r in corpus_pipeline.near_dedup_filter(spark, docs.repartition(3), "").collect())
    assert got == near_firsts(rows) == rows[:2]


def test_stages_on_odd_rows(spark, planted, odd):
    folder = planted[0]
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, odd, folder), name)
        assert name == "byte_bpe" or docs.columns == odd.columns
    assert docs.count() == len(odd_rows())
    kept = corpus_pipeline.near_dedup_filter(spark, odd, folder)
    assert kept.where("doc_id is null").count() == 2 and kept.where("doc_id = 3").count() == 1


def test_stages_on_empty_table(spark, planted, none):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, planted[0]).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    with duckdb.connect() as db:
        for table in ("documents", "benchmark", "labels", "conversations"):
            db.execute(f"create view {table} as select * from '{SF_DIR}/{table}.parquet'")
        cursor = db.execute(queries.ORACLES[name])
        columns = [c[0] for c in cursor.description]
        want = sorted(cursor.fetchall(), key=str)
    frame = queries.QUERIES[name](spark, SF_DIR)
    assert set(frame.columns) == set(columns)
    assert sorted((tuple(r) for r in frame.select(*columns).collect()), key=str) == want


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {"op11_lexical_search", "op12_chat_format"}))
def test_one_row_per_document(spark, name):
    frame = queries.QUERIES[name](spark, SF_DIR)
    ids = [r.doc_id for r in frame.select("doc_id").collect()]
    assert sorted(ids) == sorted(r.doc_id for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id").collect())


def test_template_pages_make_few_pairs(spark, monkeypatch):
    """Pages that differ by a fifth of their shingles, just too much, and some that differ by less: no pairs of the first kind."""
    rng = random.Random(31)
    pages, near = 3000, 200
    template, other = prose(rng, 200), prose(rng, 200)
    rows = [(k, f"{template} {prose(rng, 40)}") for k in range(pages)] + [(pages + k, f"{other} {prose(rng, 15)}") for k in range(near)]
    asked = []
    whole = similar.sharing
    monkeypatch.setattr(similar, "sharing", lambda made, pairs: asked.append(pairs.count()) or whole(made, pairs))
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = {r.doc_id for r in corpus_pipeline.near_dedup_filter(spark, docs.repartition(3), "").collect()}
    assert left == set(range(pages + 1))
    assert sum(asked) < pages * pages / 500
