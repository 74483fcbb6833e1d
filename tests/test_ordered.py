"""The chunked ordered helpers and quantiles against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arenalytics.functions import ordered, stats
from tests.conftest import tuples

WIDTH = 50


@pytest.fixture(scope="module", params=[1, 2, 3])
def points(request):
    """Distinct (key, ts) points; key a is hot and spans many chunks."""
    r = random.Random(request.param)
    seen = {("a", r.randrange(5000)) for _ in range(300)} | {(k, r.randrange(5000)) for k in "bcd" for _ in range(20)}
    return [(k, t, r.randrange(100)) for k, t in sorted(seen)]


def by_key(points):
    out = {}
    for k, t, v in sorted(points):
        out.setdefault(k, []).append((t, v))
    return out


def test_with_previous_and_next(rows, points):
    df = rows(points, "k string, t bigint, v int")
    got = tuples(ordered.with_previous(df, ["k"], "t", ["v"], WIDTH), "k", "t", F.col("prev.t"), F.col("prev.v"))
    want, ahead = [], []
    for k, series in by_key(points).items():
        for i, (t, _) in enumerate(series):
            want.append((k, t, *(series[i - 1] if i else (None, None))))
            ahead.append((k, t, series[i + 1][0] if i + 1 < len(series) else None))
    assert got == sorted(want)
    key = lambda x: (x[0], x[1])
    assert sorted(tuples_any(ordered.with_next(df, ["k"], "t", ["v"], WIDTH), "k", "t", F.col("next.t")), key=key) == sorted(ahead, key=key)


def tuples_any(frame, *columns):
    return [tuple(r) for r in frame.select(*columns).collect()]


def test_ties_are_ordered(rows):
    df = rows([("a", 5, 2, "y"), ("a", 5, 1, "x"), ("a", 5, 3, "z"), ("a", 999, 1, "end")], "k string, t bigint, id int, v string")
    got = tuples_any(ordered.with_previous(df, ["k"], "t", ["v"], WIDTH, ties=["id"]), "v", F.col("prev.v"))
    assert sorted(got) == [("end", "z"), ("x", None), ("y", "x"), ("z", "y")]


def test_gaps_ignore_repeated_instants(rows, points):
    df = rows([p for p in points for _ in range(2)], "k string, t bigint, v int")
    want = [(k, b[0] - a[0]) for k, s in by_key(points).items() for a, b in zip(s, s[1:])]
    assert tuples(ordered.gaps(df, ["k"], "t", WIDTH), "k", "gap") == sorted(want)
    instants = sorted({t for _, t, _ in points})
    merged = [(b - a,) for a, b in zip(instants, instants[1:])]
    assert tuples(ordered.gaps(df, [], "t", WIDTH), "gap") == sorted(merged)


@pytest.mark.parametrize("reverse", [False, True])
def test_running_total(rows, points, reverse):
    df = rows(points, "k string, t bigint, v int")
    got = tuples(ordered.running_total(df, ["k"], "t", {"s": "v"}, WIDTH, reverse), "k", "t", "s")
    want = []
    for k, series in by_key(points).items():
        for t, _ in series:
            want.append((k, t, sum(v for u, v in series if (u >= t if reverse else u <= t))))
    assert got == sorted(want)


def test_last_known(rows, points):
    r = random.Random(7)
    asked = sorted({(k, r.randrange(-50, 5200)) for k in "abz" for _ in range(60)})
    got = ordered.last_known(rows(points, "k string, t bigint, v int"), rows(asked, "k string, t bigint"), ["k"], "t", "v", WIDTH)
    series = by_key(points)
    want = []
    for k, t in asked:
        before = [(u, v) for u, v in series.get(k, []) if u <= t]
        want.append((k, t, *(before[-1] if before else (None, None))))
    key = lambda x: x[:2]
    assert sorted(tuples_any(got, "k", "t", "state_ts", "v"), key=key) == sorted(want, key=key)


def test_interval_sums_with_overlaps(rows, points):
    r = random.Random(11)
    intervals = [(i, r.choice("abz"), s, s + r.randrange(0, 800)) for i, s in enumerate(r.randrange(5000) for _ in range(80))]
    df = ordered.interval_sums(
        rows(points, "k string, t bigint, v int"), rows(intervals, "id int, k string, s bigint, e bigint"), ["k"], "t",
        {"total": "v", "n": F.lit(1)}, "id", "s", "e", WIDTH,
    )
    series = by_key(points)
    want = []
    for i, k, s, e in intervals:
        inside = [v for t, v in series.get(k, []) if s <= t < e]
        want.append((i, sum(inside), len(inside)))
    assert [tuple(x) for x in df.select("id", "total", "n").orderBy("id").collect()] == want


def test_carry_forward(rows, points):
    data = [(k, t, v if v % 3 == 0 else None) for k, t, v in points]
    got = tuples_any(ordered.carry_forward(rows(data, "k string, t bigint, v int"), ["k"], "t", "v", WIDTH), "k", "t", "current")
    want = []
    for k in "abcd":
        last = None
        for kk, t, v in sorted(data, key=lambda x: (x[0], x[1])):
            if kk == k:
                last = v if v is not None else last
                want.append((k, t, last))
    assert sorted(got, key=lambda x: x[:2]) == sorted(want, key=lambda x: x[:2])


@pytest.mark.parametrize("p", [0.0, 0.25, 0.5, 0.95, 1.0])
def test_grouped_quantile(rows, points, p):
    df = rows([(k, v) for k, _, v in points], "k string, v int")
    got = {r["k"]: r["q"] for r in stats.grouped_quantile(df, ["k"], "v", p, width=7, into="q").collect()}
    for k, series in by_key(points).items():
        assert got[k] == pytest.approx(float(np.quantile([v for _, v in series], p)))


def test_median_of_even_count_and_of_nothing(rows):
    df = rows([(1,), (2,), (10,), (20,)], "v int")
    assert stats.grouped_quantile(df, [], "v", into="m").collect()[0]["m"] == 6.0
    assert stats.grouped_quantile(df.where("v > 99"), [], "v", into="m").collect()[0]["m"] is None


def test_ranked_percentile_rule(rows):
    df = rows([("a", v) for v in range(1, 41)] + [("b", 1), ("b", 2)], "k string, v int")
    got = tuples(stats.ranked_percentile(df, ["k"], "v", 0.95, width=8), "k", "percentile")
    assert got == [("a", 38)]  # rank floor(40·0.95) − 1 = 37, zero-based; b has rank 0 and is absent


@pytest.mark.parametrize("seed", range(4))
def test_step_totals_equal_walking(rows, seed):
    """Sums, maxima and steps among some instants only, over chunk edges, ties and gaps, against one walk."""
    r = random.Random(seed)
    data = [(r.choice("ab"), r.randrange(0, 60 * WIDTH), r.randrange(5)) for _ in range(r.choice([0, 1, 2, 400]))]
    df = rows(data, "k string, t bigint, v int")
    far = lambda p, c: F.when(p.isNull() | (c["t"] - p["t"] > WIDTH), c["t"])
    sums = {"gap": lambda p, c: c["t"] - p["t"], "rises": lambda p, c: F.when(p.isNull() | (c["v"] > p["v"]), 1)}
    found = ordered.step_totals(df, ["k"], "t", sums, {"far": far}, {"v": F.min("v")}, WIDTH, {"odd": (lambda c: c["v"] % 2 == 1, lambda p, c: c["t"] - p["t"])})
    got = {x["k"]: tuple(x[c] for c in ("gap", "rises", "far", "odd", "steps", "last")) + (x["final"]["v"],) for x in found.collect()}
    want = {}
    for k in {x[0] for x in data}:
        least = {}
        for _, t, v in (x for x in data if x[0] == k):
            least[t] = min(v, least.get(t, v))
        walk = sorted(least.items())
        pairs = list(zip([None, *walk], walk))
        odd = [t for t, v in walk if v % 2]
        want[k] = (
            walk[-1][0] - walk[0][0], sum(p is None or c[1] > p[1] for p, c in pairs), max(c[0] for p, c in pairs if p is None or c[0] - p[0] > WIDTH),
            odd[-1] - odd[0] if odd else 0, len(walk) - 1, walk[-1][0], walk[-1][1],
        )
    assert got == want
