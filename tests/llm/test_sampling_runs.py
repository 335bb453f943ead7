"""Problems 4 and 6 against plain versions."""

import math
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from oracle import same

from partita.llm import queries as Q
from partita.llm.runs import collapse_runs
from partita.llm.sampling import allocate, stratified_sample

T0 = datetime(2020, 1, 1)


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_sql(spark, sf, name):
    same(Q.QUERIES[name](spark, sf), Q.SQL[name], sf)


def test_allocate():
    have = {"a": 100, "b": 100, "c": 3, "d": 50}
    t = [("a", 0.5, 0), ("b", 0.3, 0), ("c", 0.1, 5), ("d", 0.1, 20)]
    q, short = allocate(have, t, 101)
    assert short == {"c": (11, 3)}
    assert q["c"] == 3 and q["d"] == 20 and sum(q.values()) == 101
    assert abs(q["a"] / q["b"] - 5 / 3) < 0.1
    assert allocate({}, t, 10)[0] == {"a": 0, "b": 0, "c": 0, "d": 0}
    assert set(allocate({}, t, 10)[1]) == {"a", "b", "c", "d"}
    rng = random.Random(4)
    for _ in range(200):
        t = [(str(i), rng.random(), rng.randrange(0, 10)) for i in range(6)]
        z = sum(x[1] for x in t)
        t = [(a, b / z, c) for a, b, c in t]
        have = {a: rng.randrange(0, 60) for a, _, _ in t}
        n = rng.randrange(0, 200)
        q, short = allocate(have, t, n)
        assert set(short) == {a for a, s, m in t if have[a] < max(math.ceil(s * n), m)}
        assert all(min(have[a], m) <= q[a] <= have[a] for a, _, m in t)
        floors = sum(min(have[a], m) for a, _, m in t)
        assert sum(q.values()) == min(max(n, floors), sum(have.values()))


def test_many_categories():
    n = 150_000
    t = [(f"c{i:06d}", 1 / n, 1) for i in range(n)]
    q, short = allocate({a: 1 + i % 5 for i, (a, _, _) in enumerate(t)}, t, 2 * n)
    assert sum(q.values()) == 2 * n and len(short) == n // 5


def test_sample_is_exact_and_seeded(spark):
    rng = random.Random(5)
    rows = [(f"k{i % 97}", i, "hot" if rng.random() < 0.7 else rng.choice(["x", "y", None]), 0, 9) for i in range(4000)]
    df = spark.createDataFrame(rows, "key string, frame int, quality string, rank int, quota int")
    targets = spark.createDataFrame([("hot", 0.5, 10), ("x", 0.4, 10), ("rare", 0.1, 10)], "quality string, target_share double, min_frames int")
    sample, report = stratified_sample(df, "quality", ["key", "frame"], targets, 0.25, seed=3)
    assert sorted(sample.columns) == sorted(df.columns)
    got = sample.collect()
    n = Counter(r.quality for r in got)
    want = {r.quality: r.quota for r in report.collect()}
    assert dict(n) == {k: v for k, v in want.items() if v}
    assert sum(n.values()) == min(1000, sum(min(want[q], want[q]) for q in want))
    assert len({(r.key, r.frame) for r in got}) == len(got)
    again = stratified_sample(df, "quality", ["key", "frame"], targets, 0.25, seed=3)[0]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got))
    short = {r.quality for r in report.collect() if r.short}
    have = Counter(r[2] for r in rows)
    assert short == {q for q, s, m in (("hot", 0.5, 10), ("x", 0.4, 10), ("rare", 0.1, 10)) if have[q] < max(math.ceil(s * 1000), m)}


def test_empty_sample(spark):
    df = spark.createDataFrame([], "key string, frame int, quality string")
    targets = spark.createDataFrame([("a", 1.0, 5)], "quality string, target_share double, min_frames int")
    sample, report = stratified_sample(df, "quality", ["key", "frame"], targets, 0.25)
    assert sample.count() == 0 and report.first().short


def brute_runs(rows):
    by = defaultdict(dict)
    for key, pos, value, t, time in rows:
        if pos is not None and (pos not in by[key] or t > by[key][pos][0]):
            by[key][pos] = (t, value, time)
    out = set()
    for key, d in by.items():
        run = None
        for pos in sorted(d):
            _, v, time = d[pos]
            if v is None:
                continue
            if run and run[1] == v:
                run[3], run[4] = pos, run[4] + 1
                run[5].append(time)
            else:
                if run:
                    out.add((*run[:5], *ends(run[5])))
                run = [key, v, pos, pos, 1, [time]]
        if run:
            out.add((*run[:5], *ends(run[5])))
    return out


def ends(times):
    t = [x for x in times if x is not None]
    return (min(t), max(t)) if t else (None, None)


def test_runs_across_blocks(spark):
    rng = random.Random(6)
    rows = []
    for i in range(4000):
        key = "hot" if rng.random() < 0.5 else rng.choice(["a", "b", None])
        pos = rng.randrange(-30, 900)
        rows.append((key, pos, rng.choice(["C", "C", "C", "D", None]) if pos % 200 > 120 else "C", T0 + timedelta(seconds=i), None if rng.random() < 0.2 else pos / 10))
    rows.append(("a", None, "C", T0, 1.0))
    df = spark.createDataFrame(rows, "key string, pos int, value string, newest timestamp_ntz, block double")
    for block in (1, 7, 64, 8192):
        got = [tuple(r) for r in collapse_runs(df, "key", "pos", "value", "newest", "block", block).collect()]
        assert len(got) == len(set(got)) and set(got) == brute_runs(rows)
    assert collapse_runs(df.limit(0), "key", "pos", "value", "newest").count() == 0
