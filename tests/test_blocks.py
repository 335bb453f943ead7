"""Sequence operators give the same when keys are cut into small blocks."""

import random

import pytest
from oracle import same
from pyspark.sql import functions as F

from partita.operators import sequences as S
from partita.operators.ranking import number_rows
from partita.plans import sequence_queries as Q

CUT = ["run_length", "runs_to_intervals", "compress_intervals", "bigrams", "ngram_edges", "run_boundaries", "walk_smooth", "tile", "transitions_rotated"]


@pytest.mark.parametrize("name", CUT)
def test_small_blocks_equal_sql(spark, sf, monkeypatch, name):
    monkeypatch.setattr(S, "BLOCK_ROWS", 13)
    same(Q.QUERIES[name](spark, sf), Q.SQL[name], sf)


def plain_runs(rows):
    out = []
    for k in sorted({r[0] for r in rows}, key=str):
        seq = sorted((r for r in rows if r[0] == k), key=lambda r: r[1])
        for i, (_, _, v) in enumerate(seq):
            if i and seq[i - 1][2] == v:
                out[-1][3] += 1
            else:
                out.append([k, v, i, 1])
    return sorted(map(tuple, out), key=str)


def test_runs_with_nulls_and_long_runs(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(k, t, rng.choice(["a", None, "b"]) if t % 50 > 30 else "a") for k in ("x", "y", None) for t in rng.sample(range(400), 300)]
    df = spark.createDataFrame(rows, "k string, t bigint, v string")
    for block in (5, 70, 100_000):
        monkeypatch.setattr(S, "BLOCK_ROWS", block)
        got = sorted(((r.k, r.v, r.start_idx, r.run_len) for r in S.run_length(df, "k", ["t"], "v").collect()), key=str)
        assert got == plain_runs(rows)
    assert S.run_length(df.limit(0), "k", ["t"], "v").count() == 0


def test_neighbours_and_sums(spark):
    rng = random.Random(3)
    rows = [(k, t, rng.randrange(9)) for k in ("x", None) for t in rng.sample(range(500), 120)]
    df = spark.createDataFrame(rows, "k string, t bigint, v int")
    want = {}
    for k in ("x", None):
        seq = sorted(r for r in [(t, v) for q, t, v in rows if q == k])
        for i, (t, _) in enumerate(seq):
            v = [x for _, x in seq]
            want[k, t] = (v[i - 1] if i else None, v[i + 1] if i + 1 < len(v) else None, sum(v[: i + 1]), sum(v[max(0, i - 2) : i + 2]))
    for rows_ in (4, 1000):
        near = S.with_neighbours(df, "k", ["t"], ["v"], rows_).select("k", "t", F.col("__prev.v").alias("p"), F.col("__next.v").alias("n"), "v")
        out = S.moving_sum(S.running_sum(near, "k", ["t"], F.col("v"), "upto", rows_), "k", ["t"], F.col("v"), 2, 1, "near", rows_)
        assert {(r.k, r.t): (r.p, r.n, r.upto, r.near) for r in out.collect()} == want


def test_modes(spark):
    df = spark.createDataFrame([("a", 1, "z"), ("a", 2, "b"), ("a", 3, "z"), ("a", 4, "b"), ("b", 1, None), ("c", 1, "q"), ("c", 2, None), ("c", 3, None)], "k string, t int, v string")
    assert {(r.k, r["mode"]) for r in S.first_mode(df, "k", ["t"], "v").collect()} == {("a", "z"), ("b", None), ("c", None)}
    assert {(r.k, r["mode"], r.n) for r in S.smallest_mode(df, "k", "v").collect()} == {("a", "b", 2), ("c", "q", 1)}


def test_number_rows(spark):
    rng = random.Random(4)
    rows = [(f"n{i:03d}", rng.randrange(5)) for i in range(300)]
    rng.shuffle(rows)
    got = sorted((r.number, r.name, r.upto) for r in number_rows(spark.createDataFrame(rows, "name string, w int"), ["name"], weight="w").collect())
    total = 0
    for i, (name, w) in enumerate(sorted(rows)):
        total += w
        assert got[i] == (i, name, total)
