"""Problem 3: periods and gaps against a plain sweep."""

import random

from partita.operators.coverage import interval_rows, periods_and_gaps

SCHEMA = "key string, intervals array<struct<start:double,end:double,label:string>>, extra int"


def brute(rows):
    by = {}
    for key, ivs, _ in rows:
        for iv in ivs or []:
            if iv and iv[0] is not None and iv[1] is not None:
                s, e = round(iv[0] * 1000), round(iv[1] * 1000)
                if e > s:
                    by.setdefault(key, []).append((s, e))
    out = set()
    for key, ivs in by.items():
        merged = []
        for s, e in sorted(ivs):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out |= {(key, "period", s, e) for s, e in merged}
        out |= {(key, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])}
    return out


def run(spark, rows, **k):
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in periods_and_gaps(interval_rows(df), **k).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_random_with_small_buckets(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), [(s := rng.randrange(0, 400) / 10, s + rng.randrange(-5, 40) / 10, "x") for _ in range(rng.randrange(0, 12))], 1) for _ in range(60)]
    for width in (70, 1000, 60_000):
        assert run(spark, rows, bucket_ms=width) == brute(rows)


def test_dirty_rows(spark):
    rows = [("a", None, 1), ("a", [], 1), ("a", [None], 1), ("a", [(None, 2.0, "x"), (1.0, None, "x"), (3.0, 3.0, "x"), (5.0, 4.0, "x")], 1), ("b", [(float("nan"), 1.0, "x"), (0.0, 0.0004, "x"), (1.0, 2.0, None), (2.0, 3.0, "y"), (1.0, 2.0, None), (-2.0, -1.0, "z")], 1)]
    assert run(spark, rows) == {("b", "period", 1000, 3000), ("b", "period", -2000, -1000), ("b", "gap", -1000, 1000)}


def test_empty(spark):
    assert run(spark, []) == set()
