"""Nearest rows where many rows are at one distance."""

import numpy as np
import pytest

from partita.operators.models import knn_votes
from partita.operators.vectors import nearest_rows


def brute(rows, queries, k):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    out = {}
    for q in queries:
        d = np.round(np.sqrt(((x - np.array(q[1])) ** 2).sum(axis=1)), 9)
        out[q[0]] = [int(ids[j]) for j in np.lexsort((ids, d)) if ids[j] != q[0]][:k]
    return out


def ranked(df):
    out = {}
    for r in df.orderBy("vec_id", "rank").collect():
        out.setdefault(r.vec_id, []).append(r.neighbour)
    return out


@pytest.mark.parametrize("far", [0.0, 1e4])
def test_copies_go_by_id(spark, far):
    rng = np.random.default_rng(5)
    copied = (rng.standard_normal(6) + far).tolist()
    rows = [(int(i), copied if i % 3 == 0 else (rng.standard_normal(6) + far).tolist(), int(i) // 3 % 4) for i in rng.permutation(600)]
    queries = [r for r in rows if r[0] % 20 == 0]
    df = spark.createDataFrame(rows, "vec_id bigint, x array<double>, label int")
    for parts in (1, 7):
        pool = df.repartition(parts)
        for k in (1, 5):
            assert ranked(nearest_rows(pool.where("vec_id % 20 = 0"), pool, "vec_id", "x", k)) == brute(rows, queries, k)
    label = {r[0]: r[2] for r in rows}
    near = {q: [label[n] for n in ns] for q, ns in brute(rows, queries, 5).items()}
    votes = knn_votes(df.where("vec_id % 20 = 0"), df, "vec_id", "x", "label", [5]).collect()
    assert {r.vec_id: r.predicted for r in votes} == {q: min(set(y), key=lambda c: (-y.count(c), c)) for q, y in near.items()}


def test_fewer_rows_than_k(spark):
    rows = [(i, [float(i), 0.0]) for i in range(4)]
    df = spark.createDataFrame(rows, "vec_id bigint, x array<double>").repartition(3)
    assert ranked(nearest_rows(df, df, "vec_id", "x", 9)) == brute(rows, rows, 9)
