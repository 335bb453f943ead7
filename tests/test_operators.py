"""Operators against plain definitions."""

import numpy as np
import pytest

from partita.operators import kernels as K
from partita.operators import sampling as P
from partita.operators.intervals import nearest_value
from partita.operators.vectors import near_mean


def plain_convolution(x, k):
    a, b = k.shape
    top, left = a - 1 - (a - 1) // 2, b - 1 - (b - 1) // 2

    def mirror(i, n):
        i %= 2 * n
        return i if i < n else 2 * n - 1 - i

    out = np.zeros(x.shape)
    for i in range(x.shape[0]):
        for j in range(x.shape[1]):
            out[i, j] = sum(k[a - 1 - p, b - 1 - q] * x[mirror(i + p - top, x.shape[0]), mirror(j + q - left, x.shape[1])] for p in range(a) for q in range(b))
    return out


@pytest.mark.parametrize("kernel", [K.lowpass_kernel(3, 5), np.random.default_rng(1).random((4, 3)), np.hanning(7)[None, :], np.zeros((2, 2))])
def test_convolution(kernel):
    x = np.random.default_rng(2).random((9, 11))
    assert np.allclose(K.convolve_same(x, kernel), plain_convolution(x, kernel))


def test_near_mean_guards_against_few_rows(spark):
    rows = [(i, 20, [1.0, 0.01 * i]) for i in range(6)] + [(9, 20, [-1.0, 0.0]), (10, 90, [1.0, 0.0]), (11, None, [1.0, 0.0]), (12, 21, None)]
    df = spark.createDataFrame(rows, "i int, note int, x array<double>")
    assert sorted(r.i for r in near_mean(df, "note", "x", 0.5, 16, 84, 6).collect()) == [0, 1, 2, 3, 4, 5]
    with pytest.raises(Exception, match="too few rows of 20"):
        near_mean(df, "note", "x", 0.5, 16, 84, 7).collect()


def test_nearest_of_frequent_values(spark):
    pool = spark.createDataFrame([(i, float(v)) for i, v in enumerate([5] * 50 + [1, 9, 9, 3])], "p bigint, v double")
    ask = spark.createDataFrame([(i, q) for i, q in enumerate([5.0] * 30 + [0.0, 4.0, 2.0, 100.0, None, 7.0])], "q bigint, w double")
    got = {r.q: r.nearest for r in nearest_value(ask, pool, "q", "w", "p", "v").collect()}
    assert got == {**{i: 0 for i in range(30)}, 30: 50, 31: 53, 32: 50, 33: 51, 35: 0}
    assert nearest_value(ask, pool.limit(0), "q", "w", "p", "v").where("nearest is not null").count() == 0


def test_class_streams_of_many_classes(spark):
    rows = [(i, i % 997 if i < 2000 else 5) for i in range(3000)] + [(5000, None)]
    df = spark.createDataFrame(rows, "i bigint, c int")
    s = sorted(P.uniform_classes(df, "i", "c", 1).collect())
    assert [r.position for r in s] == list(range(3000))
    # every class once before any comes twice
    assert [r.c for r in s[:997]] == list(range(997)) and len({r.c for r in s[997:1994]}) == 997
    t = P.contrastive_pairs(df, "i", "c", 1).collect()
    c = dict(rows)
    assert all((c[r.i] == c[r.other]) == (r.target == 1) for r in t) and len(t) == 6000
    three = P.scored_triples(df, "i", "c", 1).collect()
    assert all((c[r.i] == c[r.other]) == (r.target == 1) for r in three)


def test_working_set(spark):
    df = spark.createDataFrame([(100 * k + i, k) for k in range(7) for i in range(30 if k else 95)], "i bigint, k int")
    s = sorted(P.working_set_stream(df, "i", "k", 3, 10, 2).collect())
    assert len(s) == 275 and len({r.i for r in s}) == 275
    assert {r.slot for r in s[:3]} == {0, 1, 2} and len({r.k for r in s[:30]}) == 3
    assert P.working_set_stream(df.limit(0), "i", "k", 3, 10, 2).count() == 0
