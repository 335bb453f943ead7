"""Literal cases of the domain's functions, and properties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from partita import vocab as V
from partita.functions import arrays as A
from partita.functions import paths as P
from partita.functions import tabs as T
from partita.operators import evaluate as E
from partita.operators import intervals as I
from partita.operators import kernels as K
from partita.operators import models as M
from partita.operators import sampling as R
from partita.operators import sequences as S
from partita.operators.decode import decode, segments, viterbi


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_subtract_and_add_mod(spark):
    sub = [(0, 0, 0), (0, 10, 10), (10, 0, 2), (10, 9, 11), (25, 24, 35), (25, None, None), (None, 24, None), (3, 0, 9), (3, 10, 7), (15, 12, 21)]
    got = spark.createDataFrame(sub, "r int, i int, want int").select(V.subtract_mod(F.col("r"), F.col("i")), "want")
    assert all(a == b for a, b in rows(got))
    add = [(0, 0, 0), (0, 10, 10), (10, 0, 10), (10, 9, 7), (25, 11, 24), (25, None, None), (None, 24, None), (3, 10, 1), (15, 12, 15)]
    got = spark.createDataFrame(add, "r int, i int, want int").select(V.add_mod(F.col("r"), F.col("i")), "want")
    assert all(a == b for a, b in rows(got))


def test_add_undoes_subtract(spark):
    df = spark.range(157 * 12).select((F.col("id") % 12).cast("int").alias("r"), F.floor(F.col("id") / 12).cast("int").alias("i"))
    back = V.add_mod(V.subtract_mod(F.col("r"), F.col("i")), F.col("r"))
    assert df.where(back != F.col("i")).count() == 0


def test_relative_labels(spark):
    cases = [("C:maj", "C:maj", "C:maj", "C:maj"), ("Db:maj", "C#:maj", "C:maj", "C:maj"), ("C:maj", "G:min", "C:maj", "G:min"), ("F:maj", "C:maj", "C:maj", "G:maj"), ("B:maj", "G#:min", "C:maj", "A:min"), ("B:maj", "Ab:min", "C:maj", "A:min"), ("C:maj", "G#:min", "C:maj", "Ab:min"), ("N", "N", "N", "N"), ("X", "C:maj/3", "X", "C:maj/3")]
    df = spark.createDataFrame(cases, "r string, e string, wr string, we string")
    a, b = V.relative_labels(F.col("r"), F.col("e"))
    assert all(r[:2] == r[2:] for r in rows(df.select(a, b, "wr", "we")))


def test_tiles(spark):
    df = spark.createDataFrame([("t", i, [float(i)]) for i in range(10)], "track string, frame int, bins array<double>")
    want = {(0, 4): [0, 0, 0, 1], (0, 5): [0, 0, 0, 1, 2], (4, 4): [2, 3, 4, 5], (9, 4): [7, 8, 9, 0], (9, 5): [7, 8, 9, 0, 0]}
    for (at, n), tile in want.items():
        got = S.tiles(df, "track", ["frame"], "bins", n).where(F.col("frame") == at).first().tile
        assert [x[0] for x in got] == tile


def test_compress(spark):
    df = spark.createDataFrame([("t", 0, 1, "a"), ("t", 1, 2, "a"), ("t", 2, 4, "b")], "k string, s int, e int, label string")
    assert sorted(rows(S.compress_intervals(df, "k", ["s"], "label", "s", "e"))) == [("t", "a", 0, 2), ("t", "b", 2, 4)]


def test_runs_edges(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(["x", "x", None, None, "y"])] + [("b", 0, "z")], "k string, i int, v string")
    runs = S.run_length(df, "k", ["i"], "v")
    assert sorted(rows(runs), key=repr) == sorted([("a", "x", 0, 2), ("a", None, 2, 2), ("a", "y", 4, 1), ("b", "z", 0, 1)], key=repr)
    assert sorted(rows(S.run_decode(runs).select("k", "idx", "v")), key=repr) == sorted(rows(df), key=repr)
    ends = rows(S.runs_to_intervals(df.withColumn("t", F.col("i") * 10), "k", ["i"], "v", "t"))
    assert ("a", "y", 40, 40) in ends and ("b", "z", 0, 0) in ends
    assert S.run_length(df.limit(0), "k", ["i"], "v").count() == 0


def test_viterbi_literal():
    p = np.eye(3)[[0, 0, 1, 1, 2]].copy()
    p[3, :2] = (0.8, 0.2)
    assert viterbi(p, -10).tolist() == [0, 0, 1, 1, 2]
    assert p.argmax(axis=1).tolist() == [0, 0, 1, 0, 2]


def test_viterbi_short_step_equals_dense():
    rng = np.random.default_rng(0)
    for _ in range(200):
        p = rng.integers(0, 4, (rng.integers(1, 9), 4)).astype(float)
        for c in (0.0, np.log(0.5), np.log(0.25)):
            assert viterbi(p, c).tolist() == viterbi(p, c, transitions=np.ones((4, 4))).tolist()
    # rows of the matrix are the next state: from state 0 one can only stay, from 1 only leave
    t = np.array([[1.0, 1.0], [0.0, 0.0]])
    assert viterbi(np.array([[0.4, 0.6], [0.5, 0.5]]), 0.0, t).tolist() == [1, 0]
    assert viterbi(np.array([[0.4, 0.6], [0.5, 0.5]]), 0.0, t.T).tolist() == [0, 0]
    assert viterbi(np.zeros((3, 2)), -1).tolist() == [0, 0, 0]
    assert viterbi(np.zeros((0, 2)), -1).tolist() == []


def test_last_segment_of_one_frame_has_no_confidence(spark):
    df = spark.createDataFrame([("t", i, [1.0, 0.0] if i < 3 else [0.0, 1.0]) for i in range(4)], "k string, frame int, p array<double>")
    path = decode(df, ["k"], "frame", "p", F.lit(-0.1)).join(df, ["k", "frame"])
    p = F.element_at("p", F.col("state") + 1)
    got = rows(segments(path, ["k"], "frame", F.col("frame"), F.when(p > 0, F.ln(p))).select("segment", "state", "start", "end", "confidence").orderBy("segment"))
    assert got == [(0, 0, 0, 3, 0.0), (1, 1, 3, 3, None)]


def test_kfold_sizes(spark):
    k = R.kfold(spark.range(100).withColumnRenamed("id", "key"), "key", 5, 0.25, 1).groupBy("fold", "split").count()
    assert {(r.fold, r.split): r["count"] for r in k.collect()} == {(f, s): n for f in range(5) for s, n in (("train", 60), ("valid", 20), ("test", 20))}


def test_alignment_covers_the_reference(spark):
    ref = spark.createDataFrame([("t", 10, 20, "a"), ("t", 20, 50, "b"), ("u", 0, 5, "a"), ("t", 30, 30, "z")], "k string, s bigint, e bigint, label string")
    est = spark.createDataFrame([("t", 0, 15, "x"), ("t", 15, 40, "y"), ("v", 0, 9, "x")], "k string, s bigint, e bigint, label string")
    for width in (3, 7, 1000):
        got = rows(I.align_filled(ref, est, "k", width))
        assert sum(e - s for k, s, e, *_ in got if k == "t") == 40
        assert ("u", 0, 5, "a", "N") in got
        assert ("t", 40, 50, "b", "N") in got and len(got) == len(set(got))


def test_asof_boundaries(spark):
    ivs = spark.createDataFrame([("t", 0, 10, "a"), ("t", 10, 20, "b"), ("t", 30, 40, "c")], "k string, s bigint, e bigint, label string")
    pts = spark.createDataFrame([("t", x) for x in (-1, 0, 9, 10, 19, 20, 25, 30, 40)] + [("none", 5)], "k string, t bigint")
    for width in (4, 1000):
        got = {(k, t): v for k, t, v in rows(I.asof_label(pts, ivs, "k", "t", width))}
        assert [got["t", x] for x in (-1, 0, 9, 10, 19, 20, 25, 30, 40)] == ["N", "a", "a", "b", "b", "N", "N", "c", "N"]
        assert got["none", 5] == "N"


def test_boundary_pool(spark):
    df = spark.createDataFrame([("t", i, float(i)) for i in range(6)], "k string, i int, v double")
    edges = spark.createDataFrame([("t", 0, 0, 3), ("t", 1, 3, 3), ("t", 2, 3, 6)], "k string, segment int, lo int, hi int")
    got = {r.segment: (r.mean, r.median, r.max) for r in I.boundary_pool(df, edges, "k", "i", "v").collect()}
    assert got == {0: (1.0, 1.0, 2.0), 1: (3.0, 3.0, 3.0), 2: (4.0, 4.0, 5.0)}
    with pytest.raises(Exception, match="edges decrease"):
        I.boundary_pool(df, edges.withColumn("hi", F.lit(-1)), "k", "i", "v").count()


def test_scores_without_support(spark):
    df = spark.createDataFrame([("a", 10, 0, 0), ("b", 5, None, 3), ("c", 4, 156, 156), ("c", 4, 24, None)], "k string, w int, ref int, est int")
    t = E.track_scores(E.with_scores(df, ["majmin", "v157_strict"]), "k", "w")
    got = {(r.k, r.metric): (r.score, r.support) for r in t.collect()}
    assert got["a", "majmin"] == (1.0, 10) and got["b", "majmin"] == (0.0, 0) and got["c", "v157_strict"] == (0.5, 8)
    m = {r.metric: (r.macro, r.micro) for r in E.tally(t).collect()}
    assert m["v157_strict"] == (0.5, 14 / 18)


def test_transposition_invariance(spark):
    from partita.vocab import relative_class

    df = spark.createDataFrame([(12 * q + r, (12 * q + r + 7) % 156, k) for q in range(13) for r in range(12) for k in (5,)], "ref int, est int, k int")
    moved = df.select(V.add_mod(F.col("ref"), F.col("k")).alias("ref"), V.add_mod(F.col("est"), F.col("k")).alias("est"))
    rel = lambda d: sorted(rows(d.select(relative_class(F.col("ref"), F.col("est")))))
    assert rel(df) == rel(moved)


def test_geometric_mean_zero_and_tie(spark):
    df = spark.createDataFrame([("b", 0.5), ("b", 0.5), ("a", 0.5), ("a", 0.5), ("z", 0.0), ("z", 1.0)], "name string, v double")
    assert E.best_by_geometric_mean(df, "name", "v").first().name == "a"
    assert E.best_by_geometric_mean(df.where("name = 'z'"), "name", "v").first().geomean == 0.0


def test_tabs(spark):
    df = spark.createDataFrame([("X,3,2,0,1,0",)], "t string").withColumn("f", T.decode_tab(F.col("t")))
    r = df.select(T.encode_tab(F.col("f")).alias("t"), T.fret_bitmap(F.col("f"), 9).alias("m"), T.shift_frets(F.col("f"), F.lit(1), 9).alias("s"), "f").first()
    assert r.t == "X,3,2,0,1,0" and r.s == r.f and [row.index(1) for row in r.m] == [8, 3, 2, 0, 1, 0]


def test_interval_chord(spark):
    cases = [([60, 64, 67], "C:maj"), ([64, 67, 72], "C:maj"), ([45, 52, 57, 60, 64], "A:min"), ([60, 61, 62], "C:(1,2)"), ([], "N"), (None, None), ([55], "G:()")]
    df = spark.createDataFrame(cases, "n array<int>, want string")
    assert all(a == b for a, b in rows(df.select(T.interval_chord(F.col("n")), "want")))


def test_paths(spark):
    df = spark.createDataFrame([("/a/b/c.tar.gz",), ("/a/.hidden",), ("plain",), (None,)], "p string")
    c = F.col("p")
    assert rows(df.select(P.file_dir(c), P.file_base(c), P.file_ext(c))) == [("/a/b", "c.tar", ".gz"), ("/a", ".hidden", ""), ("", "plain", ""), (None, None, None)]


def test_arrays(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [0.0, 0.0])], "a array<double>, z array<double>")
    a, z = F.col("a"), F.col("z")
    r = df.select(A.normalize(z).alias("n"), A.lp_scale(z).alias("l"), A.shift(a, 5).alias("s"), A.circshift(a, -1).alias("c"), A.one_hot(F.lit(None).cast("int"), 2).alias("o"), A.transpose(F.array(a, a)).alias("t"), A.cosine_distance(z, z).alias("d")).first()
    assert r.n == [0.0, 0.0] and r.l == [0.0, 0.0] and r.s == [0.0] * 3 and r.c == [2.0, 3.0, 1.0] and r.o == [0, 0] and r.t == [[1.0, 1.0], [2.0, 2.0], [3.0, 3.0]] and r.d is None


def test_kernels():
    x = np.random.default_rng(0).random((50, 252))
    k = K.lowpass_kernel(5, 5)
    pad = np.pad(x, 2, mode="symmetric")
    direct = sum(k[4 - i, 4 - j] * pad[i : i + 50, j : j + 252] for i in range(5) for j in range(5))
    assert np.allclose(K.convolve_same(x, k), direct)
    for f in (K.lcn, K.lcn_rowwise, K.local_l2, K.lcn_octaves):
        assert f(x, k).shape == x.shape and np.isfinite(f(x, k)).all()
    assert np.allclose(K.lcn_mauch(x), np.maximum(K.highpass(x, np.outer(np.hamming(31)[:15], np.hamming(37)) / np.outer(np.hamming(31)[:15], np.hamming(37)).sum()), 0))
    assert not K.lcn(np.zeros((4, 4)), k).any()
    with pytest.raises(ValueError):
        K.lcn_octaves(x[:, :10], k)


def test_constant_q_finds_the_tone():
    t = np.arange(5 * 8000) / 8000
    times, bins = K.constant_q(np.sin(2 * np.pi * 440 * t), 8000, octaves=6)
    mid = bins[len(bins) // 2]
    assert abs(int(mid.argmax()) - round(36 * np.log2(440 / 27.5))) <= 1
    assert len(times) == len(bins) == 100
    with pytest.raises(ValueError):
        K.constant_q(np.zeros(100), 1000)


def test_networks_give_distributions(spark):
    for name, build in M.MODELS.items():
        if name in ("chords_L", "chords_XL", "chords_XXL"):
            continue
        y = M.forward(build(frames=8, bins=96), np.random.default_rng(1).random((3, 1, 8, 96)))
        assert len(y) == 3 and np.isfinite(y).all()
        if name.startswith("chords"):
            assert y.shape == (3, 157) and np.allclose(y.sum(axis=1), 1)
    df = spark.createDataFrame([(i, float(i)) for i in range(10)], "i int, v double").select("i", F.array("v").alias("x"), F.lit("kept").alias("y"))
    got = M.apply_network(df, "x", (1,), [], "out").orderBy("i").collect()
    assert [r.out[0] for r in got] == list(range(10)) and got[0].y == "kept"


def test_lda_separates(spark):
    rng = np.random.default_rng(2)
    data = [(i, [float(abs(v)) for v in rng.normal(size=6) + 4 * (np.arange(6) == i % 3)], i % 3) for i in range(300)]
    df = spark.createDataFrame(data, "i int, x array<double>, y int")
    z = np.stack([r.z for r in M.apply_network(df, "x", (6,), M.fit_pca_lda(df, "x", "y", 5, 2), "z").orderBy("i").collect()])
    y = np.arange(300) % 3
    centres = np.stack([z[y == c].mean(axis=0) for c in range(3)])
    assert (((z[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1) == y).mean() > 0.9
