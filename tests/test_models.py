"""Networks, their losses, stores and sweeps against plain NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from partita.operators import importing as I
from partita.operators import kernels as K
from partita.operators import models as M
from partita.vocab import QUALITIES


@pytest.mark.parametrize("name", sorted(M.MODELS))
def test_outputs(name):
    layers = M.MODELS[name](frames=8, bins=252)
    y = M.forward(layers, np.abs(np.random.default_rng(1).normal(size=(3, 1, 8, 252)))).reshape(3, -1)
    size = {"chroma": 12, "embedding": 3, "frets": 54, "frets_sigmoid": 54}.get(name, 157)
    assert y.shape == (3, size) and np.isfinite(y).all()
    if size == 157 and "sigmoid" not in name and "margin" not in name:
        assert np.allclose(y.sum(axis=1), 1)


def test_classifier_is_convolutional():
    """From 252 bins the third convolution ends at the twelve roots, so a shift by three bins moves the roots by one."""
    layers = M.MODELS["chords_S"](frames=8, bins=252)
    assert [p["w"].shape[3] for n, p in layers if n == "conv"] == [13, 37, 33]
    x = np.zeros((1, 1, 8, 252))
    x[..., 60:150] = np.random.default_rng(2).normal(size=(1, 1, 8, 90))
    upto = [i for i, (n, _) in enumerate(layers) if n == "concatenate"][0]
    a, b = M.forward(layers[:upto], x), M.forward(layers[:upto], np.roll(x, 3, axis=3))
    assert a.shape[3] == 12 and np.allclose(a[..., :-1], b[..., 1:])


def test_fixed_templates():
    head = dict(M.template_network(8, 252))["concatenate"]["branches"][0]
    assert (dict(head)["map_1x1"]["w"] == [[int(c) for c in b[2:]] for b in QUALITIES.values()]).all()


def test_losses(spark):
    rng = np.random.default_rng(3)
    y, t = rng.random((5, 6)), rng.random((5, 6))
    rows = [(i, y[i].tolist(), t[i].tolist(), i % 6, float(i % 2), 2.0) for i in range(5)]
    df = spark.createDataFrame(rows, "i int, y array<double>, t array<double>, c int, s double, w double")
    y_, c, s = F.col("y"), F.col("c"), F.col("s")
    got = df.select(M.negative_log_likelihood(y_, c), M.squared_error(y_, F.col("t")), M.selected_error(y_, c, s), M.margin_loss(y_, c, s), M.template_loss(y_, c, F.col("w"))).collect()
    for i, r in enumerate(got):
        p = y[i][i % 6]
        want = (-np.log(p), ((y[i] - t[i]) ** 2).mean(), (p - i % 2) ** 2, (p - i % 2) ** 2 + (i % 2) * np.maximum(y[i] - p, 0).sum(), 2 * p)
        assert np.allclose(tuple(r), want)


def test_network_on_rows(spark):
    layers = M.MODELS["chords_early_none"](frames=8, bins=64)
    x = np.random.default_rng(4).normal(size=(7, 8 * 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, x array<double>")
    got = {r.i: r.y for r in M.apply_network(df, "x", (1, 8, 64), layers, "y").collect()}
    want = M.forward(layers, x.reshape(7, 1, 8, 64))
    assert all(np.allclose(got[i], want[i]) for i in range(7))


def test_store_and_checkpoints(spark, tmp_path):
    nets = {f"{tmp_path}/c{i}.npz": M.MODELS[n](frames=2, bins=40) for i, n in enumerate(("chords_early_none", "chords_dense", "frets_rbf"))}
    for p, layers in nets.items():
        I.save_layers(layers, p)
    x = np.random.default_rng(5).normal(size=(4, 80))
    df = spark.createDataFrame([(f"k{i}", v.tolist()) for i, v in enumerate(x)], "key string, x array<double>")
    got = {(r.checkpoint, r.key): r.posterior for r in I.sweep_checkpoints(df, list(nets), "x", (1, 2, 40), 0, 2).collect()}
    assert {c for c, _ in got} == {f"{tmp_path}/c0.npz", f"{tmp_path}/c2.npz"}
    for (c, k), y in got.items():
        assert np.allclose(y, M.forward(nets[c], x[int(k[1:])].reshape(1, 1, 2, 40)).ravel())
    df.write.parquet(f"{tmp_path}/in")
    I.transform_store(spark, f"{tmp_path}/in", f"{tmp_path}/out", "x", (1, 2, 40), nets[f"{tmp_path}/c1.npz"])
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.columns == ["key", "posterior"] and out.count() == 4
    assert I.sweep_checkpoints(df, [], "x", (1, 2, 40)).count() == 0


def test_predict_sweep(spark):
    from partita.operators.decode import viterbi

    layers = M.MODELS["chords_dense"](frames=1, bins=12)
    x = np.random.default_rng(6).normal(size=(30, 12)) * 3
    df = spark.createDataFrame([("k", i, v.tolist()) for i, v in enumerate(x)], "key string, frame int, x array<double>")
    got = I.predict_sweep(df, ["key"], "frame", F.col("frame") / 10.0, "x", (1, 1, 12), layers, [-1.0, -6.0]).collect()
    p = M.forward(layers, x.reshape(30, 1, 1, 12))
    for penalty in (-1.0, -6.0):
        path = viterbi(p, penalty)
        starts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist()]
        assert [(r.state, round(r.start, 6)) for r in sorted(got, key=lambda r: r.segment) if r.penalty == penalty] == [(int(path[i]), i / 10) for i in starts]


def test_channels(spark):
    kernel = K.lowpass_kernel(3, 5)
    x = np.abs(np.random.default_rng(7).normal(size=(2, 9, 20)))
    rows = [("k", t, x[:, t].tolist(), "kept") for t in range(9)]
    df = spark.createDataFrame(rows, "key string, frame int, x array<array<double>>, note string")
    got = {r.frame: (r.x, r.note) for r in K.apply_channels(df, "key", "frame", "x", lambda m: K.lcn(m, kernel)).collect()}
    want = [K.lcn(x[c], kernel) for c in (0, 1)]
    assert all(np.allclose(got[t][0], [w[t] for w in want]) and got[t][1] == "kept" for t in range(9))
    with pytest.raises(ValueError):
        K.apply_channels(df.withColumn("x", F.array("x")), "key", "frame", "x", lambda m: m)


def test_octave_bands_sum_to_one():
    edges = [None, *K.HANDOVERS, None]
    masks = [K.band_mask(K.WIDE_BINS, lo, hi, K.HANDOVER_BINS) for lo, hi in zip(edges, edges[1:])]
    assert np.allclose(sum(m**2 for m in masks), 1)
    assert np.allclose(masks[0][:18], 1) and np.allclose(masks[0][36:], 0) and np.allclose(masks[1][36:72], 1) and np.allclose(masks[2][90:], 1)


def test_octave_normalisation_by_definition():
    """Each bin by the windows whose bands hold it, summed plainly."""
    kernel = K.lowpass_kernel(3, 5)
    x = np.abs(np.random.default_rng(8).normal(size=(4, 252)))
    hp = x - K.convolve_same(x, kernel)
    slope = np.sin(np.pi * np.arange(18) / 36)
    weight = {73: np.zeros(252), 37: np.zeros(252), 19: np.zeros(252)}
    for i in range(252):
        for width, (lo, hi) in {73: (None, 18), 37: (18, 72), 19: (72, None)}.items():
            up = 1.0 if lo is None or i >= lo + 18 else 0.0 if i < lo else slope[i - lo] ** 2
            down = 1.0 if hi is None or i < hi else 0.0 if i >= hi + 18 else 1 - slope[i - hi] ** 2
            weight[width][i] = up * down
    want = sum(w * K.local_l2(hp, np.hanning(n)[None, :]) for n, w in weight.items())
    assert np.allclose(K.lcn_octaves(x, kernel), want)
