"""Forward passes of layered networks, PCA and LDA, nearest-neighbour classification."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partita.operators.vectors import matrix, nearest_rows
from partita.vocab import QUALITIES

Layer = tuple[str, dict]


def conv2d(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Valid correlation of (n, c, h, w) with (k, c, i, j)."""
    view = np.lib.stride_tricks.sliding_window_view(x, w.shape[2:], axis=(2, 3))
    return np.einsum("nchwij,kcij->nkhw", view, w, optimize=True) + b[None, :, None, None]


def max_pool(x: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    n, c, h, w = x.shape
    i, j = shape
    return x[:, :, : h // i * i, : w // j * j].reshape(n, c, h // i, i, w // j, j).max(axis=(3, 5))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def radial_basis(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distance of each row to each centre."""
    return ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)


#: Layer functions: name -> f(x, parameters). A new layer is one entry.
OPS: dict[str, Callable[[np.ndarray, dict], np.ndarray]] = {
    "conv": lambda x, p: conv2d(x, p["w"], p["b"]),
    "pool": lambda x, p: max_pool(x, p["shape"]),
    "relu": lambda x, p: np.maximum(x, 0),
    "tanh": lambda x, p: np.tanh(x),
    "sigmoid": lambda x, p: 1 / (1 + np.exp(-x)),
    "dense": lambda x, p: x.reshape(len(x), -1) @ p["w"] + p["b"],
    "flatten": lambda x, p: x.reshape(len(x), -1),
    "reshape": lambda x, p: x.reshape(len(x), *p["shape"]),
    "log": lambda x, p: np.log1p(p.get("scale", 1.0) * x),
    "power": lambda x, p: x ** p["exponent"],
    "softmax": lambda x, p: softmax(x),
    "multisoftmax": lambda x, p: softmax(x.reshape(len(x), p["heads"], -1)),
    "rbf": lambda x, p: radial_basis(x.reshape(len(x), -1), p["centres"]),
    "negate": lambda x, p: -x,
    "scale": lambda x, p: x * p["by"],
    "transpose": lambda x, p: x.transpose(0, *p["axes"]),
    "multiply": lambda x, p: x * p["by"],
    "add": lambda x, p: x + p["by"],
    "sqrt": lambda x, p: np.sqrt(x),
    "mean": lambda x, p: x.mean(axis=p["axis"]),
    "product": lambda x, p: x.prod(axis=p["axis"]),
    "concatenate": lambda x, p: np.concatenate([forward(b, x).reshape(len(x), -1) for b in p["branches"]], axis=1),
    "stack": lambda x, p: np.stack([forward(b, x) for b in p["branches"]], axis=1),
    # one 1x1 map over (maps, time, 12 roots) for each output map, mean over time
    "map_1x1": lambda x, p: np.einsum("ncrb,qc->nqrb", x, p["w"]).mean(axis=2) + p["b"],
}


def forward(layers: list[Layer], x: np.ndarray) -> np.ndarray:
    for name, p in layers:
        x = OPS[name](x, p)
    return x


def _weights(rng: np.random.Generator, *shape: int) -> np.ndarray:
    return rng.standard_normal(shape) / np.sqrt(max(1, np.prod(shape[1:])))


# Number of maps of the three convolutions by size, and the output size of the fret networks.
SIZES = {"S": (4, 6, 8), "L": (20, 40, 80), "XL": (24, 48, 96), "XXL": (32, 64, 128)}
FRETS = 9


def _convolutions(rng: np.random.Generator, maps: tuple[int, ...], frames: int, bins: int, heights: tuple[int, ...] = (3, 3, 3), roots: int | None = 12, channels: int = 1) -> tuple[list[list[Layer]], tuple[int, int, int]]:
    """(blocks, (maps, frames, bins) at the end): three convolutions of 13, 37 and 33 bins, pooling by 3 after the first.

    From 252 bins they end at the twelve roots; from fewer, kernels are narrowed so that they end there too.
    """
    blocks: list[list[Layer]] = []
    c, t, width = channels, frames, bins
    for k, w, h in zip(maps, (13, 37, 33), heights, strict=True):
        w, h = min(w, width - roots + 1 if roots else width), min(h, t)
        block: list[Layer] = [("conv", {"w": _weights(rng, k, c, h, w), "b": np.zeros(k)}), ("relu", {})]
        c, t, width = k, t - h + 1, width - w + 1
        if not blocks and width >= 3 * (roots or 1):
            block.append(("pool", {"shape": (1, 3)}))
            width //= 3
        blocks.append(block)
    if roots and width != roots:
        c_w = width - roots + 1
        blocks.append([("conv", {"w": _weights(rng, c, c, 1, c_w), "b": np.zeros(c)}), ("relu", {})])
        width = roots
    return blocks, (c, t, width)


def _chord_head(rng: np.random.Generator, main: list[Layer], maps: int, main_size: int, w: np.ndarray | None = None, side: list[Layer] | None = None, side_size: int = 0) -> list[Layer]:
    """Thirteen 1x1 maps over the twelve roots after ``main``, and one unit for no chord that reads ``main``'s output, or that of ``side``."""
    roots = [*main, ("map_1x1", {"w": _weights(rng, 13, maps) if w is None else w, "b": 0.0}), ("flatten", {})]
    size = side_size or main_size
    none = [*(main if side is None else side), ("dense", {"w": _weights(rng, size, 1), "b": np.zeros(1)})]
    return [("concatenate", {"branches": [roots, none]}), ("softmax", {})]


def chord_network(size: str = "S", frames: int = 20, bins: int = 252, seed: int = 0, head: str = "chords", prior: np.ndarray | None = None, early: bool = False, heights: tuple[int, ...] = (3, 3, 3)) -> list[Layer]:
    """Three convolutions over (1, frames, bins), then a head.

    head: ``chords`` (13 qualities x 12 roots by 1x1 maps and a unit for no chord; ``early``: that unit reads the first
    layer), ``dense`` (one 157-way softmax), ``chroma`` (one 1x1 sigmoid map over the roots), ``frets`` (six softmaxes),
    ``rbf`` (softmax of minus the distance to the 157 fret templates). ``prior`` weights the classes after the softmax.
    """
    rng = np.random.default_rng(seed)
    blocks, (maps, t, width) = _convolutions(rng, SIZES[size], frames, bins, heights)
    first, later = blocks[0], [x for b in blocks[1:] for x in b]
    total = maps * t * width
    if head == "chords":
        if early:
            # what the first block leaves: its maps, frames and bins
            c, h, w = first[0][1]["w"].shape[0], frames - first[0][1]["w"].shape[2] + 1, bins - first[0][1]["w"].shape[3] + 1
            w = w // 3 if len(first) == 3 else w
            out = [*first, *_chord_head(rng, later, maps, total, side=[("flatten", {})], side_size=c * h * w)]
        else:
            out = [*first, *later, *_chord_head(rng, [], maps, total)]
    elif head == "dense":
        out = [*first, *later, ("dense", {"w": _weights(rng, total, 157), "b": np.zeros(157)}), ("softmax", {})]
    elif head == "chroma":
        out = [*first, *later, ("map_1x1", {"w": _weights(rng, 1, maps), "b": 0.0}), ("flatten", {}), ("sigmoid", {})]
    elif head in ("frets", "rbf"):
        out = [*first, *later, ("dense", {"w": _weights(rng, total, 6 * FRETS), "b": np.zeros(6 * FRETS)}), ("multisoftmax", {"heads": 6})]
        if head == "rbf":
            out += [("rbf", {"centres": rng.random((157, 6 * FRETS))}), ("negate", {}), ("softmax", {})]
    else:
        raise ValueError(head)
    return [*out, ("multiply", {"by": prior})] if prior is not None else out


def template_network(frames: int = 8, bins: int = 252, seed: int = 0) -> list[Layer]:
    """Three convolutions to ten maps of the twelve roots, read by a fixed head: the semitones 2 to 11 of the thirteen qualities."""
    rng = np.random.default_rng(seed)
    blocks, (maps, t, _) = _convolutions(rng, SIZES["S"], frames, bins)
    fixed = np.array([[float(c) for c in b[2:]] for b in QUALITIES.values()])
    h = min(2, t)
    ten: list[Layer] = [("conv", {"w": _weights(rng, 10, maps, h, 1), "b": np.zeros(10)}), ("relu", {})]
    return [*[x for b in blocks for x in b], *ten, *_chord_head(rng, [], 10, 10 * (t - h + 1) * 12, fixed)]


def dense_network(frames: int = 8, bins: int = 252, hidden: int = 64, outputs: int = 157, seed: int = 0, final: str = "softmax") -> list[Layer]:
    """Two hidden layers and an output layer."""
    rng = np.random.default_rng(seed)
    sizes = [frames * bins, hidden, hidden, outputs]
    out: list[Layer] = [("flatten", {})]
    for a, b in zip(sizes, sizes[1:], strict=False):
        out += [("dense", {"w": _weights(rng, a, b), "b": np.zeros(b)}), ("relu", {})]
    return [*out[:-1], (final, {})]


def dense_chord_network(frames: int = 8, bins: int = 252, hidden: int = 64, maps: int = 8, seed: int = 0) -> list[Layer]:
    """Three dense layers, the last as ``maps`` of twelve roots under a 13-map head; the unit for no chord reads the first layer."""
    rng = np.random.default_rng(seed)
    dense = lambda a, b: [("dense", {"w": _weights(rng, a, b), "b": np.zeros(b)}), ("relu", {})]
    later = [*dense(hidden, hidden), *dense(hidden, maps * 12), ("reshape", {"shape": (maps, 1, 12)})]
    return [("flatten", {}), *dense(frames * bins, hidden), *_chord_head(rng, later, maps, maps * 12, side=[("flatten", {})], side_size=hidden)]


def margin_network(frames: int = 20, bins: int = 40, channels: int = 6, hidden: int = 1024, seed: int = 0) -> list[Layer]:
    """(channels, frames, bins) through one hidden layer to a sigmoid per class; its loss is margin_loss()."""
    rng = np.random.default_rng(seed)
    n = channels * frames * bins
    return [("flatten", {}), ("dense", {"w": _weights(rng, n, hidden), "b": np.zeros(hidden)}), ("relu", {}), ("dense", {"w": _weights(rng, hidden, 157), "b": np.zeros(157)}), ("sigmoid", {})]


def embedding_network(frames: int = 20, bins: int = 192, dims: int = 3, seed: int = 0) -> list[Layer]:
    """Log scaling, three convolutions, a hidden layer, a few linear outputs; twins share it."""
    rng = np.random.default_rng(seed)
    blocks, (maps, t, width) = _convolutions(rng, SIZES["S"], frames, bins, roots=None)
    n = maps * t * width
    return [("log", {"scale": 1.0}), *[x for b in blocks for x in b], ("dense", {"w": _weights(rng, n, 64), "b": np.zeros(64)}), ("tanh", {}), ("dense", {"w": _weights(rng, 64, dims), "b": np.zeros(dims)})]


# losses, as columns of a row's output array


def negative_log_likelihood(posterior: Column, idx: Column) -> Column:
    """Minus the logarithm of the true class's output; null without a class."""
    return -F.ln(F.get(posterior, idx))


def squared_error(output: Column, target: Column) -> Column:
    """Mean squared difference of two arrays of one length."""
    parts = F.zip_with(output, target, lambda a, b: (a - b) * (a - b))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / F.size(output)


def selected_error(output: Column, idx: Column, target: Column) -> Column:
    """Squared difference of the chosen class's output and a number."""
    d = F.get(output, idx) - target
    return d * d


def margin_loss(output: Column, idx: Column, target: Column) -> Column:
    """selected_error() plus, for targets of 1, by how much other classes' outputs exceed the chosen one's."""
    chosen = F.get(output, idx)
    over = F.aggregate(F.transform(output, lambda x: F.greatest(x - chosen, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    return selected_error(output, idx, target) + target * over


def template_loss(distances: Column, idx: Column, weight: Column | None = None) -> Column:
    """Distance to the true class's template, times the class's weight if given."""
    d = F.get(distances, idx)
    return d if weight is None else d * weight


#: Networks by name. Parameters are seeded; trained ones can be put in their place.
MODELS: dict[str, Callable[..., list[Layer]]] = {
    **{f"chords_{s}": (lambda s: lambda **k: chord_network(s, **k))(s) for s in SIZES},
    "chords_dense_head": lambda **k: chord_network(head="dense", **k),
    "chords_early_none": lambda **k: chord_network(early=True, **k),
    "chords_octaves": lambda **k: [("reshape", {"shape": (1, k["frames"], k["bins"])}), *chord_network(early=True, heights=(3, 3, 4), **k)],
    "chords_templates": template_network,
    "chords_dense": dense_network,
    "chords_dense_maps": dense_chord_network,
    "chroma": lambda **k: chord_network(head="chroma", **k),
    "classes_sigmoid": lambda **k: dense_network(final="sigmoid", **k),
    "classes_margin": lambda **k: margin_network(channels=1, hidden=64, **k),
    "frets": lambda **k: chord_network(head="frets", **k),
    "frets_rbf": lambda **k: chord_network(head="rbf", **k),
    "frets_sigmoid": lambda **k: dense_network(outputs=6 * FRETS, final="sigmoid", **k),
    "embedding": embedding_network,
}


def apply_network(df: DataFrame, array: str, shape: tuple[int, ...], layers: list[Layer], out: str = "output") -> DataFrame:
    """Adds the flattened output of a network for each row's flat array, batch by batch; other fields pass through, the input is dropped."""
    rest = [c for c in df.columns if c != array]
    schema = df.select(*rest).schema.add(out, T.ArrayType(T.DoubleType()))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            if len(pdf):
                x = np.stack(pdf[array].to_numpy()).astype(float).reshape(len(pdf), *shape)
                y = np.asarray(forward(layers, x)).reshape(len(pdf), -1)
                yield pdf[rest].assign(**{out: list(y)})

    return df.mapInPandas(run, schema)


def _moments(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        if b.num_rows:
            x, y = np.log1p(np.maximum(matrix(b.column("x")), 0)), np.asarray(b.column("y").to_pylist())
            for c in np.unique(y):
                z = x[y == c]
                yield pa.RecordBatch.from_arrays([pa.array([int(c)]), pa.array([len(z)]), pa.array([z.sum(axis=0).tolist()]), pa.array([(z.T @ z).ravel().tolist()])], names=["y", "n", "s", "ss"])


def fit_pca_lda(df: DataFrame, vector: str, label: str, components: int, outputs: int) -> list[Layer]:
    """Layers log -> whitened PCA -> LDA, from one sum of products per class and batch.

    The driver sees one matrix per class (dims squared), whatever the number of rows; classes are a small set.
    The whitening is part of the PCA weights.
    """
    rows = df.where(F.col(vector).isNotNull() & F.col(label).isNotNull()).select(F.col(vector).alias("x"), F.col(label).cast("bigint").alias("y"))
    parts = rows.mapInArrow(_moments, "y bigint, n bigint, s array<double>, ss array<double>")
    long = parts.select("y", F.lit("n").alias("k"), F.array(F.col("n").cast("double")).alias("v")).unionByName(parts.select("y", F.lit("s").alias("k"), F.col("s").alias("v"))).unionByName(parts.select("y", F.lit("ss").alias("k"), F.col("ss").alias("v")))
    sums = long.select("y", "k", F.posexplode("v").alias("i", "v")).groupBy("y", "k", "i").agg(F.sum("v").alias("v"))
    table: dict[int, dict[str, dict[int, float]]] = {}
    for r in sums.collect():
        table.setdefault(r.y, {}).setdefault(r.k, {})[r.i] = r.v
    n = {c: t["n"][0] for c, t in table.items()}
    s = {c: np.array([t["s"][i] for i in range(len(t["s"]))]) for c, t in table.items()}
    ss = {c: np.array([t["ss"][i] for i in range(len(t["ss"]))]).reshape(len(s[c]), -1) for c, t in table.items()}
    total = sum(n.values())
    mean = sum(s.values()) / total
    cov = sum(ss.values()) / total - np.outer(mean, mean)
    val, vec = np.linalg.eigh(cov)
    order = np.argsort(-val)[:components]
    basis = vec[:, order] * np.sign(vec[np.abs(vec[:, order]).argmax(axis=0), order])
    white = basis / np.sqrt(np.maximum(val[order], 1e-12))
    within = sum((ss[c] - np.outer(s[c], s[c]) / n[c]) for c in n) / total
    w = white.T @ within @ white
    means = np.stack([white.T @ (s[c] / n[c] - mean) for c in sorted(n)])
    between = (means * np.array([n[c] for c in sorted(n)])[:, None] / total).T @ means
    lval, lvec = np.linalg.eigh(w + 1e-9 * np.eye(len(w)))
    root = lvec / np.sqrt(np.maximum(lval, 1e-12))
    bval, bvec = np.linalg.eigh(root.T @ between @ root)
    scale = root @ bvec[:, np.argsort(-bval)[:outputs]]
    return [("relu", {}), ("log", {}), ("dense", {"w": white, "b": -mean @ white}), ("dense", {"w": scale, "b": np.zeros(outputs)})]


def knn_votes(queries: DataFrame, pool: DataFrame, key: str, vector: str, label: str, ks: list[int]) -> DataFrame:
    """(key, k, predicted, share): the most frequent label among the k nearest other rows (ties: the smallest label) and its share."""
    near = nearest_rows(queries, pool, key, vector, max(ks))
    labels = pool.select(F.col(key).alias("neighbour"), F.col(label).alias("__label"))
    near = near.join(labels, "neighbour")
    each = near.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where(F.col("rank") <= F.col("k"))
    votes = each.groupBy(key, "k", "__label").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(key, "k").orderBy(F.desc("n"), "__label")
    return votes.withColumn("__r", F.row_number().over(w)).where("__r = 1").select(key, "k", F.col("__label").alias("predicted"), (F.col("n") / F.col("k")).alias("share"))
