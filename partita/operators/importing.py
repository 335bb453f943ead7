"""Entities from features, annotations and split files; stores transformed by networks, checkpoint by checkpoint."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partita.operators.decode import decode, segments
from partita.operators.intervals import held_label
from partita.operators.models import Layer, apply_network


def import_entities(splits: DataFrame, features: DataFrame, ivs: DataFrame, key: str, time: str, bins: str, width: int) -> DataFrame:
    """(fold, split, key, frame, time, bins, label): every frame of every key of a split file with the label that holds at its time.

    ``splits(fold, split, key)``, ``features(key, frame, time, bins)``, ``ivs(key, s, e, label)`` of the first annotation.
    Frames are labelled once and then dealt to the folds; bins are single precision; a key of the split file without
    features has no rows, one without an annotation is N throughout. Written with write_stash(..., "fold", "split").
    """
    rows = features.select(key, "frame", time, F.transform(bins, lambda x: x.cast("float")).alias(bins))
    points = rows.select(key, "frame", time)
    labelled = held_label(points, ivs, key, time, width)
    whole = rows.join(labelled, [key, "frame", time])
    return splits.select("fold", "split", key).distinct().join(whole, key).select("fold", "split", key, "frame", time, bins, "label")


def _flat(layers: list[Layer], at: str) -> dict[str, np.ndarray]:
    out = {f"{at}names": np.array([n for n, _ in layers])}
    for i, (_, p) in enumerate(layers):
        for k, v in p.items():
            if k == "branches":
                out[f"{at}{i}.branches"] = np.array(len(v))
                for j, b in enumerate(v):
                    out |= _flat(b, f"{at}{i}.{j}.")
            elif v is not None:
                out[f"{at}{i}.{k}"] = np.asarray(v)
    return out


def save_layers(layers: list[Layer], path: str) -> None:
    """A network as one NumPy archive: layer names in order, parameters by layer and name, branches by number."""
    np.savez(path, **_flat(layers, ""))


def load_layers(path: str) -> list[Layer]:
    with np.load(path) as z:
        flat = dict(z)

    def read(at: str) -> list[Layer]:
        names = [str(n) for n in flat[f"{at}names"]]
        params: list[dict] = [{} for _ in names]
        for i, p in enumerate(params):
            here = f"{at}{i}."
            for k in [k[len(here) :] for k in flat if k.startswith(here)]:
                if k == "branches":
                    p[k] = [read(f"{here}{j}.") for j in range(int(flat[here + k]))]
                elif "." not in k:
                    v = flat[here + k]
                    p[k] = v.item() if v.ndim == 0 else tuple(v.tolist()) if k in ("shape", "axes") else v
        return list(zip(names, params, strict=True))

    return read("")


def transform_store(spark: SparkSession, source: str, sink: str, array: str, shape: tuple[int, ...], layers: list[Layer], out: str = "posterior") -> None:
    """Every record of a parquet store through a network into another store, same fields and keys, the input array replaced by the output."""
    apply_network(spark.read.parquet(source), array, shape, layers, out).write.mode("overwrite").parquet(sink)


def sweep_checkpoints(df: DataFrame, checkpoints: list[str], array: str, shape: tuple[int, ...], start: int = 0, stride: int = 1, load: Callable[[str], list[Layer]] = load_layers, out: str = "posterior") -> DataFrame:
    """Records through every stride-th of the sorted checkpoints from ``start`` on: adds checkpoint and the output. A training run has few."""
    result = None
    for c in sorted(checkpoints)[start::stride]:
        part = apply_network(df, array, shape, load(c), out).withColumn("checkpoint", F.lit(c))
        result = part if result is None else result.unionByName(part)
    return result if result is not None else df.drop(array).limit(0).select("*", F.lit(None).cast("array<double>").alias(out), F.lit(None).cast("string").alias("checkpoint"))


def predict_sweep(tiles: DataFrame, keys: list[str], frame: str, time: Column, array: str, shape: tuple[int, ...], layers: list[Layer], penalties: list[float]) -> DataFrame:
    """(keys, penalty, segment, state, start, end, confidence): a network's posteriors decoded with every penalty.

    ``time`` is an expression of the tiles' columns. The posteriors are worked out once; penalties are dealt to tasks beside the keys.
    """
    p = apply_network(tiles.withColumn("__t", time), array, shape, layers, "posterior")
    each = p.withColumn("penalty", F.explode(F.array(*[F.lit(float(x)) for x in penalties])))
    path = decode(each, keys, frame, "posterior", F.col("penalty"))
    chosen = path.join(p.select(*keys, F.col(frame).alias("frame"), "__t", "posterior"), [*keys, "frame"])
    logp = F.ln(F.get("posterior", F.col("state")))
    return segments(chosen, [*keys, "penalty"], "frame", F.col("__t"), logp)
