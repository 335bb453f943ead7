"""Viterbi decoding of frame posteriors into labelled segments."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def viterbi(posterior: np.ndarray, penalty: float = 0.0, transitions: np.ndarray | None = None, prior: np.ndarray | None = None, scaled: bool = True) -> np.ndarray:
    """Best path through (frames, states). Off-diagonal transitions are scaled by exp(penalty); ties go to the first state.

    Without a transition matrix and with penalty <= 0 a step costs one pass over the states: the best way into a
    state is to stay, or to come from the best state of all. ``transitions`` has the next state in rows.
    """
    p = np.asarray(posterior, float)
    n = p.shape[1]
    if not len(p):
        return np.zeros(0, int)
    c = float(np.exp(penalty))
    norm = lambda v: v / (v.sum() or 1.0) if scaled else v
    delta = norm((np.full(n, 1.0 / n) if prior is None else np.asarray(prior, float)) * p[0])
    back = np.zeros(p.shape, int)
    states = np.arange(n)
    full = None if transitions is None and c <= 1 else np.where(np.eye(n) > 0, 1.0, c) * (1.0 if transitions is None else np.asarray(transitions, float))
    for t in range(1, len(p)):
        if full is None:
            top = int(delta.argmax())
            jump = c * delta[top]
            back[t] = np.where(delta > jump, states, np.where(delta < jump, top, np.minimum(states, top)))
            best = np.maximum(delta, jump)
        else:
            r = delta[None, :] * full
            back[t] = r.argmax(axis=1)
            best = r.max(axis=1)
        delta = norm(best * p[t])
    path = np.empty(len(p), int)
    path[-1] = int(delta.argmax())
    for t in range(len(p) - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def decode(frames: DataFrame, keys: list[str], frame: str, posterior: str, penalty: Column) -> DataFrame:
    """(keys, penalty, frame, state): one best path per key and penalty. Frames of a key are one recurrence, so work spreads over keys and penalties."""
    slim = frames.select(*keys, F.col(frame).alias("frame"), F.col(posterior).alias("p"), penalty.alias("penalty"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.select(*keys, "penalty", "frame").schema) + ", state int"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        out = pdf[[*keys, "penalty", "frame"]].copy()
        out["state"] = viterbi(np.stack(pdf["p"].to_numpy()), float(pdf["penalty"].iloc[0])).astype("int32")
        return out

    return slim.groupBy(*keys, "penalty").applyInPandas(run, schema)


def segments(path: DataFrame, keys: list[str], frame: str, time: Column, logp: Column) -> DataFrame:
    """(keys, segment, state, start, end, confidence) from a decoded path.

    Ends are the next segment's start, the last one's the last time. Confidence is the mean log posterior of the
    chosen state, 0 if it is not finite; the last frame is left out of it, so a last segment of one frame has none.
    """
    w, ws = Window.partitionBy(*keys).orderBy(frame), Window.partitionBy(*keys, "state").orderBy(frame)
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(frame))) == 1
    n = path.withColumns({"__t": time, "__l": logp, "__last": last, "__i": F.row_number().over(w)}).withColumn("__g", F.col("__i") - F.row_number().over(ws))
    runs = n.groupBy(*keys, "state", "__g").agg(F.min("__i").alias("__i"), F.min_by("__t", "__i").alias("start"), F.max_by("__t", "__i").alias("__end"), F.avg(F.when(~F.col("__last"), F.col("__l"))).alias("__c"), F.count_if(~F.col("__last")).alias("__n"), F.count_if(~F.col("__last") & F.col("__l").isNull()).alias("__bad"))
    order = Window.partitionBy(*keys).orderBy("__i")
    confidence = F.when(F.col("__n") == 0, F.lit(None)).when(F.col("__bad") > 0, 0.0).otherwise(F.col("__c"))
    return runs.select(*keys, (F.row_number().over(order) - 1).alias("segment"), "state", "start", F.coalesce(F.lead("start").over(order), F.col("__end")).alias("end"), confidence.alias("confidence"))

