"""Runs of equal labels on a stream: a keyed state holds the open run, closed runs are emitted."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = T.StructType([T.StructField("key", T.StringType()), T.StructField("label", T.StringType()), T.StructField("start_us", T.LongType()), T.StructField("end_us", T.LongType()), T.StructField("run_len", T.LongType()), T.StructField("closed", T.BooleanType())])
STATE = T.StructType([T.StructField("label", T.StringType()), T.StructField("start_us", T.LongType()), T.StructField("last_us", T.LongType()), T.StructField("n", T.LongType())])


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        label, start, last, n = state.get
        state.remove()
        yield pd.DataFrame([(key[0], label, start, last, n, False)], columns=OUT.names)
        return
    rows = pd.concat(list(batches)).sort_values(["us", "id"])
    run = list(state.get) if state.exists else None
    out = []
    for label, us in zip(rows["label"], rows["us"], strict=True):
        if run is not None and us < run[2]:
            continue  # later than the watermark's order: the run it belongs to is past
        if run is None:
            run = [label, int(us), int(us), 1]
        elif label == run[0]:
            run[2], run[3] = int(us), run[3] + 1
        else:
            # as in the batch form, a run ends where the next begins
            out.append((key[0], run[0], run[1], int(us), run[3], True))
            run = [label, int(us), int(us), 1]
    if run is not None:
        state.update(tuple(run))
        state.setTimeoutTimestamp(max(run[2] // 1000 + 1, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame(out, columns=OUT.names)


def stream_runs(events: DataFrame, key: str, id_: str, time: str, label: str, delay: str = "1 hour") -> DataFrame:
    """(key, label, start_us, end_us, run_len, closed) of runs, appended as the stream goes.

    ``events`` is a streaming DataFrame with a timestamp column. Rows later than ``delay`` behind the
    newest are dropped by the watermark; a key's open run is emitted, not closed, when the watermark passes it.
    Within a micro-batch rows are ordered by (time, id). State per key is one open run.
    """
    rows = events.withWatermark(time, delay).select(F.col(key).cast("string").alias("key"), F.col(id_).alias("id"), F.unix_micros(F.col(time)).alias("us"), F.col(label).alias("label"), F.col(time))
    return rows.groupBy("key").applyInPandasWithState(_advance, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def windowed_counts(events: DataFrame, time: str, label: str, window: str, delay: str) -> DataFrame:
    """(start, label, n): events per label and tumbling window, final once the watermark has passed the window."""
    return events.withWatermark(time, delay).groupBy(F.window(time, window).alias("w"), label).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), label, "n")
