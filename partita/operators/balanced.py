"""Per-key results when a handful of keys hold most rows: exact offset chunking."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partita.operators.ranking import null_safe_join
from partita.session import cut_lineage

#: Frames of a key that go to one task together, and rows of them that make a chunk.
BLOCK, CHUNK_ROWS = 8192, 50_000
_STATE = "key string, block bigint, seq bigint, n_rows bigint, n_frames bigint, first_frame bigint, last_frame bigint, first_value string, last_value string, n_changes bigint, counts array<struct<value:string,n:bigint>>"


def _chunk_states(chunk_rows: int):
    """Rows of a partition, sorted by (key, block, frame, newest first), to one state for each chunk of a (key, block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        open_: dict | None = None
        seq = 0

        def close() -> None:
            nonlocal open_
            if open_ is not None:
                s = open_
                out.append((s["key"], s["block"], s["seq"], s["rows"], s["frames"], s["first"], s["last"], s["fv"], s["lv"], s["changes"], [{"value": v, "n": n} for v, n in s["counts"].items()]))
                open_ = None

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            schema = pa.schema([("key", pa.string()), *[(n, pa.int64()) for n in ("block", "seq", "n_rows", "n_frames", "first_frame", "last_frame")], ("first_value", pa.string()), ("last_value", pa.string()), ("n_changes", pa.int64()), ("counts", pa.list_(pa.struct([("value", pa.string()), ("n", pa.int64())])))])
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        prev_key: object = object()
        prev_frame: object = object()
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column("key").dictionary_encode()
            values = b.column("value").dictionary_encode()
            names = [*keys.dictionary.to_pylist(), None]
            labels = values.dictionary.to_pylist()
            kc = pc.fill_null(keys.indices, len(names) - 1).to_numpy(zero_copy_only=False)
            vc = pc.fill_null(values.indices, -1).to_numpy(zero_copy_only=False)
            fr = pc.fill_null(b.column("frame").cast(pa.int64()), -(2**62)).to_numpy(zero_copy_only=False)
            blocks = b.column("block").to_numpy()
            cut = np.flatnonzero((np.diff(kc) != 0) | (np.diff(blocks) != 0)) + 1
            for lo, hi in zip([0, *cut], [*cut, len(kc)], strict=True):
                key, block = names[kc[lo]], int(blocks[lo])
                if (key, block) != prev_key:
                    close()
                    seq, prev_frame, prev_key = 0, object(), (key, block)
                while lo < hi:
                    if open_ is None:
                        open_ = {"key": key, "block": block, "seq": seq, "rows": 0, "frames": 0, "first": None, "last": None, "fv": None, "lv": None, "changes": 0, "counts": {}}
                        seq += 1
                    s = open_
                    end = min(hi, lo + chunk_rows - s["rows"])
                    f, v = fr[lo:end], vc[lo:end]
                    fresh = np.empty(len(f), bool)
                    fresh[0] = f[0] != prev_frame
                    fresh[1:] = f[1:] != f[:-1]
                    prev_frame = f[-1]
                    s["rows"] += end - lo
                    kept, kf = v[fresh], f[fresh]
                    if len(kept):
                        s["frames"] += len(kept)
                        said = kept >= 0
                        kept, kf = kept[said], kf[said]
                    if len(kept):
                        for c, n in zip(*np.unique(kept, return_counts=True), strict=True):
                            s["counts"][labels[c]] = s["counts"].get(labels[c], 0) + int(n)
                        a, z = labels[kept[0]], labels[kept[-1]]
                        if s["first"] is None:
                            s["first"], s["fv"] = int(kf[0]), a
                        elif s["lv"] != a:
                            s["changes"] += 1
                        s["changes"] += int(np.count_nonzero(kept[1:] != kept[:-1]))
                        s["last"], s["lv"] = int(kf[-1]), z
                    if s["rows"] >= chunk_rows:
                        close()
                    lo = end
            if len(out) >= 5000:
                yield flush()
                out.clear()
        close()
        if out:
            yield flush()

    return run


def chunk_states(rows: DataFrame, key: str, frame: str, raw: str, newest: str, derive: Callable[[DataFrame, str, str], DataFrame], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One state for each chunk of equal size of a key, with the exact row number its first row has in the key.

    A key's frames are cut into blocks of BLOCK, so a large key spreads over tasks and all rows of one (key, frame)
    stay together; the rows are read and exchanged once. They are counted per block and chunk; the prefix sums
    of these counts are the offsets of the chunks' first rows in the key.
    """
    slim = rows.select(F.col(key).alias("key"), F.col(frame).alias("frame"), F.col(raw).alias("raw"), F.col(newest).alias("newest"))
    slim = slim.withColumn("block", F.coalesce(F.floor(F.col("frame") / BLOCK), F.lit(-(2**48))))
    # without a number of partitions AQE may merge them; a (key, block) is never split
    dealt = slim.repartition("key", "block").sortWithinPartitions("key", "block", "frame", F.desc("newest"))
    # values are derived after the exchange, which so carries the raw ones
    states = derive(dealt, "raw", "value").select("key", "block", "frame", "value").mapInArrow(_chunk_states(chunk_rows), _STATE)
    states = cut_lineage(states)
    per = states.groupBy("key", "block").agg(F.sum("n_rows").alias("n"))
    w = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("key", "block", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("key", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    numbered = states.withColumn("before", F.coalesce(F.sum("n_rows").over(inside), F.lit(0)))
    return null_safe_join(numbered, offsets, ["key", "block"]).withColumn("first_row", F.col("offset") + F.col("before")).drop("offset", "before")


def key_summary(
    rows: DataFrame, key: str, frame: str, raw: str, newest: str, derive: Callable[[DataFrame, str, str], DataFrame], hot_share: float = 0.02, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """(key, n_rows, n_frames, top_value, n_top, n_changes, is_hot) for every key.

    ``derive(df, column, new_column)`` adds the value that is counted to the rows.
    n_rows counts all rows, repeats included; n_frames distinct frames; of repeats of a frame the
    newest holds. top_value is the most frequent non-null value (ties: the smallest), n_changes how
    often the value differs from the one before, is_hot whether the key holds at least ``hot_share``
    of all rows. A key with null values only has a null top_value; a null key is a key. Chunk states
    are merged in the order of their first row; boundary states join across chunks and blocks.
    """
    states = chunk_states(rows, key, frame, raw, newest, derive, chunk_rows)
    w = Window.partitionBy("key").orderBy("first_row")
    before = F.last("last_value", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    seam = F.when(F.col("first_value").isNotNull() & before.isNotNull() & (before != F.col("first_value")), 1).otherwise(0)
    totals = (
        states.withColumn("seam", seam)
        .groupBy("key")
        .agg(F.sum("n_rows").alias("n_rows"), F.sum("n_frames").alias("n_frames"), (F.sum("n_changes") + F.sum("seam")).alias("n_changes"))
    )
    top = (
        states.select("key", F.explode("counts").alias("c"))
        .groupBy("key", F.col("c.value").alias("value"))
        .agg(F.sum("c.n").alias("n"))
        .groupBy("key")
        .agg(F.max("n").alias("n_top"), F.min(F.struct((-F.col("n")).alias("m"), F.col("value"))).alias("best"))
        .select("key", F.col("best.value").alias("top_value"), "n_top")
    )
    # one number, from the states already written
    all_rows = states.agg(F.sum("n_rows")).first()[0] or 0
    return null_safe_join(totals, top, ["key"], "left").select("key", "n_rows", "n_frames", "top_value", "n_top", "n_changes", (F.col("n_rows") >= F.lit(hot_share) * all_rows).alias("is_hot"))
