"""Problem 6: runs of the same event in ordered sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partita.operators.sequences import B, block_runs

#: Positions of an entity that are handled together; a block holds at most so many distinct positions.
BLOCK = 8192


def collapse_runs(rows: DataFrame, key: str, pos: str, value: str, newest: str, time: str | None = None, block: int = BLOCK) -> DataFrame:
    """One row per maximal run of equal values: (key, value, first_pos, last_pos, n, start_time, end_time).

    Of several rows of one (key, pos) the newest holds; then null values are dropped (they and
    missing positions do not interrupt a run). ``value`` is the canonical event, so spellings of one
    event collapse. Times are the smallest and largest non-null time of the run, null if it has none.
    Rows with a null position have no place in the order and are left out; a null key is a key.
    Ties of ``newest`` are broken by the time, then the value.

    Positions are cut into blocks of ``block``; the core's block_runs() finds the runs inside them by row number
    minus row number per value, and joins those that touch a block's edge, so no task holds a whole key.
    """
    t = F.col(time).cast("double") if time else F.lit(None).cast("double")
    blocks = rows.select(
        F.col(key).alias("key"), F.floor(F.col(pos) / block).cast("bigint").alias(B), F.col(pos).alias("pos"), F.col(value).alias("value"), t.alias("t"), F.col(newest).alias("newest")
    ).where(F.col("pos").isNotNull())
    order = Window.partitionBy("key", B).orderBy("pos", F.desc("newest"), "t", "value")
    kept = blocks.withColumn("before", F.lag("pos").over(order)).where((F.col("before").isNull() | (F.col("before") != F.col("pos"))) & F.col("value").isNotNull())
    runs = block_runs(kept, "key", "value", ["pos"], {"first_pos": F.col("pos")}, {"last_pos": F.col("pos")}, {"start_time": F.col("t")}, {"end_time": F.col("t")}, index=False)
    return runs.select("key", "value", "first_pos", "last_pos", F.col("run_len").alias("n"), "start_time", "end_time")
