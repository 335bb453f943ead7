"""Continuous covered periods of labelled intervals, and the gaps between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partita.operators.ranking import null_safe_join, with_offsets

#: Width of a time bucket. A bucket holds at most this many distinct boundary values of a key.
BUCKET_MS = 60_000


def interval_rows(df: DataFrame, key: str = "key", intervals: str = "intervals") -> DataFrame:
    """(key, start_ms, end_ms) of every usable interval: both bounds present, end after start.

    Bounds in seconds are rounded to whole milliseconds first. Null and empty arrays, null
    elements, missing or non-finite bounds and end <= start cover nothing.
    """
    ms = lambda c: F.when(F.abs(c) < 9e12, F.round(c * 1000).cast("bigint"))
    return (
        df.select(F.col(key).alias("key"), F.explode(F.col(intervals)).alias("__iv"))
        .select("key", ms(F.col("__iv.start")).alias("start_ms"), ms(F.col("__iv.end")).alias("end_ms"))
        .where(F.col("end_ms") > F.col("start_ms"))
    )


def periods_and_gaps(rows: DataFrame, key: str = "key", bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Merge intervals of each key into maximal periods and list the gaps: (key, kind, start_ms, end_ms).

    Starts and ends are ranked independently. A gap follows the end of rank r where the start of
    rank r + 1 is later than it, that is where as many intervals have ended as have begun; the
    boundaries of the gaps, paired, give the periods. Touching intervals join. Equal boundary values
    are counted before the shuffle, and ranks are offsets of time buckets plus running counts inside
    a bucket, so no task sorts a whole key. A null key is a key; empty input gives empty output.
    """
    k = F.col(key)
    marks = rows.select(
        k.alias("key"),
        F.explode(
            F.array(
                F.struct(F.col("start_ms").alias("ms"), F.lit(1).alias("s"), F.lit(0).alias("e")),
                F.struct(F.col("end_ms").alias("ms"), F.lit(0).alias("s"), F.lit(1).alias("e")),
            )
        ).alias("m"),
    )
    marks = (
        marks.groupBy("key", F.col("m.ms").alias("ms"))
        .agg(F.sum("m.s").alias("s"), F.sum("m.e").alias("e"))
        .withColumn("bucket", F.floor(F.col("ms") / bucket_ms).cast("bigint"))
    )
    off = with_offsets(marks, ["key"], "bucket", {"s0": F.col("s"), "e0": F.col("e")})
    upto = Window.partitionBy("key", "bucket").orderBy("ms").rowsBetween(Window.unboundedPreceding, 0)
    ranked = marks.withColumns({"s_in": F.sum("s").over(upto), "e_in": F.sum("e").over(upto)})
    ranked = null_safe_join(ranked, off, ["key", "bucket"]).select(
        "key",
        "bucket",
        "ms",
        # ranks: intervals begun and ended up to here, this value included or not
        (F.col("s0") + F.col("s_in")).alias("begun"),
        (F.col("e0") + F.col("e_in")).alias("ended"),
        (F.col("s0") + F.col("s_in") - F.col("s")).alias("begun_before"),
        (F.col("e0") + F.col("e_in") - F.col("e")).alias("ended_before"),
        "s",
        "e",
    )
    edges = ranked.where(
        ((F.col("e") > 0) & (F.col("begun") == F.col("ended"))) | ((F.col("s") > 0) & (F.col("begun_before") == F.col("ended_before")))
    ).select(
        "key",
        "bucket",
        "ms",
        F.when((F.col("s") > 0) & (F.col("begun_before") == F.col("ended_before")), F.lit("a")).otherwise(F.lit("z")).alias("edge"),
    )
    # the start of an edge's period, or the end before an edge: the previous edge, in this bucket or in an earlier one
    last = edges.groupBy("key", "bucket").agg(F.max("ms").alias("last"))
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(-1, -1)
    last = last.select("key", "bucket", F.max("last").over(before).alias("carried"))
    inside = Window.partitionBy("key", "bucket").orderBy("ms")
    paired = null_safe_join(edges.withColumn("prev", F.lag("ms").over(inside)), last, ["key", "bucket"])
    return (
        paired.withColumn("start_ms", F.coalesce("prev", "carried"))
        .where(F.col("start_ms").isNotNull())
        .select("key", F.when(F.col("edge") == "z", F.lit("period")).otherwise(F.lit("gap")).alias("kind"), "start_ms", F.col("ms").alias("end_ms"))
    )
