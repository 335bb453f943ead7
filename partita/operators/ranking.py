"""Exact ranks and running sums over groups of any size, without one task per group.

A group is cut into buckets that follow the order; bucket totals are summed first (partial
aggregation, a few rows per group), their exclusive prefix sums become offsets, and only the
rows of one bucket are ever sorted together.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partita.session import cut_lineage

BUCKET = "__bucket"
#: Rows that are sorted together.
BUCKET_ROWS = 65_536


def hash_order(*cols: Column, seed: int = 0) -> Column:
    """A non-negative 62-bit pseudo-random number, the same in every run."""
    return F.shiftrightunsigned(F.xxhash64(*cols, F.lit(seed)), 2)


def with_offsets(df: DataFrame, by: list[str], bucket: str, sums: dict[str, Column]) -> DataFrame:
    """Per (by, bucket) the sums of all earlier buckets of the same group, as columns ``<name>``.

    One row per non-empty bucket. ``by`` may be empty and may hold nulls; without it the buckets' sums (not
    the rows) pass through one window.
    """
    per = df.groupBy(*by, bucket).agg(*[F.sum(c).cast("bigint").alias(n) for n, c in sums.items()])
    w = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return per.select(*by, bucket, *[F.coalesce(F.sum(n).over(w), F.lit(0).cast("bigint")).alias(n) for n in sums])


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null matches null; the right side's key columns are dropped."""
    r = right.select(*[F.col(c).alias(f"__r_{c}") if c in on else F.col(c) for c in right.columns])
    cond = [left[c].eqNullSafe(r[f"__r_{c}"]) for c in on]
    return left.join(r, cond, how).drop(*[f"__r_{c}" for c in on])


def global_rank(
    df: DataFrame, by: list[str], order: str, tie: list[str], out: str = "rank", weight: str | None = None, rows: int | None = None
) -> DataFrame:
    """``row_number`` (or the running sum of ``weight``, row included) per ``by`` in the order of ``order``.

    ``order`` is a hash_order() number, so a bucket (its top bits) holds an even part of a group. There are so many
    buckets that one holds about BUCKET_ROWS rows if all rows are one group; ``rows`` is their number (counted
    if not given). Ties are broken by ``tie``. Empty input gives empty output; null groups are groups.
    """
    n = df.count() if rows is None else rows
    bits = max(4, min(40, math.ceil(math.log2(max(1, n) / BUCKET_ROWS)) if n > BUCKET_ROWS else 4))
    one = F.col(weight) if weight else F.lit(1)
    b = df.withColumn(BUCKET, F.shiftright(F.col(order), 62 - bits))
    off = with_offsets(b, by, BUCKET, {"__off": one})
    w = Window.partitionBy(*by, BUCKET).orderBy(order, *tie)
    inner = F.sum(one).over(w.rowsBetween(Window.unboundedPreceding, 0)) if weight else F.row_number().over(w)
    return (
        null_safe_join(b.withColumn("__in", inner), off, [*by, BUCKET])
        .withColumn(out, (F.col("__in") + F.col("__off")).cast("bigint"))
        .drop("__in", "__off", BUCKET)
    )


def number_rows(df: DataFrame, order: list[str], out: str = "number", weight: str | None = None, upto: str = "upto") -> DataFrame:
    """Adds the position from 0 over all rows in the order of any columns, and the sum of ``weight`` up to each row.

    Rows are sorted in ranges, written once, and counted per range; one row per range is summed up.
    """
    sorted_ = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order))
    # the upper bits are the partition, the lower ones the place in it
    rows = sorted_.withColumn("__m", F.monotonically_increasing_id()).withColumns({"__p": F.shiftright("__m", 33), "__i": F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))})
    sums = {"__n": F.lit(1)} | ({"__w": F.col(weight)} if weight else {})
    per = rows.groupBy("__p").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    w = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    off = per.select(F.col("__p").alias("__q"), *[F.coalesce(F.sum(n).over(w), F.lit(0)).alias(n) for n in sums])
    rows = rows.join(off, F.col("__p") == F.col("__q")).withColumn(out, (F.col("__i") + F.col("__n")).cast("bigint"))
    if weight:
        inside = Window.partitionBy("__p").orderBy("__i").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn(upto, F.sum(weight).over(inside) + F.col("__w"))
    return rows.select(*df.columns, out, *([upto] if weight else []))


def carry_last(df: DataFrame, by: list[str], bucket: str, order: list[Column | str], value: str, out: str) -> DataFrame:
    """Adds the last non-null ``value`` at or before each row of its group, in the order (bucket, order).

    Inside a bucket by a window; across buckets only one value per bucket is carried, so a group of
    any size is spread over its buckets.
    """
    w = Window.partitionBy(*by, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = df.withColumn("__in", F.last(value, ignorenulls=True).over(w))
    # one row per bucket with its last value, null if it has none
    ends = df.groupBy(*by, bucket).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("__last"))
    before = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*by, bucket, F.last("__last", ignorenulls=True).over(before).alias("__carried"))
    return null_safe_join(inside, carried, [*by, bucket]).withColumn(out, F.coalesce("__in", "__carried")).drop("__in", "__carried")
