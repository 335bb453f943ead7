"""Ordered-sequence operators: runs, n-grams, tiles, transitions. Every order ends in a unique column.

A key's rows are cut into blocks that follow the order. Inside a block windows do the work; what crosses
a block's edge goes through tables with a row or two per block, so no task holds a whole key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partita.operators.ranking import null_safe_join, with_offsets
from partita.session import broadcast_small

#: Rows of a key from which it is cut into blocks, and about how many a block then has.
BLOCK_ROWS = 100_000
B = "__b"


def with_blocks(df: DataFrame, key: str, order: list[str], rows: int | None = None) -> tuple[DataFrame, bool]:
    """Adds a block number that never falls along the order: 0, or for keys of more than ``rows`` rows an even cut of the first order column.

    Also whether every key is one block; then plain windows do, and nothing has to be joined across blocks. The first order column is a number or a time. Long keys are found with a partial count; there are at most
    total / ``rows`` of them. A key that holds one value of the first column over and over is one block.
    """
    rows = rows or BLOCK_ROWS
    at = F.col(order[0]).cast("double")
    long = df.groupBy(F.col(key).alias("__k")).agg(F.count(F.lit(1)).alias("__m"), F.min(at).alias("__lo"), F.max(at).alias("__hi")).where(F.col("__m") > rows)
    n = long.count()
    if not n:
        return df.withColumn(B, F.lit(0).cast("bigint")), True
    width = F.greatest((F.col("__hi") - F.col("__lo")) * rows / F.col("__m"), F.lit(1e-9))
    out = df.join(broadcast_small(long, n), F.col(key).eqNullSafe(F.col("__k")), "left")
    # null orders come first
    return out.withColumn(B, F.when(F.col("__m").isNull(), 0).when(at.isNull(), -1).otherwise(F.floor((at - F.col("__lo")) / width)).cast("bigint")).drop("__k", "__m", "__lo", "__hi"), False


def with_positions(df: DataFrame, key: str, order: list[str], rows: int | None = None) -> DataFrame:
    """Adds ``__at``, the position in the key from 0, and ``__n``, the key's number of rows."""
    b, whole = with_blocks(df, key, order, rows)
    if whole:
        at = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
        return b.drop(B).withColumns({"__at": at.cast("bigint"), "__n": F.count(F.lit(1)).over(Window.partitionBy(key))})
    per = b.groupBy(key, B).agg(F.count(F.lit(1)).alias("__c"))
    upto = Window.partitionBy(key).orderBy(B).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(key, B, F.coalesce(F.sum("__c").over(upto), F.lit(0)).alias("__off"), F.sum("__c").over(Window.partitionBy(key)).alias("__n"))
    inside = b.withColumn("__in", F.row_number().over(Window.partitionBy(key, B).orderBy(*order)))
    return null_safe_join(inside, per, [key, B]).withColumn("__at", (F.col("__off") + F.col("__in") - 1).cast("bigint")).drop("__in", "__off", B)


def with_halo(df: DataFrame, key: str, order: list[str], before: int, after: int, rows: int | None = None) -> DataFrame:
    """with_positions() and ``__blk``: rows near a block's edge come once more in the next block, which needs them as neighbours.

    In a window over (key, __blk) by ``__at`` every row with ``__own`` has its ``before`` and ``after`` neighbours.
    """
    rows = max(rows or BLOCK_ROWS, before + after + 1)
    p = with_positions(df, key, order, rows)
    first, last = F.floor((F.col("__at") - after) / rows), F.floor((F.col("__at") + before) / rows)
    each = p.withColumn("__blk", F.explode(F.sequence(F.greatest(first, F.lit(0).cast("bigint")), F.least(last, F.floor((F.col("__n") - 1) / rows)))))
    return each.withColumn("__own", F.floor(F.col("__at") / rows) == F.col("__blk"))


def with_neighbours(df: DataFrame, key: str, order: list[str], columns: list[str], rows: int | None = None) -> DataFrame:
    """Adds ``__prev`` and ``__next``, structs of the given columns in the rows before and after; null at a key's ends."""
    b, whole = with_blocks(df.withColumn("__s", F.struct(*columns)), key, order, rows)
    if whole:
        w = Window.partitionBy(key).orderBy(*order)
        return b.withColumns({"__prev": F.lag("__s").over(w), "__next": F.lead("__s").over(w)}).drop("__s", B)
    at = F.struct(*order)
    ends = b.groupBy(key, B).agg(F.min_by("__s", at).alias("__first"), F.max_by("__s", at).alias("__last"))
    w = Window.partitionBy(key).orderBy(B)
    ends = ends.select(key, B, F.lag("__last").over(w).alias("__pb"), F.lead("__first").over(w).alias("__nb"))
    inside = Window.partitionBy(key, B).orderBy(*order)
    near = null_safe_join(b.withColumns({"__pi": F.lag("__s").over(inside), "__ni": F.lead("__s").over(inside)}), ends, [key, B])
    return near.withColumns({"__prev": F.coalesce("__pi", "__pb"), "__next": F.coalesce("__ni", "__nb")}).drop("__s", "__pi", "__ni", "__pb", "__nb", B)


def block_runs(blocks: DataFrame, key: str, value: str, order: list[str], first: dict[str, Column] | None = None, last: dict[str, Column] | None = None, least: dict[str, Column] | None = None, most: dict[str, Column] | None = None, index: bool = True, whole: bool = False) -> DataFrame:
    """One row per maximal run of equal values (null equals null) of a key: (key, value, start_idx, run_len, ...).

    ``blocks`` has a block number ``__b`` that follows the order. ``first`` and ``last`` name what to take
    from a run's first and last row, ``least`` and ``most`` smallest and largest values over it. Without
    ``index`` start_idx is left out, which saves a join. ``whole`` says that every key is one block.
    Within (key, block) the row number minus the row number per value is constant exactly along a run.
    Runs that touch a block's edge are joined across blocks in a table of edge runs alone, two at most per block.
    """
    first, last, least, most = first or {}, last or {}, least or {}, most or {}
    by, by_value = Window.partitionBy(key, B).orderBy(*order), Window.partitionBy(key, B, value).orderBy(*order)
    numbered = blocks.withColumn("__rn", F.row_number().over(by)).withColumn("__island", F.col("__rn") - F.row_number().over(by_value))
    runs = numbered.groupBy(key, B, value, "__island").agg(
        F.count(F.lit(1)).alias("__c"), F.min("__rn").alias("__lo"), F.max("__rn").alias("__hi"),
        *[F.min_by(c, "__rn").alias(n) for n, c in first.items()], *[F.max_by(c, "__rn").alias(n) for n, c in last.items()],
        *[F.min(c).alias(n) for n, c in least.items()], *[F.max(c).alias(n) for n, c in most.items()],
    )
    if whole:
        return runs.withColumns({"start_idx": (F.col("__lo") - 1).cast("bigint"), "run_len": F.col("__c")}).drop(B, "__island", "__c", "__lo", "__hi", *([] if index else ["start_idx"]))
    edge = (F.col("__lo") == 1) | (F.col("__hi") == F.max("__hi").over(Window.partitionBy(key, B)))
    # a run inside its block is whole; edge runs of a key share a group, in which the last of a block and the first of the
    # next are neighbours (two edge runs of one block never join)
    runs = runs.withColumn("__edge", edge).withColumn("__group", F.when(F.col("__edge"), F.lit(None).cast("bigint")).otherwise(F.col(B)))
    w = Window.partitionBy(key, "__group").orderBy(B, "__lo")
    joins = F.col("__edge") & (F.lag(B).over(w) != F.col(B)) & F.lag(value).over(w).eqNullSafe(F.col(value))
    runs = runs.withColumn("__start", F.when(joins, 0).otherwise(1)).withColumn("__run", F.sum("__start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    if index:
        runs = null_safe_join(runs, with_offsets(runs, [key], B, {"__off": F.col("__c")}), [key, B])
    at = [F.min(F.col("__off") + F.col("__lo") - 1).cast("bigint").alias("start_idx")] if index else []
    place = F.struct(B, "__lo")
    merged = runs.groupBy(key, "__group", "__run").agg(
        F.first(value).alias(value), *at, F.sum("__c").alias("run_len"),
        *[F.min_by(n, place).alias(n) for n in first], *[F.max_by(n, place).alias(n) for n in last], *[F.min(n).alias(n) for n in least], *[F.max(n).alias(n) for n in most],
    )
    return merged.drop("__group", "__run")


def run_length(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """(key, value, start_idx, run_len) of runs of equal values; null equals null."""
    b, whole = with_blocks(df, key, order)
    return block_runs(b, key, value, order, whole=whole).withColumn("start_idx", F.col("start_idx").cast("int"))


def run_decode(runs: DataFrame, start: str = "start_idx", length: str = "run_len") -> DataFrame:
    """The inverse: one row per element, with its position ``idx``."""
    return runs.withColumn("idx", F.explode(F.sequence(F.col(start), (F.col(start) + F.col(length) - 1).cast("int")))).drop(start, length)


def runs_to_intervals(df: DataFrame, key: str, order: list[str], value: str, time: str) -> DataFrame:
    """(key, value, start, end): a run ends where the next begins; the last one ends at the last time, so it can be empty."""
    near = with_neighbours(df.select(*dict.fromkeys([key, *order, value, time])), key, order, [time])
    near = near.withColumn("__end", F.when(F.col("__next").isNull(), F.col(time)).otherwise(F.col("__next")[time])).drop("__prev", "__next")
    b, whole = with_blocks(near, key, order)
    runs = block_runs(b, key, value, order, {"start": F.col(time)}, {"end": F.col("__end")}, index=False, whole=whole)
    return runs.select(key, value, "start", "end")


def compress_intervals(df: DataFrame, key: str, order: list[str], value: str, start: str, end: str) -> DataFrame:
    """(key, value, start, end) of runs of intervals with one label; gaps inside a run are swallowed."""
    b, whole = with_blocks(df, key, order)
    runs = block_runs(b, key, value, order, {"__from": F.col(start)}, {"__to": F.col(end)}, index=False, whole=whole)
    return runs.select(key, value, F.col("__from").alias("start"), F.col("__to").alias("end"))


def ngrams(df: DataFrame, key: str, order: list[str], value: str, n: int = 2, before: Column | None = None, after: Column | None = None) -> DataFrame:
    """Adds prev (and next, for n = 3) of each element, with the given edge states."""
    near = with_neighbours(df, key, order, [value])
    edge = lambda side, state: F.col(side)[value] if state is None else F.coalesce(F.col(side)[value], state)
    out = near.withColumn("prev", edge("__prev", before))
    out = out if n == 2 else out.withColumn("next", edge("__next", after))
    return out.drop("__prev", "__next")


def next_start(df: DataFrame, key: str, order: list[str], start: str, out: str = "e") -> DataFrame:
    """Adds the next row's ``start`` as this row's end; null for a key's last row."""
    return with_neighbours(df, key, order, [start]).withColumn(out, F.col("__next")[start]).drop("__prev", "__next")


def tiles(df: DataFrame, key: str, order: list[str], bins: str, length: int, rows: int | None = None) -> DataFrame:
    """Adds ``tile``: the rows idx - length/2 (floor) and on, ``length`` in all, zero rows outside."""
    left = length // 2
    out = with_halo(df, key, order, left, length - left - 1, rows)
    w = Window.partitionBy(key, "__blk").orderBy("__at")
    have = F.collect_list(bins).over(w.rowsBetween(-left, length - left - 1))
    zero = F.transform(F.col(bins), lambda x: F.lit(0.0))
    out = out.withColumns({"__have": have, "__zero": zero}).where("__own")
    pad_l = F.greatest(F.lit(left) - F.col("__at"), F.lit(0)).cast("int")
    pad_r = F.greatest(F.col("__at") + length - left - F.col("__n"), F.lit(0)).cast("int")
    return out.withColumn("tile", F.concat(F.array_repeat(F.col("__zero"), pad_l), F.col("__have"), F.array_repeat(F.col("__zero"), pad_r))).drop("__have", "__at", "__n", "__zero", "__blk", "__own")


def running_sum(df: DataFrame, key: str, order: list[str], value: Column, out: str, rows: int | None = None) -> DataFrame:
    """Adds the sum of ``value`` up to each row: sums inside blocks plus the sums of the blocks before."""
    b, whole = with_blocks(df.withColumn("__v", value), key, order, rows)
    if whole:
        return b.withColumn(out, F.sum("__v").over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).drop("__v", B)
    per = b.groupBy(key, B).agg(F.sum("__v").alias("__t"))
    upto = Window.partitionBy(key).orderBy(B).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(key, B, F.coalesce(F.sum("__t").over(upto), F.lit(0)).alias("__t"))
    inside = F.sum("__v").over(Window.partitionBy(key, B).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return null_safe_join(b.withColumn("__s", inside), per, [key, B]).withColumn(out, F.col("__s") + F.col("__t")).drop("__v", "__s", "__t", B)


def moving_sum(df: DataFrame, key: str, order: list[str], value: Column, before: int, after: int, out: str, rows: int | None = None) -> DataFrame:
    """Adds the sum over the ``before`` rows before and the ``after`` rows after each row, itself included; rows outside count nothing."""
    h = with_halo(df, key, order, before, after, rows)
    w = Window.partitionBy(key, "__blk").orderBy("__at").rowsBetween(-before, after)
    return h.withColumn(out, F.sum(value).over(w)).where("__own").drop("__at", "__n", "__blk", "__own")


def random_tiles(df: DataFrame, key: str, order: list[str], bins: str, label: str, length: int, seed: int, rows: int | None = None) -> DataFrame:
    """(key, first, tile, label): one tile of ``length`` rows of each key from a seeded random start, with the label in its middle; X is null.

    Keys shorter than the tile give none. Only the tile's rows are brought together.
    """
    p = with_positions(df, key, order, rows)
    start = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("bigint"), F.col("__n") - length + 1)
    p = p.where(F.col("__n") >= length).withColumn("first", start).where((F.col("__at") >= F.col("first")) & (F.col("__at") < F.col("first") + length))
    middle = F.max(F.when(F.col("__at") == F.col("first") + length // 2, F.col(label)))
    out = p.groupBy(key, "first").agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", F.col(bins).alias("x")))), lambda s: s["x"]).alias("tile"), middle.alias("label"))
    return out.withColumn("label", F.when(F.col("label") != "X", F.col("label")))


def random_walk(df: DataFrame, key: str, order: list[str], step: Column, width: int = 5, mean: Column | None = None, scale: Column | None = None, rows: int | None = None) -> DataFrame:
    """Adds ``walk``: cumulative steps, smoothed by a causal mean of ``width`` with zeros before the start, as z-score of the key; scaled and moved if asked.

    A walk that does not vary has z-score 0.
    """
    w = running_sum(df, key, order, step, "__walk", rows)
    w = moving_sum(w, key, order, F.col("__walk"), width - 1, 0, "__near", rows).withColumn("__near", F.col("__near") / width)
    m = w.groupBy(F.col(key).alias("__k")).agg(F.avg("__near").alias("__m"), F.stddev_pop("__near").alias("__s"))
    w = w.join(m, F.col(key).eqNullSafe(F.col("__k")))
    z = F.when(F.col("__s") > 0, (F.col("__near") - F.col("__m")) / F.col("__s")).otherwise(0.0)
    z = z if scale is None else z * scale
    return w.withColumn("walk", z if mean is None else z + mean).drop("__walk", "__near", "__k", "__m", "__s")


def hop_frames(df: DataFrame, array: str, length: int, stride: int) -> DataFrame:
    """(…, tile_no, tile): hops along a packed array; a remainder is dropped."""
    n = F.greatest(F.floor((F.size(array) - (length - stride)) / stride).cast("int"), F.lit(0))
    out = df.withColumn("tile_no", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))))
    return out.withColumn("tile", F.slice(F.col(array), F.col("tile_no") * stride + 1, F.lit(length)))


def first_mode(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """(key, mode, n): the most frequent value, of equals the one met first."""
    counted = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("__f"))
    best = counted.groupBy(key).agg(F.max("n").alias("n"))
    tied = null_safe_join(counted.withColumnRenamed("n", "__n"), best, [key]).where(F.col("__n") == F.col("n"))
    return tied.groupBy(key).agg(F.min_by(value, "__f").alias("mode"), F.first("n").alias("n"))


def smallest_mode(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, mode, n): the most frequent value, of equals the smallest. Null values do not count; a key of nulls has none."""
    counted = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("b")).select(key, F.col("b.v").alias("mode"), (-F.col("b.m")).alias("n"))
