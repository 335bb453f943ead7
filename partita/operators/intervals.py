"""Interval joins: overlap alignment, point-in-interval, regular grids, nearest values, segment pooling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partita.operators.ranking import BUCKET_ROWS, carry_last, null_safe_join


def _bucketed(df: DataFrame, width: int) -> DataFrame:
    return df.withColumn("__b", F.explode(F.sequence(F.floor(F.col("s") / width).cast("bigint"), F.floor((F.col("e") - 1) / width).cast("bigint"))))


def overlap_join(ref: DataFrame, est: DataFrame, key: str, width: int) -> DataFrame:
    """(key, s, e, ref, est) for every overlap of a reference with an estimate of the same key.

    Both have (key, s, e, label) in whole units, half open, s < e. Intervals are joined per time bucket of
    ``width`` and an overlap is kept in the bucket where it begins, so a key with very many
    intervals is spread over its buckets. Empty intervals overlap nothing.
    """
    r = _bucketed(ref.where("s < e").select(key, F.col("s").alias("s"), F.col("e").alias("e"), F.col("label").alias("ref")), width).withColumnsRenamed({"s": "rs", "e": "re"})
    x = _bucketed(est.where("s < e").select(key, F.col("s").alias("s"), F.col("e").alias("e"), F.col("label").alias("est")), width).withColumnsRenamed({"s": "xs", "e": "xe"})
    both = r.join(x, [key, "__b"]).where((F.col("rs") < F.col("xe")) & (F.col("xs") < F.col("re")))
    s, e = F.greatest("rs", "xs"), F.least("re", "xe")
    return both.where(F.floor(s / width) == F.col("__b")).select(key, s.alias("s"), e.alias("e"), "ref", "est")


def align_filled(ref: DataFrame, est: DataFrame, key: str, width: int, fill: str = "N") -> DataFrame:
    """overlap_join() after the estimate is cut to the reference's span and padded with ``fill`` at both ends.

    A key without estimate is one padded stretch; a key without reference has no span and no rows.
    """
    span = ref.groupBy(key).agg(F.min("s").alias("lo"), F.max("e").alias("hi"))
    reach = est.groupBy(key).agg(F.min("s").alias("first"), F.max("e").alias("last"))
    both = span.join(reach, key, "left")
    first, last = F.coalesce(F.least("first", "hi"), F.col("hi")), F.coalesce(F.greatest("last", "lo"), F.col("hi"))
    head = both.where(first > F.col("lo")).select(key, F.col("lo").alias("s"), first.alias("e"), F.lit(fill).alias("label"))
    tail = both.where(F.col("last").isNotNull() & (last < F.col("hi"))).select(key, last.alias("s"), F.col("hi").alias("e"), F.lit(fill).alias("label"))
    padded = est.select(key, "s", "e", "label").unionByName(head).unionByName(tail)
    return overlap_join(ref, padded, key, width)


def asof_label(points: DataFrame, ivs: DataFrame, key: str, time: str, width: int, fill: str = "N") -> DataFrame:
    """Adds ``label`` of the interval [s, e) that holds each point's time, or ``fill``.

    Intervals of a key do not overlap. Union and a carried last value, linear in both inputs; a
    point at an interval's start belongs to it, one at its end does not.
    """
    p = points.select(key, F.col(time).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast("struct<e:bigint,label:string>").alias("__iv"), F.struct(*points.columns).alias("__row"))
    i = ivs.select(key, F.col("s").alias("__t"), F.lit(0).alias("__side"), F.struct(F.col("e").cast("bigint").alias("e"), F.col("label").alias("label")).alias("__iv"), F.lit(None).cast(p.schema["__row"].dataType).alias("__row"))
    both = i.unionByName(p).withColumn("__b", F.floor(F.col("__t") / width))
    held = carry_last(both, [key], "__b", ["__t", "__side"], "__iv", "__held").where("__side = 1")
    label = F.when(F.col("__t") < F.col("__held.e"), F.col("__held.label")).otherwise(F.lit(fill))
    return held.select("__row.*", F.coalesce(label, F.lit(fill)).alias("label"))


def held_label(points: DataFrame, ivs: DataFrame, key: str, time: str, width: int, fill: str = "N") -> DataFrame:
    """Adds ``label`` of the interval [s, e) begun last among those that hold each point's time, or ``fill``.

    Intervals may overlap, nest and repeat; of those begun together the longest counts, then the larger label.
    Points are distinct rows. A range join in time buckets of ``width``, so a long key is spread over its
    buckets; an interval is cut to its key's points first, so none is dealt to buckets without any.
    """
    span = points.groupBy(key).agg(F.min(time).alias("__lo"), F.max(time).alias("__hi"))
    first, last = F.greatest("s", "__lo"), F.least(F.col("e") - 1, F.col("__hi"))
    near = ivs.join(span, key).where(first <= last)
    buckets = F.explode(F.sequence(F.floor(first / width).cast("bigint"), F.floor(last / width).cast("bigint")))
    i = near.select(F.col(key).alias("__k"), buckets.alias("__ib"), F.col("s").alias("__s"), F.col("e").alias("__e"), F.col("label").alias("__label"))
    p = points.withColumn("__b", F.floor(F.col(time) / width).cast("bigint"))
    both = p.join(i, (p[key] == i["__k"]) & (p["__b"] == i["__ib"]) & (p[time] >= i["__s"]) & (p[time] < i["__e"]), "left")
    held = both.groupBy(*points.columns, "__b").agg(F.max(F.when(F.col("__s").isNotNull(), F.struct("__s", "__e", "__label"))).alias("__held"))
    return held.select(*points.columns, F.coalesce("__held.__label", F.lit(fill)).alias("label"))


def to_grid(ivs: DataFrame, key: str, step: int, width: int, fill: str = "N") -> DataFrame:
    """(key, tick, t, label): each key's span sampled every ``step`` from its first start."""
    span = ivs.groupBy(key).agg(F.min("s").alias("lo"), F.max("e").alias("hi"))
    n = F.floor((F.col("hi") - F.col("lo") - 1) / step).cast("bigint")
    ticks = span.where("hi > lo").select(key, "lo", F.explode(F.sequence(F.lit(0).cast("bigint"), n)).alias("tick")).select(key, "tick", (F.col("lo") + F.col("tick") * step).alias("t"))
    return asof_label(ticks, ivs, key, "t", width, fill)


def nearest_value(queries: DataFrame, pool: DataFrame, query_id: str, query: str, pool_id: str, value: str) -> DataFrame:
    """(query_id, nearest): id of the pool row with the value closest to the query's; ties go to the smaller value, then id.

    A sorted merge both ways over different values, not a cross join: the nearest row is the last one
    at or below, or the first one above. Equal values are merged before and joined to their rows after, so a frequent value
    is one row; buckets of values hold about BUCKET_ROWS of them. Null queries and values match nothing.
    """
    uniq = pool.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.min(pool_id).cast("bigint").alias("id"))
    asked = queries.where(F.col(query).isNotNull()).select(F.col(query_id), F.col(query).cast("double").alias("v"))
    q = asked.select("v").distinct().select("v", F.lit(None).cast("struct<v:double,id:bigint>").alias("hit"), F.lit(True).alias("q"))
    both = uniq.select("v", F.struct("v", "id").alias("hit"), F.lit(False).alias("q")).unionByName(q)
    n, lo, hi = both.agg(F.count(F.lit(1)), F.min("v"), F.max("v")).first()
    width = max((hi - lo) * BUCKET_ROWS / n, 1e-300) if n and hi > lo else 1.0
    both = both.withColumns({"one": F.lit(1), "b": F.floor((F.col("v") - F.lit(lo or 0.0)) / width)})
    below = carry_last(both, ["one"], "b", ["v", "q"], "hit", "low").where("q").select("v", "low")
    up = both.withColumns({"b": -F.col("b"), "nv": -F.col("v")})
    above = carry_last(up, ["one"], "b", ["nv", "q"], "hit", "high").where("q").select("v", "high")
    near = F.when(F.col("high").isNull() | (F.col("v") - F.col("low.v") <= F.col("high.v") - F.col("v")), F.col("low.id")).otherwise(F.col("high.id"))
    return asked.join(below.join(above, "v").select("v", near.alias("nearest")), "v").select(query_id, "nearest")


def segment_pool(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Mean, median, largest and most frequent value (of equals the smallest; nulls do not count) of each segment."""
    rows = df.select(*keys, value.alias("__v"))
    counts = rows.where("__v is not null").groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__n"))
    mode = counts.groupBy(*keys).agg(F.min_by("__v", F.struct(-F.col("__n"), F.col("__v"))).alias("mode"))
    return null_safe_join(rows.groupBy(*keys).agg(F.avg("__v").alias("mean"), F.median("__v").alias("median"), F.max("__v").alias("max")), mode, keys, "left")


def boundary_pool(df: DataFrame, edges: DataFrame, key: str, index: str, value: str) -> DataFrame:
    """(key, segment, mean, median, max, mode) between successive edges; equal edges take the single value at that edge.

    ``edges(key, segment, lo, hi)`` are positions, lo <= hi; decreasing edges raise.
    """
    checked = edges.withColumn("hi", F.when(F.col("hi") < F.col("lo"), F.raise_error("edges decrease")).otherwise(F.greatest(F.col("hi"), F.col("lo") + 1)))
    long = checked.select(key, "segment", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)).alias(index))
    return segment_pool(long.join(df.select(key, index, value), [key, index]), [key, "segment"], F.col(value))

