"""Nearest neighbours and other matrix work: Arrow batches against a stated block of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partita.functions.arrays import cosine_distance

#: Query vectors that are sent to the tasks together; more are taken in blocks, each a pass over the pool.
QUERY_BLOCK = 20_000


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as a matrix; lists are equally long."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _top(ids: list, points: np.ndarray, k: int, decimals: int):
    norms = (points**2).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            own, x = np.asarray(b.column("id").to_pylist()), matrix(b.column("x"))
            q, n, dist = [], [], []
            size = (x**2).sum(axis=1)
            for lo in range(0, len(points), 512):
                p = points[lo : lo + 512]
                both = norms[lo : lo + 512, None] + size
                near = both - 2 * p @ x.T
                # what rounding can have done to a squared distance, with room to spare
                error = 8 * (p.shape[1] + 8) * np.finfo(float).eps * both
                most = np.where(np.asarray(ids[lo : lo + 512])[:, None] == own, np.inf, near + error)
                # at least k rows are this near; whatever may be as near after rounding stays, however many rows that are
                bound = np.partition(most, k - 1, axis=1)[:, k - 1] if k <= len(own) else np.full(len(p), np.inf)
                reach = (np.sqrt(np.maximum(bound, 0)) * (1 + 1e-12) + 1.01 * 10.0**-decimals) ** 2
                may = ~(near - error > reach[:, None])
                for i in range(len(p)):
                    row = np.flatnonzero(may[i])
                    # exact distances for those that can be among the nearest
                    d = np.round(np.sqrt(((x[row] - p[i]) ** 2).sum(axis=1)), decimals)
                    keep = np.lexsort((own[row], d))
                    keep = [j for j in keep if own[row[j]] != ids[lo + i]][:k]
                    q += [ids[lo + i]] * len(keep)
                    n += own[row[keep]].tolist()
                    dist += d[keep].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(n, pa.int64()), pa.array(dist, pa.float64())], names=["q", "neighbour", "dist"])

    return run


def nearest_rows(queries: DataFrame, pool: DataFrame, key: str, vector: str, k: int, decimals: int = 9) -> DataFrame:
    """(key, neighbour, dist, rank): the k nearest other pool rows of each query, by Euclidean distance rounded to ``decimals``, then id.

    Each task keeps the k nearest of its batch, so what is shuffled is k rows per query and batch. Rows at one distance
    are all compared by id, also where copies of one vector are more than k.
    Queries go out in blocks of QUERY_BLOCK. Rows with a null vector are nobody's neighbour.
    """
    q = queries.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("x"))
    n = q.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    rows = pool.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("x"))
    out = None
    for i in range(blocks):
        part = sorted(((r.id, r.x) for r in q.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).collect()), key=lambda r: r[0])
        points = np.array([p for _, p in part], dtype=np.float64).reshape(len(part), -1)
        found = rows.mapInArrow(_top([r for r, _ in part], points, k, decimals), "q bigint, neighbour bigint, dist double")
        out = found if out is None else out.unionByName(found)
    w = Window.partitionBy("q").orderBy("dist", "neighbour")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumnRenamed("q", key)


def near_mean(df: DataFrame, group: str, vector: str, threshold: float, low: int | None = None, high: int | None = None, least: int = 0) -> DataFrame:
    """Rows within a cosine distance of the mean vector of their group, of groups from ``low`` to ``high``; rows of other groups are dropped.

    A group in the range with at most ``least`` rows raises: its mean says too little.
    """
    rows = df.where(F.col(group).isNotNull() & F.col(vector).isNotNull())
    rows = rows if low is None else rows.where((F.col(group) >= low) & (F.col(group) <= high))
    sums = rows.select(F.col(group).alias("__g"), F.posexplode(vector).alias("i", "v")).groupBy("__g", "i").agg(F.avg("v").alias("a"), F.count(F.lit(1)).alias("n"))
    mean = sums.groupBy("__g").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "a"))), lambda s: s["a"]).alias("__m"), F.max("n").alias("__n"))
    ok = F.when(F.col("__n") > least, F.col("__m")).otherwise(F.raise_error(F.concat(F.lit("too few rows of "), F.col("__g").cast("string"))))
    return rows.join(mean.withColumn("__m", ok), F.col(group) == F.col("__g")).where(F.round(cosine_distance(F.col(vector), F.col("__m")), 6) <= threshold).drop("__g", "__m", "__n")
