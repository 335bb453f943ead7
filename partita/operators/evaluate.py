"""Duration-weighted scores of estimated against reference chord classes."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partita.session import broadcast_small, cut_lineage
from partita.vocab import NO_CHORD_INDEX, vocabulary, vocabulary_rows



class Side(NamedTuple):
    """A class and its row of the vocabulary, as columns: root and bits are -1 and zeros for N."""

    idx: Column
    root: Column
    quality: Column
    bits: Column
    chroma: Column


_FIELDS = ("root", "quality_idx", "bits", "chroma")


def _looked_up(idx: Column) -> Side:
    """Side of a class index by literal arrays, for single comparisons."""
    rows = vocabulary_rows()
    return Side(idx, *[F.element_at(F.array(*[F.lit(r[i]) for r in rows]), (idx + 1).cast("int")) for i in (2, 3, 5, 6)])


def _none(x: Side) -> Column:
    return x.idx == NO_CHORD_INDEX


def _same(lo: int, n: int) -> Callable[[Side, Side], Column]:
    """Roots and the given stretch of semitones above them agree."""
    return lambda r, e: (r.root == e.root) & (F.substring(r.bits, lo, n) == F.substring(e.bits, lo, n))


def _shared(r: Side, e: Side) -> Column:
    a, b = F.conv(r.chroma, 2, 10).cast("int"), F.conv(e.chroma, 2, 10).cast("int")
    return F.when(_none(r) | _none(e), r.idx == e.idx).otherwise(F.bit_count(a.bitwiseAND(b)) >= 3)


def _any(r: Side) -> Column:
    return F.lit(True)


#: metric -> (when equal, when the reference is in its gamut). A new metric is one entry.
COMPARISONS: dict[str, tuple[Callable[[Side, Side], Column], Callable[[Side], Column]]] = {
    "root": (lambda r, e: r.root == e.root, _any),
    "thirds": (_same(4, 2), _any),
    "triads": (_same(1, 8), _any),
    "tetrads": (_same(1, 12), _any),
    "majmin": (_same(1, 8), lambda r: _none(r) | F.substring(r.bits, 1, 8).isin("10001001", "10010001")),
    "sevenths": (_same(1, 12), lambda r: (r.quality < 5) | _none(r)),
    "mirex": (_shared, _any),
    "v157_strict": (lambda r, e: r.idx == e.idx, _any),
}


def _score(metric: str, r: Side, e: Side) -> Column:
    equal, known = COMPARISONS[metric]
    return F.when(r.idx.isNull() | ~known(r), F.lit(-1)).otherwise(F.coalesce(equal(r, e), F.lit(False)).cast("int"))


def compare(metric: str, ref: Column, est: Column) -> Column:
    """1 equal, 0 not, -1 where the reference is out of the metric's gamut; a null reference is, a null estimate is not equal."""
    return _score(metric, _looked_up(ref), _looked_up(est))


def with_scores(aligned: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """One row per aligned stretch and metric: adds metric and score. ``aligned`` has ref and est classes, looked up in the vocabulary of 157 rows."""
    voc = vocabulary(aligned.sparkSession)
    side = lambda p: F.broadcast(voc.select(F.col("idx").alias(f"__{p}"), *[F.col(f).alias(f"__{p}_{f}") for f in _FIELDS]))
    both = aligned.join(side("r"), F.col("ref") == F.col("__r"), "left").join(side("e"), F.col("est") == F.col("__e"), "left")
    r, e = [Side(F.col(c), *[F.col(f"__{p}_{f}") for f in _FIELDS]) for c, p in (("ref", "r"), ("est", "e"))]
    each = [F.struct(F.lit(m).alias("metric"), _score(m, r, e).alias("score")) for m in metrics or COMPARISONS]
    return both.withColumn("__m", F.explode(F.array(*each))).select(*aligned.columns, "__m.metric", "__m.score")


def pooled(aligned: DataFrame, key: str, weight: str) -> DataFrame:
    """(key, ref, est, weight): aligned stretches summed per pair of classes, before anything is scored. There are few pairs of classes."""
    return aligned.groupBy(key, "ref", "est").agg(F.sum(weight).alias(weight))


def pooled_scores(aligned: DataFrame, key: str, weight: str, metrics: list[str] | None = None) -> DataFrame:
    """with_scores() of pooled(): metrics are worked out once per pair of classes and joined to the sums."""
    # the sums are used twice: for the pairs that occur, and for the result
    sums = cut_lineage(pooled(aligned, key, weight))
    pairs = sums.select("ref", "est").distinct()
    table = with_scores(pairs, metrics).select(F.col("ref").alias("__r"), F.col("est").alias("__e"), "metric", "score")
    small = broadcast_small(table, pairs.count() * len(metrics or COMPARISONS))
    return sums.join(small, F.col("ref").eqNullSafe(F.col("__r")) & F.col("est").eqNullSafe(F.col("__e"))).drop("__r", "__e")


def track_scores(scored: DataFrame, key: str, weight: str) -> DataFrame:
    """(key, metric, score, support): weighted mean over the stretches in gamut; no support gives score 0."""
    ok = F.col("score") >= 0
    g = scored.groupBy(key, "metric").agg(F.sum(F.when(ok, F.col("score") * F.col(weight)).otherwise(0)).alias("hit"), F.sum(F.when(ok, F.col(weight)).otherwise(0)).alias("support"))
    return g.select(key, "metric", F.when(F.col("support") > 0, F.col("hit") / F.col("support")).otherwise(0.0).alias("score"), "support", "hit")


def tally(tracks: DataFrame) -> DataFrame:
    """(metric, macro, micro): plain mean over tracks, those without support counting 0, and mean by support."""
    s = F.sum("support")
    return tracks.groupBy("metric").agg(F.avg("score").alias("macro"), F.when(s > 0, F.sum("hit") / s).otherwise(0.0).alias("micro"))


def label_counts(scored: DataFrame, ref: str, est: str, weight: str) -> DataFrame:
    """(metric, ref, est, count, support) summed over all tracks; stretches out of gamut are skipped."""
    return scored.where("score >= 0").groupBy("metric", ref, est).agg(F.sum(F.col("score") * F.col(weight)).alias("count"), F.sum(weight).alias("support"))


def macro_by_label(counts: DataFrame, ref: str, min_support: float = 0) -> DataFrame:
    """(metric, ref, score, support) of every reference label with at least the given support, largest support first (of equals the smaller label)."""
    g = counts.groupBy("metric", ref).agg(F.sum("count").alias("count"), F.sum("support").alias("support")).where(F.col("support") >= min_support)
    return g.select("metric", ref, F.when(F.col("support") > 0, F.col("count") / F.col("support")).otherwise(0.0).alias("score"), "support").orderBy("metric", F.desc("support"), ref)


def mean_and_std(scores: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and population deviation over files, and both as text with three significant digits."""
    g = scores.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return g


def significant(x: Column, digits: int = 3) -> Column:
    """A number with so many significant digits, trailing zeros cut."""
    scale = F.when(x == 0, F.lit(0)).otherwise((F.lit(digits - 1) - F.floor(F.log10(F.abs(x)))).cast("int"))
    p = F.pow(F.lit(10.0), scale)
    return F.when(x == 0, F.lit(0.0)).otherwise(F.round(x * p, 0) / p)


def best_by_geometric_mean(scores: DataFrame, name: str, value: str, by: list[str] | None = None) -> DataFrame:
    """(name, geomean) of the best name; a zero score makes the mean 0, of equals the first in name order wins."""
    g = scores.groupBy(*(by or []), name).agg(F.when(F.min(value) <= 0, 0.0).otherwise(F.exp(F.avg(F.ln(F.when(F.col(value) > 0, F.col(value)))))).alias("geomean"))
    first = F.struct((-F.round("geomean", 12)).alias("m"), F.col(name))
    best = g.groupBy(*(by or [])).agg(F.min_by(F.struct(*g.columns), first).alias("b"))
    return best.where("b is not null").select("b.*")
