"""Queries of the evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partita import vocab as V
from partita.operators import evaluate as E
from partita.operators.intervals import align_filled
from partita.plans.join_queries import FILLED, WIDTH
from partita.plans.sqltext import VOC
from partita.plans.standins import ref_est

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Quality that stands in for each event type.
RANK = {"click": 0, "error": 1, "purchase": 2, "signup": 3, "view": 8}


def _class(label: str) -> F.Column:
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv]), F.col(label))
    return F.when(F.col(label) == "N", 156).otherwise(F.pmod(F.col("user_id"), F.lit(12)) + 12 * rank).cast("int")


def _aligned(spark: SparkSession, d: str) -> DataFrame:
    ref, est = ref_est(spark, d)
    a = align_filled(ref, est, "user_id", WIDTH)
    return a.select("user_id", (F.col("e") - F.col("s")).alias("micros"), _class("ref").alias("ref"), _class("est").alias("est"))


_CASE = "CASE {c} " + " ".join(f"WHEN '{k}' THEN {12 * v} + user_id % 12" for k, v in RANK.items()) + " ELSE 156 END"


def metric_sql(r: str, e: str) -> str:
    """(metric, score) pairs of two vocabulary rows as a list of structs."""
    same = lambda lo, n: f"{r}.root = {e}.root AND substr({r}.bits, {lo}, {n}) = substr({e}.bits, {lo}, {n})"
    shared = " + ".join(f"CASE WHEN substr({r}.chroma, {i}, 1) = '1' AND substr({e}.chroma, {i}, 1) = '1' THEN 1 ELSE 0 END" for i in range(1, 13))
    test = {
        "root": (f"{r}.root = {e}.root", "true"),
        "thirds": (same(4, 2), "true"),
        "triads": (same(1, 8), "true"),
        "tetrads": (same(1, 12), "true"),
        "majmin": (same(1, 8), f"({r}.idx = 156 OR substr({r}.bits, 1, 8) IN ('10001001', '10010001'))"),
        "sevenths": (same(1, 12), f"{r}.quality IN ('maj', 'min', 'maj7', 'min7', '7', '')"),
        "mirex": (f"CASE WHEN {r}.idx = 156 OR {e}.idx = 156 THEN {r}.idx = {e}.idx ELSE ({shared}) >= 3 END", "true"),
        "v157_strict": (f"{r}.idx = {e}.idx", "true"),
    }
    return "unnest([" + ", ".join(f"{{'metric': '{m}', 'score': CASE WHEN NOT {known} THEN -1 WHEN {eq} THEN 1 ELSE 0 END}}" for m, (eq, known) in test.items()) + "])"


_SCORED = f"""WITH {FILLED}, {VOC}, al AS (SELECT user_id, e - s AS micros, {_CASE.format(c='ref')} AS ref, {_CASE.format(c='est')} AS est FROM ov),
pr AS (SELECT user_id, ref, est, sum(micros) AS micros FROM al GROUP BY ALL),
sm AS (SELECT user_id, ref, est, micros, {metric_sql('a', 'b')} AS m FROM pr JOIN voc a ON a.idx = ref JOIN voc b ON b.idx = est),
sc AS (SELECT user_id, ref, est, micros, m.metric AS metric, m.score AS score FROM sm)"""


@query(_SCORED + """, tr AS (SELECT user_id, metric, CAST(sum(CASE WHEN score >= 0 THEN score * micros ELSE 0 END) AS DOUBLE) AS hit, CAST(sum(CASE WHEN score >= 0 THEN micros ELSE 0 END) AS DOUBLE) AS sup FROM sc GROUP BY ALL)
SELECT metric, round(avg(CASE WHEN sup > 0 THEN hit / sup ELSE 0 END), 9) AS macro, round(sum(hit) / sum(sup), 9) AS micro FROM tr GROUP BY metric""")
def score_micro_macro(spark: SparkSession, d: str) -> DataFrame:
    t = E.tally(E.track_scores(E.pooled_scores(_aligned(spark, d), "user_id", "micros"), "user_id", "micros"))
    return t.select("metric", F.round("macro", 9).alias("macro"), F.round("micro", 9).alias("micro"))


_REL = f""", rl AS (SELECT CASE WHEN ref = 156 THEN 156 ELSE ref // 12 * 12 END AS ref, CASE WHEN ref = 156 OR est = 156 THEN est ELSE est // 12 * 12 + ((est - ref % 12) % 12 + 12) % 12 END AS est, metric, score, micros FROM sc)"""


@query(_SCORED + _REL + " SELECT metric, CAST(ref AS INT) AS ref, CAST(est AS INT) AS est, CAST(sum(score * micros) AS BIGINT) AS count, CAST(sum(micros) AS BIGINT) AS support FROM rl WHERE score >= 0 GROUP BY metric, ref, est")
def label_confusion(spark: SparkSession, d: str) -> DataFrame:
    """Agreement per pair of classes, both seen from the reference's root."""
    s = E.pooled_scores(_aligned(spark, d), "user_id", "micros")
    s = s.withColumns({"est": V.relative_class(F.col("ref"), F.col("est")), "ref": V.relative_class(F.col("ref"), F.col("ref"))})
    return E.label_counts(s, "ref", "est", "micros")


@query(_SCORED + _REL + " SELECT metric, CAST(ref AS INT) AS ref, round(CAST(sum(score * micros) AS DOUBLE) / sum(micros), 9) AS score, CAST(sum(micros) AS BIGINT) AS support FROM rl WHERE score >= 0 GROUP BY metric, ref HAVING sum(micros) >= 60000000")
def macro_by_label(spark: SparkSession, d: str) -> DataFrame:
    m = E.macro_by_label(label_confusion(spark, d), "ref", 60_000_000)
    return m.select("metric", "ref", F.round("score", 9).alias("score"), "support")


@query(_SCORED + _REL + ", lb AS (SELECT metric, ref, CAST(sum(score * micros) AS DOUBLE) / sum(micros) AS s FROM rl WHERE score >= 0 GROUP BY metric, ref) SELECT metric, round(avg(s), 9) AS macro_quality FROM lb GROUP BY metric")
def macro_quality(spark: SparkSession, d: str) -> DataFrame:
    """Plain mean of the label scores."""
    return E.macro_by_label(label_confusion(spark, d), "ref").groupBy("metric").agg(F.round(F.avg("score"), 9).alias("macro_quality"))


_FOLD = _SCORED + ", fs AS (SELECT user_id % 5 AS fold, metric, CAST(sum(score * micros) AS DOUBLE) / sum(micros) AS score FROM sc WHERE score >= 0 GROUP BY 1, 2)"


def _fold_scores(spark: SparkSession, d: str) -> DataFrame:
    s = E.pooled_scores(_aligned(spark, d), "user_id", "micros").where("score >= 0")
    return s.groupBy(F.pmod("user_id", F.lit(5)).alias("fold"), "metric").agg((F.sum(F.col("score") * F.col("micros")) / F.sum("micros")).alias("score"))


@query(_FOLD + " SELECT metric, round(avg(score), 9) AS mean, round(stddev_pop(score), 9) AS std FROM fs GROUP BY metric")
def score_average_std(spark: SparkSession, d: str) -> DataFrame:
    """Mean and population deviation of each metric over five folds."""
    return E.mean_and_std(_fold_scores(spark, d), ["metric"], "score").select("metric", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"))


@query(_FOLD + ", g AS (SELECT fold, CASE WHEN min(score) <= 0 THEN 0 ELSE exp(avg(ln(score))) END AS geomean FROM fs GROUP BY fold) SELECT fold, round(geomean, 9) AS geomean FROM g QUALIFY row_number() OVER (ORDER BY round(geomean, 12) DESC, fold) = 1")
def best_by_geomean(spark: SparkSession, d: str) -> DataFrame:
    b = E.best_by_geometric_mean(_fold_scores(spark, d), "fold", "score")
    return b.select("fold", F.round("geomean", 9).alias("geomean"))


@query(f"WITH {VOC}, p AS (SELECT a.idx AS ref, b.idx AS est, {metric_sql('a', 'b')} AS m FROM voc a JOIN voc b ON true) SELECT ref, est, m.metric AS metric, m.score AS score FROM p")
def compare_labels(spark: SparkSession, d: str) -> DataFrame:
    """All metrics over all pairs of the 157 classes."""
    pairs = spark.range(157 * 157).select(F.expr("cast(id div 157 as int)").alias("ref"), F.expr("cast(id % 157 as int)").alias("est"))
    return E.with_scores(pairs)
