"""Queries of the joins, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partita.functions.paths import glob_to_regex
from partita.operators import intervals as I
from partita.operators.sequences import with_positions
from partita.operators.vectors import nearest_rows
from partita.plans.standins import EV, FRAMES, IV, RE, events, frames, intervals, ref_est
from partita.session import table

#: Bucket width for event times: six hours of microseconds.
WIDTH = 6 * 3_600_000_000
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


OVERLAP = RE + ", ov AS (SELECT ref.user_id, greatest(ref.s, est.s) AS s, least(ref.e, est.e) AS e, ref.label AS ref, est.label AS est FROM ref JOIN est ON ref.user_id = est.user_id AND ref.s < est.e AND est.s < ref.e)"
FILLED = RE + """, span AS (SELECT user_id, min(s) AS lo, max(e) AS hi FROM ref GROUP BY 1), reach AS (SELECT user_id, min(s) AS f, max(e) AS l FROM est GROUP BY 1),
pad AS (SELECT user_id, s, e, label FROM est UNION ALL SELECT user_id, lo, coalesce(least(f, hi), hi), 'N' FROM span LEFT JOIN reach USING (user_id) WHERE f IS NULL OR f > lo
UNION ALL SELECT user_id, greatest(l, lo), hi, 'N' FROM span JOIN reach USING (user_id) WHERE l < hi),
ov AS (SELECT ref.user_id, greatest(ref.s, p.s) AS s, least(ref.e, p.e) AS e, ref.label AS ref, p.label AS est FROM ref JOIN pad p ON ref.user_id = p.user_id AND ref.s < p.e AND p.s < ref.e)"""


@query(f'WITH {OVERLAP} SELECT user_id, s AS start, e AS "end", ref, est FROM ov')
def interval_overlap(spark: SparkSession, d: str) -> DataFrame:
    ref, est = ref_est(spark, d)
    return I.overlap_join(ref, est, "user_id", WIDTH).select("user_id", F.col("s").alias("start"), F.col("e").alias("end"), "ref", "est")


@query(f'WITH {FILLED} SELECT user_id, s AS start, e AS "end", ref, est FROM ov')
def interval_overlap_filled(spark: SparkSession, d: str) -> DataFrame:
    ref, est = ref_est(spark, d)
    return I.align_filled(ref, est, "user_id", WIDTH).select("user_id", F.col("s").alias("start"), F.col("e").alias("end"), "ref", "est")


@query(f"WITH {RE} SELECT p.user_id, p.event_id, coalesce((SELECT max(ref.label) FROM ref WHERE ref.user_id = p.user_id AND ref.s <= p.us AND p.us < ref.e), 'N') AS label FROM ev p WHERE p.event_id % 2 = 1")
def asof_label(spark: SparkSession, d: str) -> DataFrame:
    """Odd events labelled by the even interval that holds them."""
    e = events(spark, d)
    return I.asof_label(e.where("event_id % 2 = 1").select("user_id", "event_id", "us"), intervals(e.where("event_id % 2 = 0")), "user_id", "us", WIDTH).select("user_id", "event_id", "label")


STEP = 3_600_000_000


@query(f"""WITH {IV}, sp AS (SELECT user_id, min(s) AS lo, max(e) AS hi FROM iv GROUP BY 1), tk AS (SELECT user_id, lo, unnest(range((hi - lo - 1) // {STEP} + 1)) AS tick FROM sp WHERE hi > lo),
pt AS (SELECT user_id, tick, lo + tick * {STEP} AS t FROM tk) SELECT pt.user_id, pt.tick, CASE WHEN pt.t < iv.e THEN iv.label ELSE 'N' END AS label FROM pt ASOF LEFT JOIN (SELECT * FROM iv WHERE s < e) iv ON pt.user_id = iv.user_id AND pt.t >= iv.s""")
def interval_to_grid(spark: SparkSession, d: str) -> DataFrame:
    """Every user's labels sampled hourly."""
    return I.to_grid(intervals(events(spark, d)).where("s < e"), "user_id", STEP, WIDTH).select("user_id", "tick", "label")


@query("""WITH u AS (SELECT p_retailprice AS v, min(p_partkey) AS id FROM part GROUP BY 1)
SELECT s_suppkey, (SELECT arg_min(id, (abs(v - s_acctbal), v)) FROM u) AS nearest FROM supplier""")
def nearest_value(spark: SparkSession, d: str) -> DataFrame:
    """The part whose price is nearest to each supplier's balance."""
    return I.nearest_value(table(spark, d, "supplier"), table(spark, d, "part"), "s_suppkey", "s_acctbal", "p_partkey", "p_retailprice")


@query("""WITH q AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE vec_id % 20 = 0), p AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)
SELECT q.vec_id, arg_min(p.vec_id, (round(list_distance(q.x, p.x), 9), p.vec_id)) AS nearest FROM q JOIN p ON q.vec_id <> p.vec_id GROUP BY q.vec_id""")
def nearest_vector(spark: SparkSession, d: str) -> DataFrame:
    """For every twentieth vector the nearest other one, against all."""
    v = frames(spark, d).select("vec_id", "x")
    near = nearest_rows(v.where("vec_id % 20 = 0"), v, "vec_id", "x", 1)
    return near.select("vec_id", F.col("neighbour").alias("nearest"))


@query("""SELECT c.c_custkey AS id, list_sort(list(o.o_orderkey)) AS local_keys FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1
UNION ALL SELECT -o_custkey, list_sort(list(o_orderkey)) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) GROUP BY 1""")
def catalogue_merge(spark: SparkSession, d: str) -> DataFrame:
    """Keys of the second catalogue take the record of the first where it has one, else their own; regrouped by record id."""
    primary = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_custkey").alias("id"))
    both = table(spark, d, "orders").select("o_custkey", "o_orderkey").join(primary, "o_custkey", "left")
    return both.groupBy(F.coalesce("id", -F.col("o_custkey")).alias("id")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("local_keys"))


@query(f"WITH {RE} SELECT ref.user_id, ref.event_id AS ref_id, est.event_id AS est_id FROM ref JOIN est ON ref.user_id = est.user_id AND ref.s < est.e AND est.s < ref.e WHERE ref.label LIKE 'p%' AND est.label LIKE '%ck'")
def pair_by_pattern(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping pairs of a user whose labels match the globs p* and *ck; patterns are applied before the join."""
    ref, est = ref_est(spark, d)
    r = ref.where(F.col("label").rlike(glob_to_regex("p*"))).withColumn("label", F.col("event_id").cast("string"))
    x = est.where(F.col("label").rlike(glob_to_regex("*ck"))).withColumn("label", F.col("event_id").cast("string"))
    return I.overlap_join(r, x, "user_id", WIDTH).select("user_id", F.col("ref").cast("bigint").alias("ref_id"), F.col("est").cast("bigint").alias("est_id"))


@query(f"WITH {EV}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS i FROM ev) SELECT user_id, label, list_sort(list(CAST(i AS INT))) AS positions FROM n WHERE label IN ('click', 'purchase') GROUP BY ALL")
def partition_index(spark: SparkSession, d: str) -> DataFrame:
    """Positions of the wanted labels per user; users without any are left out."""
    n = with_positions(events(spark, d), "user_id", ["us", "event_id"]).where(F.col("label").isin("click", "purchase"))
    return n.groupBy("user_id", "label").agg(F.array_sort(F.collect_list(F.col("__at").cast("int"))).alias("positions"))


@query("SELECT k.key, coalesce(m.artist, '') AS artist, coalesce(m.title, '') AS title FROM (SELECT DISTINCT key FROM chord_entities) k LEFT JOIN (SELECT key, min(artist) AS artist, min(title) AS title FROM tracks GROUP BY key) m ON k.key = m.key")
def metadata_default(spark: SparkSession, d: str) -> DataFrame:
    """Every entity with its metadata, or empty defaults."""
    meta = table(spark, d, "tracks").groupBy("key").agg(F.min("artist").alias("artist"), F.min("title").alias("title"))
    return table(spark, d, "chord_entities").select("key").distinct().join(meta, "key", "left").na.fill("", ["artist", "title"])


@query("WITH w AS (SELECT DISTINCT lang FROM documents WHERE source IS NULL) SELECT doc_id, EXISTS (SELECT 1 FROM w WHERE w.lang IS NOT DISTINCT FROM d.lang) AS member FROM documents d")
def membership_null(spark: SparkSession, d: str) -> DataFrame:
    """Whether a document's language is one of those of the documents without source; null equals null."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    wanted = docs.where("source is null").select(F.col("lang").alias("w"), F.lit(True).alias("hit")).distinct()
    return docs.join(wanted, docs["lang"].eqNullSafe(wanted["w"]), "left").select("doc_id", F.coalesce("hit", F.lit(False)).alias("member"))


@query("SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT event_id FROM events WHERE event_type = 'click')")
def pending_minus_done(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "events").where("event_type = 'click'").select(F.col("event_id").alias("vec_id"))
    return table(spark, d, "embeddings").select("vec_id").join(done, "vec_id", "left_anti")


@query("SELECT DISTINCT CAST((l_partkey * 7 + l_linenumber) % 157 AS INT) AS idx FROM lineitem WHERE (l_partkey * 7 + l_linenumber) % 157 <> 156")
def classes_without_rest(spark: SparkSession, d: str) -> DataFrame:
    """Distinct classes without the no-chord class."""
    idx = table(spark, d, "lineitem").select(F.expr("cast((l_partkey * 7 + l_linenumber) % 157 as int)").alias("idx"))
    return idx.where("idx is not null").distinct().exceptAll(spark.range(156, 157).select(F.col("id").cast("int").alias("idx")))


@query(f"""WITH {FRAMES}, c AS (SELECT *, CASE WHEN lag(label) OVER (PARTITION BY track ORDER BY frame) IS NOT DISTINCT FROM label THEN 0 ELSE 1 END AS n FROM fr),
g AS (SELECT *, sum(n) OVER (PARTITION BY track ORDER BY frame ROWS UNBOUNDED PRECEDING) AS k FROM c),
p AS (SELECT track, k, CAST(min(frame) AS INT) AS lo, round(avg(x[1]), 9) AS mean, round(median(x[1]), 9) AS median, round(max(x[1]), 9) AS max FROM g GROUP BY track, k),
m AS (SELECT track, k, x[1] AS v FROM g GROUP BY track, k, x[1] QUALIFY row_number() OVER (PARTITION BY track, k ORDER BY count(*) DESC, x[1]) = 1)
SELECT track, lo, mean, median, max, round(v, 9) AS mode FROM p JOIN m USING (track, k)""")
def segment_pool(spark: SparkSession, d: str) -> DataFrame:
    """First bin pooled over the runs of equal labels of a track."""
    from partita.operators.sequences import run_length

    f = frames(spark, d).withColumn("v", F.try_element_at("x", F.lit(1)))
    runs = run_length(f, "track", ["frame"], "label").select("track", F.col("start_idx").alias("segment"), F.col("start_idx").alias("lo"), (F.col("start_idx") + F.col("run_len")).cast("int").alias("hi"))
    p = I.boundary_pool(f, runs, "track", "frame", "v")
    return p.select("track", F.col("segment").alias("lo"), *[F.round(c, 9).alias(c) for c in ("mean", "median", "max", "mode")])
