"""Queries over ordered sequences, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partita import vocab as V
from partita.operators import sequences as S
from partita.plans.standins import EV, FRAMES, IV, RUNS, STEPS, chord_steps, events, frames, intervals

ORDER = ["us", "event_id"]
IORDER = ["s", "event_id"]
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {RUNS} SELECT user_id, label, CAST(min(i) - 1 AS INT) AS start_idx, count(*) AS run_len FROM num GROUP BY user_id, label, g")
def run_length(spark: SparkSession, d: str) -> DataFrame:
    return S.run_length(events(spark, d), "user_id", ORDER, "label")


@query(f"WITH {EV} SELECT user_id, label, CAST(row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS INT) AS idx FROM ev")
def run_length_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return S.run_decode(S.run_length(events(spark, d), "user_id", ORDER, "label"))


@query(f"""WITH {RUNS}, r AS (SELECT user_id, label, min(i) AS i, arg_min(us, i) AS s, arg_max(us, i) AS l FROM num GROUP BY user_id, label, g)
SELECT user_id, label, s AS start, coalesce(lead(s) OVER (PARTITION BY user_id ORDER BY i), l) AS "end" FROM r""")
def runs_to_intervals(spark: SparkSession, d: str) -> DataFrame:
    return S.runs_to_intervals(events(spark, d), "user_id", ORDER, "label", "us")


@query(f"""WITH {IV}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) AS i, row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) - row_number() OVER (PARTITION BY user_id, label ORDER BY s, event_id) AS g FROM iv)
SELECT user_id, label, arg_min(s, i) AS start, arg_max(e, i) AS "end" FROM n GROUP BY user_id, label, g""")
def compress_intervals(spark: SparkSession, d: str) -> DataFrame:
    return S.compress_intervals(intervals(events(spark, d)), "user_id", IORDER, "label", "s", "e")


@query(f"WITH {IV} SELECT label, CAST(sum(e - s) AS BIGINT) AS micros, round(CAST(sum(e - s) AS DOUBLE) / (SELECT sum(e - s) FROM iv), 9) AS share FROM iv GROUP BY label")
def label_durations(spark: SparkSession, d: str) -> DataFrame:
    """Total time per label, and its share of all."""
    g = intervals(events(spark, d)).groupBy("label").agg(F.sum(F.col("e") - F.col("s")).alias("micros"))
    return g.join(F.broadcast(g.agg(F.sum("micros").alias("__all")))).select("label", "micros", F.round(F.col("micros") / F.col("__all"), 9).alias("share"))


@query(f"WITH {IV}, n AS (SELECT *, lag(label) OVER (PARTITION BY user_id ORDER BY s, event_id) AS prev FROM iv) SELECT prev, label AS cur, CAST(sum(e - s) AS BIGINT) AS micros FROM n WHERE prev IS NOT NULL GROUP BY ALL")
def bigrams(spark: SparkSession, d: str) -> DataFrame:
    """Duration of the second element of each pair of successive labels."""
    n = S.ngrams(intervals(events(spark, d)), "user_id", IORDER, "label").where("prev is not null")
    return n.groupBy("prev", F.col("label").alias("cur")).agg(F.sum(F.col("e") - F.col("s")).alias("micros"))


_TRI = f"WITH {IV}, n AS (SELECT *, lag(label) OVER w AS prev, lead(label) OVER w AS nxt FROM iv WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id))"


@query(_TRI + " SELECT prev, label AS cur, nxt, CAST(sum(e - s) AS BIGINT) AS micros FROM n WHERE prev IS NOT NULL AND nxt IS NOT NULL GROUP BY ALL")
def trigrams(spark: SparkSession, d: str) -> DataFrame:
    n = S.ngrams(intervals(events(spark, d)), "user_id", IORDER, "label", 3).where("prev is not null and next is not null")
    return n.groupBy("prev", F.col("label").alias("cur"), F.col("next").alias("nxt")).agg(F.sum(F.col("e") - F.col("s")).alias("micros"))


@query(_TRI + " SELECT prev, nxt, CAST(sum(e - s) AS BIGINT) AS micros, list_sort(list(DISTINCT label)) AS labels FROM n WHERE prev IS NOT NULL AND nxt IS NOT NULL GROUP BY ALL")
def trigram_sets(spark: SparkSession, d: str) -> DataFrame:
    """Per pair of outer labels the time and the set of middle labels."""
    n = S.ngrams(intervals(events(spark, d)), "user_id", IORDER, "label", 3).where("prev is not null and next is not null")
    return n.groupBy("prev", F.col("next").alias("nxt")).agg(F.sum(F.col("e") - F.col("s")).alias("micros"), F.array_sort(F.collect_set("label")).alias("labels"))


@query(f"WITH {EV} SELECT user_id, event_id, coalesce(lag(label) OVER w, '<s>') AS prev, label AS cur, coalesce(lead(label) OVER w, '</s>') AS nxt FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)")
def ngram_edges(spark: SparkSession, d: str) -> DataFrame:
    """Trigrams with given start and end states at the edges."""
    n = S.ngrams(events(spark, d), "user_id", ORDER, "label", 3, F.lit("<s>"), F.lit("</s>"))
    return n.select("user_id", "event_id", "prev", F.col("label").alias("cur"), F.col("next").alias("nxt"))


@query(f"""WITH {STEPS}, p AS (SELECT idx AS a, lead(idx) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS b FROM st),
c AS (SELECT a // 12 AS q, CASE WHEN a = 156 OR b = 156 THEN b ELSE b // 12 * 12 + ((b - a % 12) % 12 + 12) % 12 END AS rel, count(*) AS n FROM p WHERE b IS NOT NULL GROUP BY ALL),
t AS (SELECT CAST(q * 12 + r AS INT) AS from_class, CAST(CASE WHEN rel = 156 THEN 156 ELSE rel // 12 * 12 + (rel % 12 + r) % 12 END AS INT) AS to_class, n FROM c CROSS JOIN (SELECT unnest(range(12)) AS r) WHERE q < 13)
SELECT from_class, to_class, n FROM t UNION ALL SELECT 156, to_class, n FROM t WHERE from_class = 155""")
def transitions_rotated(spark: SparkSession, d: str) -> DataFrame:
    """Class transitions counted relative to the root of the first class, turned to all roots; the row of N repeats row 155."""
    p = S.next_start(chord_steps(spark, d), "l_orderkey", ["l_linenumber", "l_partkey"], "idx", "b").where("b is not null")
    c = p.groupBy(F.floor(F.col("idx") / 12).cast("int").alias("q"), V.relative_class(F.col("idx"), F.col("b")).alias("rel")).agg(F.count(F.lit(1)).alias("n"))
    t = c.where("q < 13").withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(11))))
    t = t.select((F.col("q") * 12 + F.col("r")).alias("from_class"), F.when(F.col("rel") == 156, 156).otherwise(V.add_mod(F.col("rel"), F.col("r"))).cast("int").alias("to_class"), "n")
    return t.unionByName(t.where("from_class = 155").withColumn("from_class", F.lit(156)))


@query(f"""WITH {STEPS}, c AS (SELECT idx, count(*) AS n FROM st GROUP BY idx), a AS (SELECT CAST(unnest(range(157)) AS INT) AS idx),
b AS (SELECT a.idx, CASE WHEN a.idx = 156 THEN coalesce(n, 0) ELSE sum(coalesce(n, 0)) OVER (PARTITION BY a.idx // 12) END AS n FROM a LEFT JOIN c USING (idx))
SELECT idx, round(CAST(n AS DOUBLE) / (SELECT sum(n) FROM b), 9) AS prior FROM b""")
def class_prior(spark: SparkSession, d: str) -> DataFrame:
    """Prior of each of the 157 classes: every class of a quality gets the quality's sum; normalised."""
    counts = chord_steps(spark, d).where("idx is not null").groupBy("idx").agg(F.count(F.lit(1)).alias("n"))
    every = spark.range(157).select(F.col("id").cast("int").alias("idx"))
    block = F.sum("n").over(Window.partitionBy(F.floor(F.col("idx") / 12)))
    b = every.join(F.broadcast(counts), "idx", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("n", block)
    return b.join(F.broadcast(b.agg(F.sum("n").alias("__all")))).select("idx", F.round(F.col("n") / F.col("__all"), 9).alias("prior"))


@query(f"WITH {STEPS}, c AS (SELECT idx, count(*) AS n FROM st GROUP BY idx) SELECT i AS idx, coalesce(n, 0) AS n FROM (SELECT CAST(unnest(range((SELECT max(idx) + 1 FROM st))) AS INT) AS i) LEFT JOIN c ON idx = i")
def bin_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts of every integer from 0 to the largest, zeros included."""
    c = chord_steps(spark, d).groupBy("idx").agg(F.count(F.lit(1)).alias("n"))
    every = c.agg(F.max("idx").alias("m")).where("m is not null").select(F.explode(F.sequence(F.lit(0), F.col("m"))).alias("idx"))
    return every.join(c, "idx", "left").select("idx", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"WITH {RUNS}, r AS (SELECT user_id, min(i) AS i, count(*) AS n FROM num GROUP BY user_id, label, g) SELECT user_id, CAST(row_number() OVER w AS INT) AS boundary, CAST(sum(n) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS position FROM r WINDOW w AS (PARTITION BY user_id ORDER BY i)")
def run_boundaries(spark: SparkSession, d: str) -> DataFrame:
    """Cumulative sums of run lengths."""
    r = S.with_positions(S.run_length(events(spark, d), "user_id", ORDER, "label"), "user_id", ["start_idx"])
    # a run ends where its elements do, so the cumulative sum needs no window
    return r.select("user_id", (F.col("__at") + 1).cast("int").alias("boundary"), (F.col("start_idx") + F.col("run_len")).alias("position"))


@query(f"""WITH {EV}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS i FROM ev),
c AS (SELECT user_id, label, count(*) AS n, min(i) AS f FROM n GROUP BY ALL) SELECT user_id, label AS mode, n FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) = 1""")
def first_mode(spark: SparkSession, d: str) -> DataFrame:
    return S.first_mode(events(spark, d), "user_id", ORDER, "label")


@query(f"""WITH {FRAMES}, off AS (SELECT unnest(range(4)) AS o), c AS (SELECT track, frame FROM fr),
v AS (SELECT c.track, c.frame, o, list_transform(range(64), lambda k: coalesce(f.x[k + 1], 0.0)) AS x FROM c CROSS JOIN off LEFT JOIN fr f ON f.track = c.track AND f.frame = c.frame - 2 + o)
SELECT track, frame, list(x ORDER BY o) AS tile FROM v GROUP BY track, frame""")
def tile(spark: SparkSession, d: str) -> DataFrame:
    """Centred tiles of four frames, zero padded at both ends of a track."""
    return S.tiles(frames(spark, d), "track", ["frame"], "x", 4).select("track", "frame", "tile")


@query(f"WITH {FRAMES}, n AS (SELECT vec_id, x, unnest(range(CAST(floor((len(x) - (16 - 6)) / 6) AS BIGINT))) AS t FROM fr) SELECT vec_id, CAST(t AS INT) AS tile_no, x[t * 6 + 1 : t * 6 + 16] AS tile FROM n")
def fold_frames(spark: SparkSession, d: str) -> DataFrame:
    """Windows of sixteen values, six apart."""
    return S.hop_frames(frames(spark, d).select("vec_id", "x"), "x", 16, 6).select("vec_id", "tile_no", "tile")


@query(f"""WITH {EV}, n AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS i, round(value * 100) AS v FROM ev)
SELECT user_id, CAST(i AS INT) AS i, CAST(sum(v) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS walk, round(sum(v) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) / 5, 6) AS smooth FROM n""")
def walk_smooth(spark: SparkSession, d: str) -> DataFrame:
    """Cumulative steps, and a causal moving mean of width five with zeros before the start."""
    e = events(spark, d).withColumn("v", F.round(F.col("value") * 100)).select("user_id", *ORDER, "v")
    e = S.running_sum(e, "user_id", ORDER, F.col("v"), "walk")
    e = S.with_positions(S.moving_sum(e, "user_id", ORDER, F.col("v"), 4, 0, "near"), "user_id", ORDER)
    return e.select("user_id", (F.col("__at") + 1).cast("int").alias("i"), "walk", F.round(F.col("near") / 5, 6).alias("smooth"))
