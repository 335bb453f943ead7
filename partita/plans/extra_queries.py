"""Queries of importing, augmentation, walks, training and streaming, with SQL where it can say the same."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partita import vocab as V
from partita.functions import arrays as A
from partita.operators import intervals as I
from partita.operators import models as M
from partita.operators.evaluate import significant
from partita.operators.sampling import md5_key
from partita.operators.vectors import nearest_rows
from partita.plans import score_queries as SC
from partita.plans.join_queries import STEP, WIDTH
from partita.plans.model_queries import _vote_sql
from partita.plans.sqltext import VOC
from partita.plans.standins import FRAMES, IV, events, frames, intervals
from partita.session import cut_lineage, ensure_checkpoint_dir, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_ANN = """iv AS (SELECT key, annotator, unnest(intervals) AS v FROM range_annotations),
ms AS (SELECT key, annotator, CAST(round(v.start * 1000) AS BIGINT) AS s, CAST(round(v."end" * 1000) AS BIGINT) AS e, v.label AS label FROM iv WHERE v.start IS NOT NULL AND v."end" IS NOT NULL AND v.label IS NOT NULL),
pt AS (SELECT DISTINCT key, frame, CAST(round(time_point * 1000) AS BIGINT) AS t FROM chord_frames WHERE time_point IS NOT NULL)"""


def _annotation(spark: SparkSession, d: str, *by: str) -> DataFrame:
    ms = lambda c: F.round(c * 1000).cast("bigint")
    iv = table(spark, d, "range_annotations").select("key", "annotator", F.explode("intervals").alias("v")).select("key", "annotator", ms(F.col("v.start")).alias("s"), ms(F.col("v.end")).alias("e"), F.col("v.label").alias("label"))
    ok = iv.where("e > s and label is not null")
    return ok.groupBy(*by, "s").agg(F.max(F.struct("e", "label")).alias("m")).select(*by, "s", "m.e", "m.label")


def _points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chord_frames").where("time_point is not null").select("key", "frame", F.round(F.col("time_point") * 1000).cast("bigint").alias("t")).distinct()


def _holding(name: str, condition: str) -> str:
    """The interval begun last (then the longest, then the larger label) of those that hold a point, as a range join."""
    return f"""{name} AS (SELECT pt.key, pt.frame, pt.t, coalesce(o.label, 'N') AS l FROM pt LEFT JOIN (SELECT * FROM ms WHERE e > s AND {condition}) o ON pt.key = o.key AND pt.t >= o.s AND pt.t < o.e
QUALIFY row_number() OVER (PARTITION BY pt.key, pt.frame, pt.t ORDER BY o.s DESC, o.e DESC, o.label DESC) = 1)"""


@query(f"WITH {_ANN}, {_holding('h', 'true')} SELECT key, frame, t, l AS label FROM h")
def import_labels(spark: SparkSession, d: str) -> DataFrame:
    """Every frame with the label of the annotation interval begun last of those that hold it, N where none does."""
    return I.held_label(_points(spark, d), _annotation(spark, d, "key"), "key", "t", 60_000)


@query(f"""WITH {_ANN}, {_holding('a', "annotator = 'ann_a'")}, {_holding('b', "annotator = 'ann_b'")} SELECT key, frame, t, a.l AS first, b.l AS second FROM a JOIN b USING (key, frame, t)""")
def import_two_annotators(spark: SparkSession, d: str) -> DataFrame:
    """Every frame with the labels of two annotators side by side."""
    ann = _annotation(spark, d, "key", "annotator")
    points = _points(spark, d)
    one = I.held_label(points, ann.where("annotator = 'ann_a'").drop("annotator"), "key", "t", 60_000).withColumnRenamed("label", "first")
    return I.held_label(one, ann.where("annotator = 'ann_b'").drop("annotator"), "key", "t", 60_000).withColumnRenamed("label", "second")


_RANK = "CASE label " + " ".join(f"WHEN '{k}' THEN {12 * v} + sp.user_id % 12" for k, v in SC.RANK.items()) + " ELSE 156 END"


@query(f"""WITH {IV}, {VOC}, sp AS (SELECT user_id, min(s) AS lo, max(e) AS hi FROM iv GROUP BY 1), tk AS (SELECT user_id, lo, unnest(range((hi - lo - 1) // {STEP * 24} + 1)) AS tick FROM sp WHERE hi > lo),
pt AS (SELECT user_id, tick, lo + tick * {STEP * 24} AS t FROM tk), lb AS (SELECT sp.user_id, sp.tick, CAST(CASE WHEN sp.t < iv.e THEN {_RANK} ELSE 156 END AS INT) AS idx FROM pt sp ASOF LEFT JOIN (SELECT * FROM iv WHERE s < e) iv ON sp.user_id = iv.user_id AND sp.t >= iv.s)
SELECT user_id, tick, lb.idx, chroma FROM lb JOIN voc ON voc.idx = lb.idx""")
def ideal_chroma(spark: SparkSession, d: str) -> DataFrame:
    """Chroma of the label that holds, once a day; zeros where there is none."""
    g = I.to_grid(intervals(events(spark, d)).where("s < e"), "user_id", STEP * 24, WIDTH)
    return g.select("user_id", "tick", SC._class("label").alias("idx")).withColumn("chroma", V.class_chroma(F.col("idx")))


_SHIFT = "CAST(CAST('0x' || substr(md5(CAST(vec_id AS VARCHAR) || '|4'), 1, 8) AS BIGINT) % 12 - 6 AS INT)"


@query(f"""WITH {FRAMES}, s AS (SELECT vec_id, x[1:60] AS x, CAST(vec_id * 7 % 157 AS INT) AS idx, {_SHIFT} AS k FROM fr)
SELECT vec_id, k, CAST(CASE WHEN idx = 156 THEN 156 ELSE idx // 12 * 12 + ((idx % 12 + k) % 12 + 12) % 12 END AS INT) AS moved, list_transform(range(60), lambda i: CASE WHEN i - k BETWEEN 0 AND 59 THEN x[i - k + 1] ELSE 0.0 END) AS shifted,
list_transform(range(12), lambda i: x[((i - k) % 12 + 12) % 12 + 1]) AS turned FROM s""")
def augment_pitch_shift(spark: SparkSession, d: str) -> DataFrame:
    """A hash-derived shift in [-6, 6): bins move with fill, chroma turns, the class moves along."""
    k = (F.conv(F.substring(md5_key(F.col("vec_id"), 4), 1, 8), 16, 10).cast("bigint") % 12 - 6).cast("int")
    f = frames(spark, d).select("vec_id", F.slice("x", 1, 60).alias("x"), F.expr("cast(vec_id * 7 % 157 as int)").alias("idx"), k.alias("k"))
    at = lambda i: F.get("x", (i - F.col("k")).cast("int"))
    shifted = F.transform(F.sequence(F.lit(0), F.lit(59)), lambda i: F.coalesce(F.when((i - F.col("k") >= 0), at(i)), F.lit(0.0)))
    moved = F.when(F.col("idx") == 156, 156).otherwise(V.add_mod(F.col("idx"), F.col("k")))
    return f.select("vec_id", "k", moved.cast("int").alias("moved"), shifted.alias("shifted"), A.circshift(F.slice("x", 1, 12), F.col("k")).alias("turned"))


@query(f"WITH {FRAMES} SELECT vec_id, list_transform(range(12), lambda i: x[(i + (vec_id * 7 % 157) % 12) % 12 + 1]) AS chroma FROM fr WHERE vec_id * 7 % 157 <> 156")
def rotate_to_root(spark: SparkSession, d: str) -> DataFrame:
    """Chroma turned so that the class's root comes first."""
    f = frames(spark, d).withColumn("idx", F.expr("vec_id * 7 % 157")).where("idx <> 156")
    return f.select("vec_id", V.rotate(F.slice("x", 1, 12), (-(F.col("idx") % 12)).cast("int")).alias("chroma"))


_SIG = "CASE WHEN {x} = 0 THEN 0.0 ELSE round({x} * pow(10.0, 2 - floor(log10(abs({x}))))) / pow(10.0, 2 - floor(log10(abs({x})))) END"


@query(SC._FOLD + f", m AS (SELECT metric, avg(score) AS a, stddev_pop(score) AS s FROM fs GROUP BY metric) SELECT metric, round({_SIG.format(x='a')}, 9) AS mean, round({_SIG.format(x='s')}, 9) AS std FROM m")
def score_format(spark: SparkSession, d: str) -> DataFrame:
    """Means and deviations over folds with three significant digits."""
    from partita.operators.evaluate import mean_and_std

    m = mean_and_std(SC._fold_scores(spark, d), ["metric"], "score")
    return m.select("metric", F.round(significant(F.col("mean")), 9).alias("mean"), F.round(significant(F.col("std")), 9).alias("std"))


@query(_vote_sql([9]).replace("b AS (SELECT", "shares AS (SELECT vec_id, label, n / 9.0 AS share FROM v), b AS (SELECT") + """, qq AS (SELECT vec_id, label AS truth FROM embeddings WHERE vec_id % 20 = 0), cl AS (SELECT DISTINCT label FROM embeddings),
p AS (SELECT coalesce(s.share, 0) AS share, CASE WHEN qq.truth = cl.label THEN 1 ELSE 0 END AS y FROM qq CROSS JOIN cl LEFT JOIN shares s ON s.vec_id = qq.vec_id AND s.label = cl.label),
t AS (SELECT round(share, 9) AS share, sum(y) AS tp, count(*) AS n FROM p GROUP BY 1), c AS (SELECT share, sum(tp) OVER (ORDER BY share DESC) AS ctp, sum(n) OVER (ORDER BY share DESC) AS cn, sum(tp) OVER () AS pos FROM t)
SELECT share AS threshold, round(ctp / CAST(cn AS DOUBLE), 9) AS precision, round(ctp / CAST(pos AS DOUBLE), 9) AS recall FROM c""")
def precision_recall(spark: SparkSession, d: str) -> DataFrame:
    """Micro-averaged precision and recall of the votes of nine neighbours at every threshold."""
    v = frames(spark, d).select("vec_id", "x", "label")
    q = v.where("vec_id % 20 = 0")
    near = nearest_rows(q, v, "vec_id", "x", 9).join(v.select(F.col("vec_id").alias("neighbour"), "label"), "neighbour")
    share = near.groupBy("vec_id", "label").agg((F.count(F.lit(1)) / 9).alias("share"))
    classes = v.select("label").distinct()
    every = q.select("vec_id", F.col("label").alias("truth")).join(F.broadcast(classes)).join(share, ["vec_id", "label"], "left")
    y = (F.col("truth") == F.col("label")).cast("int")
    t = every.groupBy(F.round(F.coalesce("share", F.lit(0.0)), 9).alias("threshold")).agg(F.sum(y).alias("tp"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc("threshold"))
    c = t.select("threshold", F.sum("tp").over(w).alias("ctp"), F.sum("n").over(w).alias("cn"), F.sum("tp").over(Window.partitionBy(F.lit(1))).alias("pos"))
    return c.select("threshold", F.round(F.col("ctp") / F.col("cn"), 9).alias("precision"), F.round(F.col("ctp") / F.col("pos"), 9).alias("recall"))


@query(f"""WITH RECURSIVE {FRAMES}, q AS (SELECT vec_id, x FROM fr WHERE vec_id % 20 = 0),
nn AS (SELECT a.vec_id, b.vec_id AS neighbour, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_distance(a.x, b.x), 9), b.vec_id) AS rank FROM fr a JOIN fr b ON a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_distance(a.x, b.x), 9), b.vec_id) <= 3),
w AS (SELECT vec_id AS start, 0 AS step, vec_id AS node FROM q UNION ALL SELECT w.start, w.step + 1, nn.neighbour FROM w JOIN nn ON nn.vec_id = w.node AND nn.rank = CAST('0x' || substr(md5(CAST(w.start AS VARCHAR) || '|' || CAST(w.step AS VARCHAR) || '|2'), 1, 8) AS BIGINT) % 3 + 1 WHERE w.step < 6)
SELECT start, CAST(step AS INT) AS step, node FROM w""")
def neighbour_walks(spark: SparkSession, d: str) -> DataFrame:
    """Six steps over the three nearest of all vectors from every twentieth vector, all walks at once: a step searches the nodes the walks have reached against the whole pool."""
    pool = frames(spark, d).select("vec_id", "x")
    step = pool.where("vec_id % 20 = 0").select(F.col("vec_id").alias("start"), F.lit(0).alias("step"), F.col("vec_id").alias("node"))
    out = step
    for i in range(6):
        pick = (F.conv(F.substring(md5_key(F.col("start"), F.lit(i), 2), 1, 8), 16, 10).cast("bigint") % 3 + 1).cast("int")
        at = pool.join(step.select(F.col("node").alias("vec_id")).distinct(), "vec_id")
        near = nearest_rows(at, pool, "vec_id", "x", 3).select(F.col("vec_id").alias("node"), "neighbour", "rank")
        step = cut_lineage(step.withColumn("rank", pick).join(near, ["node", "rank"]).select("start", F.lit(i + 1).alias("step"), F.col("neighbour").alias("node")))
        out = out.unionByName(step)
    return out


@query("SELECT max(key) AS last_key FROM tracks")
def last_by_name(spark: SparkSession, d: str) -> DataFrame:
    """The last name, as for the latest checkpoint."""
    return table(spark, d, "tracks").agg(F.max("key").alias("last_key"))


@query()
def train_logistic(spark: SparkSession, d: str) -> DataFrame:
    """Classes predicted by a logistic regression trained on the other vectors."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    v = frames(spark, d).select("vec_id", array_to_vector("x").alias("features"), F.col("label").cast("double").alias("label"))
    model = LogisticRegression(maxIter=20, regParam=0.01).fit(v.where("vec_id % 5 <> 0"))
    return model.transform(v.where("vec_id % 5 = 0")).select("vec_id", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("predicted"))


@query()
def sample_bias(spark: SparkSession, d: str) -> DataFrame:
    """Precision and recall of a Bayes threshold on points of two classes, one nine times as frequent, with and without the prior."""
    points = table(spark, d, "orders").select((F.col("o_orderkey") % 10 == 0).cast("int").alias("y"), F.randn(13).alias("z")).withColumn("x", F.col("z") + 2 * F.col("y"))
    each = points.withColumn("rule", F.explode(F.array(F.lit("plain"), F.lit("prior")))).withColumn("p", (F.col("x") > F.when(F.col("rule") == "plain", 1.0).otherwise(1.0 + F.ln(F.lit(9.0)) / 2)).cast("int"))
    hit = F.sum(F.col("y") * F.col("p"))
    return each.groupBy("rule").agg((hit / F.sum("p")).alias("precision"), (hit / F.sum("y")).alias("recall"))


@query()
def network_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Mean posterior of the first class for every network in the registry, over every tile of all tracks."""
    from partita.operators import sequences as S

    f = frames(spark, d).withColumn("x", F.slice(F.concat("x", "x", "x", "x"), 1, 96))
    tiles = S.tiles(f, "track", ["frame"], "x", 8).select("track", "frame", F.flatten("tile").alias("x"))
    out = None
    for name in M.MODELS:
        y = M.apply_network(tiles, "x", (1, 8, 96), M.MODELS[name](frames=8, bins=96), "y").select(F.lit(name).alias("model"), F.size("y").alias("outputs"), F.get("y", F.lit(0)).alias("first"))
        out = y if out is None else out.unionByName(y)
    return out.groupBy("model", "outputs").agg(F.avg("first").alias("mean_first"), F.count(F.lit(1)).alias("n"))


@query("""WITH e AS (SELECT *, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM events),
r AS (SELECT user_id, event_type, min(us) AS s, max(us) AS z, count(*) AS n FROM e GROUP BY user_id, event_type, g)
SELECT CAST(user_id AS VARCHAR) AS key, event_type AS label, s AS start_us, lead(s) OVER (PARTITION BY user_id ORDER BY s) AS end_us, n AS run_len FROM r QUALIFY lead(s) OVER (PARTITION BY user_id ORDER BY s) IS NOT NULL""")
def stream_runs(spark: SparkSession, d: str) -> DataFrame:
    """Closed runs of labels, read from a stream of files to its end; what is still open at the end is not in it."""
    from partita.streaming.runs import stream_runs as runs

    ensure_checkpoint_dir(spark)
    base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    place = f"{base}/stream_runs_{os.urandom(6).hex()}"
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))
    q = runs(stream, "user_id", "event_id", "ts", "event_type").writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{place}/out").where("closed").drop("closed")
