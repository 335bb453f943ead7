"""Queries of the array functions, decoding and sampling, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partita.functions import arrays as A
from partita.functions import tabs as T
from partita.operators import decode as D
from partita.operators import sampling as P
from partita.plans.standins import EV, FRAMES, events, frames
from partita.session import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _rounded(a: F.Column, n: int = 9) -> F.Column:
    return F.transform(a, lambda x: F.round(x, n) + 0.0)


_R = "list_transform({a}, lambda y: round(y, 9) + 0.0)"


@query(f"WITH {FRAMES}, e AS (SELECT vec_id, list_transform(x, lambda y: abs(y)) AS a FROM fr) SELECT vec_id, {_R.format(a='list_transform(a, lambda y: y / list_sum(a))')} AS v FROM e")
def normalize_vec(spark: SparkSession, d: str) -> DataFrame:
    return frames(spark, d).select("vec_id", _rounded(A.normalize(F.transform("x", F.abs))).alias("v"))


@query(f"WITH {FRAMES} SELECT vec_id, {_R.format(a='list_transform(x, lambda y: y / sqrt(list_sum(list_transform(x, lambda z: z * z))))')} AS v FROM fr")
def lp_norm(spark: SparkSession, d: str) -> DataFrame:
    return frames(spark, d).select("vec_id", _rounded(A.lp_scale(F.col("x"))).alias("v"))


@query(f"WITH {FRAMES}, e AS (SELECT vec_id, list_transform(x[1:8], lambda y: exp(-2.0 * y)) AS a FROM fr) SELECT vec_id, {_R.format(a='list_transform(a, lambda y: y / list_sum(a))')} AS v FROM e")
def gibbs(spark: SparkSession, d: str) -> DataFrame:
    return frames(spark, d).select("vec_id", _rounded(A.gibbs(F.slice("x", 1, 8), 2.0)).alias("v"))


@query(f"WITH {FRAMES} SELECT vec_id, CAST(list_concat([0.0, 0.0, 0.0], x[1:61]) AS DOUBLE[]) AS up, CAST(list_concat(x[4:64], [0.0, 0.0, 0.0]) AS DOUBLE[]) AS down, list_concat(x[62:64], x[1:61]) AS round, list_transform(x, lambda y: greatest(y, 0.0)) AS positive FROM fr")
def shift(spark: SparkSession, d: str) -> DataFrame:
    """Shifts with fill, a rotation, and half-wave rectification."""
    x = F.col("x")
    return frames(spark, d).select("vec_id", A.shift(x, 3).alias("up"), A.shift(x, -3).alias("down"), A.circshift(x, 3).alias("round"), A.half_wave(x).alias("positive"))


@query(f"WITH {FRAMES} SELECT vec_id, [x[8], x[5], x[6], x[7]] AS r0, [x[4], x[1], x[2], x[3]] AS r1, CAST([0.0, 0.0, 0.0, 0.0] AS DOUBLE[]) AS t0, CAST([0.0, x[1], x[2], x[3]] AS DOUBLE[]) AS t1 FROM fr")
def shift_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Rotation and translation of a two-row matrix along both axes."""
    m = A.reshape(F.slice("x", 1, 8), 4)
    c, t = A.circshift2d(m, 1, 1), A.translate2d(m, 1, 1)
    return frames(spark, d).select("vec_id", F.element_at(c, 1).alias("r0"), F.element_at(c, 2).alias("r1"), F.element_at(t, 1).alias("t0"), F.element_at(t, 2).alias("t1"))


@query(f"WITH {FRAMES} SELECT vec_id, label, list_transform(range(10), lambda i: CASE WHEN i = label THEN 1 ELSE 0 END) AS hot FROM fr WHERE list_max(x) > 0.25")
def loud_one_hot(spark: SparkSession, d: str) -> DataFrame:
    """Frames whose largest bin is above a threshold, with one-hot labels."""
    return frames(spark, d).where(F.array_max("x") > 0.25).select("vec_id", "label", A.one_hot(F.col("label"), 10).alias("hot"))


_FRETS = "list_transform(range(6), lambda i: CAST(CASE WHEN x[i + 1] < -0.1 THEN -1 ELSE floor((x[i + 1] + 0.6) * 8) END AS INT))"


@query(f"""WITH {FRAMES}, f AS (SELECT vec_id, {_FRETS} AS frets FROM fr), s AS (SELECT vec_id, frets, list_filter(frets, lambda f: f >= 0) AS on_ FROM f)
SELECT vec_id, frets, CASE WHEN len(on_) > 0 AND list_min(on_) > 0 AND list_max(on_) + 2 <= 9 THEN list_transform(frets, lambda f: CASE WHEN f < 0 THEN f ELSE f + 2 END) ELSE frets END AS up_two FROM s""")
def fret_shift(spark: SparkSession, d: str) -> DataFrame:
    """Frets moved up by two where no string is open and all stay on the neck."""
    frets = F.transform(F.slice("x", 1, 6), lambda v: F.when(v < -0.1, -1).otherwise(F.floor((v + 0.6) * 8)).cast("int"))
    return frames(spark, d).select("vec_id", frets.alias("frets")).select("vec_id", "frets", T.shift_frets(F.col("frets"), F.lit(2), 9).alias("up_two"))


_HANN = "0.5 - 0.5 * cos(2 * pi() * i / 63)"


@query(f"""WITH {FRAMES}, g AS (SELECT track, frame, unnest(x) AS v, unnest(range(64)) AS i, CASE WHEN list_max(list_transform(x, lambda y: abs(y))) > 0.0001 THEN 0.5 * list_max(list_transform(x, lambda y: abs(y))) ELSE 1 END AS peak FROM fr)
SELECT track, CAST(frame * 32 + i AS INT) AS sample, round(sum(v / peak * ({_HANN})), 6) + 0.0 AS value FROM g GROUP BY ALL""")
def overlap_add(spark: SparkSession, d: str) -> DataFrame:
    """Half-overlapped Hann grains, each over half its peak, summed by position."""
    peak = F.array_max(F.transform("x", F.abs))
    g = frames(spark, d).select("track", "frame", F.when(peak > 0.0001, peak * 0.5).otherwise(1.0).alias("peak"), F.posexplode("x").alias("i", "v"))
    hann = 0.5 - 0.5 * F.cos(2 * F.pi() * F.col("i") / 63)
    return g.groupBy("track", (F.col("frame") * 32 + F.col("i")).cast("int").alias("sample")).agg((F.round(F.sum(F.col("v") / F.col("peak") * hann), 6) + 0.0).alias("value"))


@query(f"""WITH {FRAMES}, p AS (SELECT a.vec_id, CASE WHEN a.label = b.label THEN 1 ELSE 0 END AS y, list_distance(a.x, b.x) AS dist FROM fr a JOIN fr b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, y, round(y * pow(greatest(dist - 0.5, 0), 2) + (1 - y) * pow(greatest(1.5 - dist, 0), 2), 9) AS cost, round(y * dist * dist + (1 - y) * greatest(2.0 - dist * dist, 0), 9) AS plain FROM p WHERE round(y * pow(greatest(dist - 0.5, 0), 2) + (1 - y) * pow(greatest(1.5 - dist, 0), 2), 9) > 0""")
def pair_cost(spark: SparkSession, d: str) -> DataFrame:
    """Two-margin and one-margin costs of successive vectors; pairs without cost are dropped."""
    a = frames(spark, d).select("vec_id", "x", "label")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("z"), F.col("label").alias("other"))
    p = a.join(b, "vec_id").withColumns({"y": (F.col("label") == F.col("other")).cast("int"), "d2": A.squared_distance(F.col("x"), F.col("z"))}).withColumn("dist", F.sqrt("d2"))
    far = lambda c: F.greatest(c, F.lit(0.0))
    cost = F.col("y") * F.pow(far(F.col("dist") - 0.5), 2) + (1 - F.col("y")) * F.pow(far(1.5 - F.col("dist")), 2)
    plain = F.col("y") * F.col("d2") + (1 - F.col("y")) * far(2.0 - F.col("d2"))
    return p.select("vec_id", "y", F.round(cost, 9).alias("cost"), F.round(plain, 9).alias("plain")).where("cost > 0")


# decoding: the first ten elements as posterior


def _posterior(x: F.Column) -> F.Column:
    return A.normalize(F.transform(x, lambda v: F.exp(20 * v)))


def _viterbi_sql(post: str, states: int, tail: str) -> str:
    """Recursive decoding of post(k, frame, penalty, p) as SQL: tables post, path(k, penalty, frame, state)."""
    norm = lambda v: f"list_transform({v}, lambda y: y / CASE WHEN list_sum({v}) = 0 THEN 1 ELSE list_sum({v}) END)"
    raw = f"list_transform(range({states}), lambda j: greatest(f.d[j + 1], exp(f.penalty) * list_max(f.d)) * p.p[j + 1])"
    back = f"list_transform(range({states}), lambda j: CAST(CASE WHEN f.d[j + 1] > exp(f.penalty) * list_max(f.d) THEN j WHEN f.d[j + 1] < exp(f.penalty) * list_max(f.d) THEN list_position(f.d, list_max(f.d)) - 1 ELSE least(j, list_position(f.d, list_max(f.d)) - 1) END AS BIGINT))"
    return f"""WITH RECURSIVE {post},
f AS (SELECT k, penalty, frame, {norm(f'list_transform(p, lambda y: y / {states})')} AS d, CAST([] AS BIGINT[]) AS b FROM post WHERE frame = 0
UNION ALL SELECT k, penalty, frame, {norm('r')} AS d, b FROM (SELECT f.k, f.penalty, p.frame, {raw} AS r, {back} AS b FROM f JOIN post p ON p.k = f.k AND p.penalty = f.penalty AND p.frame = f.frame + 1)),
path AS (SELECT k, penalty, frame, CAST(list_position(d, list_max(d)) - 1 AS BIGINT) AS state, b FROM f WHERE NOT EXISTS (SELECT 1 FROM post q WHERE q.k = f.k AND q.penalty = f.penalty AND q.frame = f.frame + 1)
UNION ALL SELECT g.k, g.penalty, g.frame, h.b[h.state + 1], g.b FROM path h JOIN f g ON g.k = h.k AND g.penalty = h.penalty AND g.frame = h.frame - 1)
{tail}"""


def _post_sql(penalties: str) -> str:
    e = "list_transform(x[1:10], lambda y: exp(20 * y))"
    return f"{FRAMES}, post AS (SELECT track AS k, frame, penalty, list_transform({e}, lambda y: y / list_sum({e})) AS p FROM fr CROSS JOIN (SELECT unnest({penalties}) AS penalty))"


@query(_viterbi_sql(_post_sql("[CAST(-0.5 AS DOUBLE)]"), 10, "SELECT k AS track, frame, CAST(state AS INT) AS state FROM path"))
def viterbi_path(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d).withColumn("p", _posterior(F.slice("x", 1, 10)))
    return D.decode(f, ["track"], "frame", "p", F.lit(-0.5)).select("track", "frame", "state")


_SEG = """, n AS (SELECT path.k, path.frame, path.state, ln(post.p[path.state + 1]) AS l, row_number() OVER (PARTITION BY path.k ORDER BY path.frame DESC) = 1 AS last_,
row_number() OVER (PARTITION BY path.k ORDER BY path.frame) - row_number() OVER (PARTITION BY path.k, path.state ORDER BY path.frame) AS g FROM path JOIN post ON path.k = post.k AND path.frame = post.frame),
r AS (SELECT k, state, min(frame) AS s, max(frame) AS z, avg(l) FILTER (NOT last_) AS c FROM n GROUP BY k, state, g)
SELECT k AS track, CAST(row_number() OVER w - 1 AS INT) AS segment, CAST(state AS INT) AS state, s AS start, coalesce(lead(s) OVER w, z) AS "end", round(c, 9) AS confidence FROM r WINDOW w AS (PARTITION BY k ORDER BY s)"""


@query(_viterbi_sql(_post_sql("[CAST(-0.5 AS DOUBLE)]"), 10, _SEG))
def viterbi_segments(spark: SparkSession, d: str) -> DataFrame:
    """Decoded segments with confidence."""
    f = frames(spark, d).withColumn("p", _posterior(F.slice("x", 1, 10)))
    path = D.decode(f, ["track"], "frame", "p", F.lit(-0.5)).join(f.select("track", "frame", "p"), ["track", "frame"])
    p = F.element_at("p", F.col("state") + 1)
    s = D.segments(path, ["track"], "frame", F.col("frame"), F.when(p > 0, F.ln(p)))
    return s.select("track", "segment", "state", "start", "end", F.round("confidence", 9).alias("confidence"))


@query(_viterbi_sql(_post_sql("[CAST(-0.5 AS DOUBLE), -1.0, -2.0]"), 10, ", c AS (SELECT penalty, k, CASE WHEN lag(state) OVER (PARTITION BY penalty, k ORDER BY frame) = state THEN 0 ELSE 1 END AS n FROM path) SELECT penalty, k AS track, CAST(sum(n) AS BIGINT) AS runs FROM c GROUP BY ALL"))
def viterbi_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Segments per track at several penalties, decoded in parallel."""
    from pyspark.sql import Window

    f = frames(spark, d).withColumn("p", _posterior(F.slice("x", 1, 10))).withColumn("pen", F.explode(F.array(F.lit(-0.5), F.lit(-1.0), F.lit(-2.0))))
    path = D.decode(f, ["track"], "frame", "p", F.col("pen"))
    w = Window.partitionBy("penalty", "track").orderBy("frame")
    return path.withColumn("n", F.when(F.lag("state").over(w) == F.col("state"), 0).otherwise(1)).groupBy("penalty", "track").agg(F.sum("n").alias("runs"))


_FRET_POST = f"{FRAMES}, s AS (SELECT *, unnest(range(6)) AS st FROM fr), e AS (SELECT track, frame, st, list_transform(x[st * 9 + 1 : st * 9 + 9], lambda y: exp(20 * y)) AS e FROM s), post AS (SELECT track * 6 + st AS k, frame, CAST(-0.5 AS DOUBLE) AS penalty, list_transform(e, lambda y: y / list_sum(e)) AS p FROM e)"


@query(_viterbi_sql(_FRET_POST, 9, "SELECT k // 6 AS track, frame, list(CAST(CASE WHEN state = 8 THEN -1 ELSE state END AS INT) ORDER BY k) AS frets FROM path GROUP BY ALL"))
def fretboard_decode(spark: SparkSession, d: str) -> DataFrame:
    """Six strings of nine frets decoded apart; the last fret is off."""
    f = frames(spark, d).withColumn("string", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("p", _posterior(F.slice("x", F.col("string") * 9 + 1, F.lit(9))))
    path = D.decode(f, ["track", "string"], "frame", "p", F.lit(-0.5))
    fret = F.when(F.col("state") == 8, -1).otherwise(F.col("state"))
    g = path.groupBy("track", "frame").agg(F.array_sort(F.collect_list(F.struct("string", fret.alias("f")))).alias("s"))
    return g.select("track", "frame", F.transform("s", lambda s: s["f"]).alias("frets"))


# sampling


def _md5(*parts: str) -> str:
    return "md5(" + " || '|' || ".join(p if p.startswith("'") else f"CAST({p} AS VARCHAR)" for p in parts) + ")"


@query(f"""WITH n AS (SELECT count(*) AS n FROM documents), r AS (SELECT doc_id, row_number() OVER (ORDER BY {_md5('doc_id', "'7'")}, doc_id) AS r FROM documents), f AS (SELECT unnest(range(5)) AS fold),
e AS (SELECT doc_id, fold, (r - 1) * 5 // n.n AS own, n.n - count(*) FILTER ((r - 1) * 5 // n.n = fold) OVER (PARTITION BY fold) AS rest FROM r, f, n),
p AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY {_md5('doc_id', 'fold', "'7'")}, doc_id) AS k FROM e WHERE own <> fold)
SELECT CAST(fold AS INT) AS fold, CASE WHEN k <= floor(rest * CAST(0.15 AS DOUBLE)) THEN 'valid' ELSE 'train' END AS split, doc_id FROM p UNION ALL SELECT CAST(fold AS INT), 'test', doc_id FROM e WHERE own = fold""")
def kfold(spark: SparkSession, d: str) -> DataFrame:
    """Five folds of train, valid and test."""
    return P.kfold(table(spark, d, "documents"), "doc_id", 5, 0.15, 7)


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) WHERE i >= 9 AND (i - 9) % 10 = 0")
def stride_sample(spark: SparkSession, d: str) -> DataFrame:
    """Every tenth document from the tenth on."""
    return P.positions(table(spark, d, "documents").select("doc_id"), ["doc_id"]).where("position >= 9 and (position - 9) % 10 = 0").select("doc_id")


@query(f"SELECT doc_id FROM documents ORDER BY {_md5('doc_id', chr(39) + '3' + chr(39))}, doc_id LIMIT 25")
def top_n(spark: SparkSession, d: str) -> DataFrame:
    """The first 25 in random order."""
    return table(spark, d, "documents").select("doc_id").orderBy(P.md5_key(F.col("doc_id"), 3), "doc_id").limit(25)


_UNI = f"r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY {_md5('vec_id', chr(39) + '5' + chr(39))}, vec_id) AS k FROM embeddings)"


@query(f"WITH {_UNI} SELECT row_number() OVER (ORDER BY k, label) - 1 AS position, vec_id, label FROM r")
def uniform_class_stream(spark: SparkSession, d: str) -> DataFrame:
    return P.uniform_classes(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id", "label", 5)


@query(f"""WITH s AS (SELECT event_id, CAST(event_id % 2 AS INT) AS source FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {_md5('event_id', chr(39) + '5' + chr(39))}, event_id) AS k FROM s)
SELECT row_number() OVER (ORDER BY (2 * k - 1) * CASE WHEN source = 0 THEN 1 ELSE 3 END, source) - 1 AS position, source, event_id FROM r""")
def weighted_mux(spark: SparkSession, d: str) -> DataFrame:
    """Even events three times as often as odd ones."""
    e = table(spark, d, "events").select("event_id")
    return P.weighted_mux(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "event_id", (3, 1), 5)


@query(f"""WITH {_UNI}, s AS (SELECT label, count(*) AS n, row_number() OVER (ORDER BY label) AS at FROM r GROUP BY label), c AS (SELECT count(*) AS c FROM s),
w AS (SELECT r.vec_id, r.label, r.k, s.at, s.n, (s.at - 1 + 1 + CAST('0x' || substr({_md5('vec_id', "'other'", "'5'")}, 1, 8) AS BIGINT) % greatest(c.c - 1, 1)) % c.c + 1 AS far FROM r JOIN s USING (label), c)
SELECT w.vec_id, w.label, o.vec_id AS other, 1 AS target FROM w JOIN r o ON o.label = w.label AND o.k = w.k % w.n + 1
UNION ALL SELECT w.vec_id, w.label, o.vec_id, 0 FROM w JOIN s f ON f.at = w.far JOIN r o ON o.label = f.label AND o.k = (w.k - 1) % f.n + 1""")
def contrastive_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each vector with one of its class and one of another."""
    return P.contrastive_pairs(table(spark, d, "embeddings"), "vec_id", "label", 5)


@query("""WITH p AS (SELECT event_id, value, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events) SELECT i // 32 AS batch, count(*) AS n, count(*) FILTER (value > 20) AS kept FROM p GROUP BY 1""")
def minibatch(spark: SparkSession, d: str) -> DataFrame:
    """Batches of 32 with what is left after dropping small values."""
    return P.minibatches(table(spark, d, "events"), "event_id", 32, F.col("value") > 20)


@query(f"""WITH w AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), b AS (SELECT label, (sum(n) OVER (ORDER BY label) - n) / CAST(sum(n) OVER () AS DOUBLE) AS lo, sum(n) OVER (ORDER BY label) / CAST(sum(n) OVER () AS DOUBLE) AS hi FROM w),
u AS (SELECT event_id, CAST('0x' || substr({_md5('event_id', "'5'")}, 1, 8) AS BIGINT) / 4294967296.0 AS u FROM events) SELECT event_id, label FROM u JOIN b ON u >= lo AND u < hi""")
def categorical_draw(spark: SparkSession, d: str) -> DataFrame:
    """A class for every event by the classes' frequencies."""
    w = table(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return P.categorical(table(spark, d, "events"), "event_id", w, "label", "n", 5)


@query(f"WITH e AS (SELECT label, vec_id, CAST(unnest(range(2)) AS INT) AS epoch FROM embeddings) SELECT label, epoch, row_number() OVER (PARTITION BY label, epoch ORDER BY {_md5('vec_id', 'epoch', chr(39) + '5' + chr(39))}, vec_id) - 1 AS position, vec_id FROM e")
def epoch_sampler(spark: SparkSession, d: str) -> DataFrame:
    """Two epochs of sampling without replacement per class."""
    return P.epochs(table(spark, d, "embeddings"), "vec_id", "label", 2, 5)


@query(f"WITH {EV} SELECT user_id, label, us, CAST(count(*) OVER (PARTITION BY user_id) AS BIGINT) AS n FROM ev")
def annotation_json(spark: SparkSession, d: str) -> DataFrame:
    """Annotations written as one JSON text per user and read back."""
    from partita.sources.annotations import annotations_from_json, annotations_to_json

    packed = annotations_to_json(events(spark, d), "user_id", {"us": "bigint", "label": "string"})
    back = annotations_from_json(packed, "user_id", {"us": "bigint", "label": "string"})
    return back.select("user_id", "label", "us", F.col("n_items").alias("n"))
