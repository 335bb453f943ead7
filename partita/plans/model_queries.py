"""Queries of the dense kernels, nearest neighbours and models, with SQL where it can say the same."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partita.functions import arrays as A
from partita.functions.paths import instrument_code
from partita.operators import kernels as K
from partita.operators import models as M
from partita.operators import sequences as S
from partita.plans.standins import FRAMES, frames
from partita.session import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


KERNEL = K.lowpass_kernel(3, 5)
#: The same kernel for the oracle, from its definition: three rising steps of a Hamming window of seven, a bell of deviation 5 / 4.
_WEIGHTS = [[(0.54 - 0.46 * math.cos(2 * math.pi * i / 6)) * math.exp(-0.5 * ((j - 2) / 1.25) ** 2) for j in range(5)] for i in range(3)]
ORACLE_KERNEL = np.array(_WEIGHTS) / sum(map(sum, _WEIGHTS))


def _conv_sql(name: str, source: str, value: str, kernel: np.ndarray, bins: int = 64) -> str:
    """A table name(track, frame, bin, c): convolution of source(track, frame, bin, <value>) with mirrored edges, by join on offsets."""
    a, b = kernel.shape
    taps = ", ".join(f"({i - (a - 1 - (a - 1) // 2)}, {j - (b - 1 - (b - 1) // 2)}, {kernel[a - 1 - i, b - 1 - j]!r})" for i in range(a) for j in range(b)).replace("np.float64(", "").replace("))", ")")
    fix = lambda e, n: f"CASE WHEN {e} < 0 THEN -1 - ({e}) WHEN {e} >= {n} THEN 2 * {n} - 1 - ({e}) ELSE {e} END"
    # where each tap reads is worked out first, so that the join is on columns alone
    return f"""{name}_k AS (SELECT * FROM (VALUES {taps}) t(di, dj, w)),
{name}_at AS MATERIALIZED (SELECT o.track, o.frame, o.bin, w, {fix('o.frame + di', 'l.n')} AS f, {fix('o.bin + dj', str(bins))} AS b FROM {source} o CROSS JOIN {name}_k JOIN len l ON l.track = o.track),
{name} AS MATERIALIZED (SELECT o.track, o.frame, o.bin, sum(o.w * s.{value}) AS c FROM {name}_at o JOIN {source} s ON s.track = o.track AND s.frame = o.f AND s.bin = o.b GROUP BY ALL)"""


_LONG = f"{FRAMES}, lg AS (SELECT track, frame, unnest(range(64)) AS bin, unnest(x) AS v FROM fr), len AS (SELECT track, max(frame) + 1 AS n FROM fr GROUP BY track)"
_HIGH = f"{_LONG}, {_conv_sql('lo', 'lg', 'v', ORACLE_KERNEL)}, hp AS (SELECT track, frame, bin, lg.v - lo.c AS v, (lg.v - lo.c) * (lg.v - lo.c) AS v2 FROM lg JOIN lo USING (track, frame, bin))"
_DEV = f"{_HIGH}, {_conv_sql('sq', 'hp', 'v2', ORACLE_KERNEL)}, dv AS (SELECT track, frame, bin, hp.v, sqrt(sq.c) AS s FROM hp JOIN sq USING (track, frame, bin))"
_OUT = "track, frame, CAST(bin AS INT) AS bin, round({v}, 6) + 0.0 AS value"


def _exploded(df: DataFrame) -> DataFrame:
    return df.select("track", "frame", F.posexplode("x").alias("bin", "v")).select("track", "frame", "bin", (F.round("v", 6) + 0.0).alias("value"))


def _matrix(spark: SparkSession, d: str, fn) -> DataFrame:
    return _exploded(K.apply_matrix(frames(spark, d), "track", "frame", "x", fn))


@query(f"WITH {_HIGH} SELECT {_OUT.format(v='v')} FROM hp")
def highpass(spark: SparkSession, d: str) -> DataFrame:
    return _matrix(spark, d, lambda x: K.highpass(x, KERNEL))


@query(f"WITH {_DEV}, m AS (SELECT track, avg(s) AS m FROM dv GROUP BY track) SELECT {_OUT.format(v='v / greatest(s, m)')} FROM dv JOIN m USING (track)")
def lcn(spark: SparkSession, d: str) -> DataFrame:
    return _matrix(spark, d, lambda x: K.lcn(x, KERNEL))


@query(f"WITH {_DEV}, m AS (SELECT track, frame, exp(avg(ln(s + 0.03125))) AS m FROM dv GROUP BY track, frame) SELECT {_OUT.format(v='v / CASE WHEN s > m AND s <> 0 THEN s ELSE 1 END')} FROM dv JOIN m USING (track, frame)")
def lcn_rowwise(spark: SparkSession, d: str) -> DataFrame:
    return _matrix(spark, d, lambda x: K.lcn_rowwise(x, KERNEL))


@query(f"WITH {_HIGH.replace('(lg.v - lo.c) AS v2', 'greatest(lg.v - lo.c, 0) * 1 AS v2').replace('(lg.v - lo.c) * greatest', 'greatest(lg.v - lo.c, 0) * greatest').replace('lg.v - lo.c AS v,', 'greatest(lg.v - lo.c, 0) AS v,')}, {_conv_sql('sq', 'hp', 'v2', ORACLE_KERNEL)}, dv AS (SELECT track, frame, bin, hp.v, sqrt(sq.c) AS s FROM hp JOIN sq USING (track, frame, bin)), m AS (SELECT track, avg(s) AS m FROM dv GROUP BY track) SELECT {_OUT.format(v='v / sqrt(greatest(s, m))')} FROM dv JOIN m USING (track)")
def lcn_mauch(spark: SparkSession, d: str) -> DataFrame:
    return _matrix(spark, d, lambda x: K.lcn_mauch(x, KERNEL, 0.5))


@query(f"WITH {_LONG}, v2 AS (SELECT *, v * v AS v2 FROM lg), {_conv_sql('sq', 'v2', 'v2', ORACLE_KERNEL)} SELECT {_OUT.format(v='lg.v / sqrt(sq.c)')} FROM lg JOIN sq USING (track, frame, bin)")
def local_l2(spark: SparkSession, d: str) -> DataFrame:
    return _matrix(spark, d, lambda x: K.local_l2(x, KERNEL))


@query()
def octave_lcn(spark: SparkSession, d: str) -> DataFrame:
    """Octave-varying normalisation of vectors repeated to 252 bins."""
    wide = frames(spark, d).withColumn("x", F.slice(F.concat("x", "x", "x", "x"), 1, 252))
    return _exploded(K.apply_matrix(wide, "track", "frame", "x", lambda x: K.lcn_octaves(x, KERNEL)))


@query()
def cqt_tones(spark: SparkSession, d: str) -> DataFrame:
    """Constant-Q frames of one second of tones, one for each supplier."""
    f = table(spark, d, "supplier").select(F.concat(F.lit("tone/"), F.col("s_suppkey").cast("string")).alias("path"), (F.lit(55.0) * F.pow(F.lit(2.0), F.pmod("s_suppkey", F.lit(36)) / 12)).alias("f0"))
    t = F.transform(F.sequence(F.lit(0), F.lit(11024)), lambda i: i / F.lit(11025.0))
    audio = f.select("path", F.lit(11025.0).alias("samplerate"), F.transform(t, lambda s: F.sin(2 * math.pi * s * F.col("f0"))).alias("samples"))
    return K.constant_q_frames(audio)


_Q = f"WITH {FRAMES}, q AS (SELECT vec_id, x FROM fr WHERE vec_id % 20 = 0), nn AS (SELECT q.vec_id, p.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_distance(q.x, p.x), 9), p.vec_id) AS r FROM q JOIN fr p ON p.vec_id <> q.vec_id)"


def _vote_sql(ks: list[int]) -> str:
    return _Q + f", v AS (SELECT vec_id, k, label, count(*) AS n FROM nn, (SELECT unnest({ks}) AS k) WHERE r <= k GROUP BY ALL), b AS (SELECT vec_id, CAST(k AS INT) AS k, label AS predicted, n / CAST(k AS DOUBLE) AS share FROM v QUALIFY row_number() OVER (PARTITION BY vec_id, k ORDER BY n DESC, label) = 1)"


@query(_vote_sql([5]) + " SELECT * FROM b")
def knn_vote(spark: SparkSession, d: str) -> DataFrame:
    """Every twentieth vector classified by its five nearest among all."""
    v = frames(spark, d).select("vec_id", "x", "label")
    return M.knn_votes(v.where("vec_id % 20 = 0"), v, "vec_id", "x", "label", [5])


KS = [1, 5, 9, 15, 21, 35, 51, 75]


@query(_vote_sql(KS) + " SELECT k, round(avg(CASE WHEN b.predicted = e.label THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM b JOIN embeddings e USING (vec_id) GROUP BY k")
def knn_select_k(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy for each number of neighbours; the best is the first largest."""
    v = frames(spark, d).select("vec_id", "x", "label")
    p = M.knn_votes(v.where("vec_id % 20 = 0"), v, "vec_id", "x", "label", KS).join(v.select("vec_id", "label"), "vec_id")
    return p.groupBy("k").agg(F.round(F.avg((F.col("predicted") == F.col("label")).cast("double")), 9).alias("accuracy"))


@query(_vote_sql([9]) + " SELECT e.label AS truth, predicted, count(*) AS n FROM b JOIN embeddings e USING (vec_id) GROUP BY ALL")
def confusion(spark: SparkSession, d: str) -> DataFrame:
    v = frames(spark, d).select("vec_id", "x", "label")
    p = M.knn_votes(v.where("vec_id % 20 = 0"), v, "vec_id", "x", "label", [9]).join(v.select("vec_id", F.col("label").alias("truth")), "vec_id")
    return p.groupBy("truth", "predicted").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {FRAMES}, lg AS (SELECT label, unnest(range(64)) AS i, unnest(x) AS v FROM fr), m AS (SELECT label, list(a ORDER BY i) AS m FROM (SELECT label, i, avg(v) AS a FROM lg GROUP BY ALL) GROUP BY label)
SELECT vec_id FROM fr JOIN m USING (label) WHERE round(1 - list_dot_product(x, m) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(m, m))), 6) <= 0.85""")
def outlier_filter(spark: SparkSession, d: str) -> DataFrame:
    """Vectors near the mean of their label by cosine distance."""
    v = frames(spark, d).select("vec_id", "x", "label")
    mean = v.select("label", F.posexplode("x").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("a")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "a"))), lambda s: s["a"]).alias("m"))
    return v.join(F.broadcast(mean), "label").where(F.round(A.cosine_distance(F.col("x"), F.col("m")), 6) <= 0.85).select("vec_id")


_MERGE = {"Brand#11": "A", "Brand#12": "A", "Brand#21": "B", "Brand#33": "B"}


@query("WITH p AS (SELECT p_partkey, regexp_extract(p_brand, '^([A-Za-z0-9]+)', 1) || '' AS b, p_brand FROM part) SELECT CASE p_brand " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _MERGE.items()) + " ELSE b END AS grp, CAST(count(*) AS BIGINT) AS n, min(p_partkey) AS first_part FROM p GROUP BY 1")
def instrument_groups(spark: SparkSession, d: str) -> DataFrame:
    """Parts grouped by the first token of their brand, some codes merged through a table."""
    merge = spark.createDataFrame(list(_MERGE.items()), "p_brand string, to string")
    p = table(spark, d, "part").select("p_partkey", "p_brand").join(F.broadcast(merge), "p_brand", "left")
    code = F.coalesce("to", instrument_code(F.col("p_brand")))
    return p.groupBy(code.alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first_part"))


@query()
def network_forward(spark: SparkSession, d: str) -> DataFrame:
    """Class posteriors of centred tiles of eight frames by a small convolutional network with seeded weights."""
    tiles = S.tiles(frames(spark, d), "track", ["frame"], "x", 8).select("track", "frame", F.flatten("tile").alias("x"))
    return M.apply_network(tiles, "x", (1, 8, 64), M.MODELS["chords_S"](frames=8, bins=64), "posterior")


@query()
def pca_lda(spark: SparkSession, d: str) -> DataFrame:
    """Three discriminant coordinates of every vector."""
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), "label")
    layers = M.fit_pca_lda(v, "x", "label", 16, 3)
    return M.apply_network(v, "x", (64,), layers, "embedding")


@query(f"WITH {FRAMES} SELECT a.vec_id, b.vec_id AS second, CAST(a.label AS INT) AS label, list_dot_product(a.x[1:2], b.x[1:2]) IS NOT NULL AS both_there FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(vec_id AS VARCHAR) || '|9'), vec_id) AS k FROM fr) a JOIN (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(vec_id AS VARCHAR) || '|9'), vec_id) AS k FROM fr) b ON a.label = b.label AND b.k = a.k + 1 WHERE a.k % 2 = 1")
def same_class_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Successive samples of a class in random order, taken two by two."""
    from partita.operators.sampling import md5_key, ranked

    r = ranked(frames(spark, d).select("vec_id", "x", "label"), ["label"], md5_key(F.col("vec_id"), 9), "vec_id")
    b = r.select("label", (F.col("rank") - 1).alias("rank"), F.col("vec_id").alias("second"), F.col("x").alias("z"))
    return r.where("rank % 2 = 1").join(b, ["label", "rank"]).select("vec_id", "second", F.col("label").cast("int").alias("label"), (F.col("x").isNotNull() & F.col("z").isNotNull()).alias("both_there"))


