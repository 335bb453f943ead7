"""Queries of the label, path and tablature functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partita import vocab as V
from partita.functions import paths as P
from partita.functions import tabs as T
from partita.plans.sqltext import ROOT_NAMES, VOC
from partita.plans.standins import STEPS, chord_steps
from partita.session import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _values(rows: list[tuple], names: str) -> str:
    lit = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") t({names}))"


@query(f"WITH {STEPS}, {VOC} SELECT l_orderkey, l_linenumber, l_partkey, label, voc.idx FROM st JOIN voc USING (idx)")
def chord_index(spark: SparkSession, d: str) -> DataFrame:
    """Class to label and back to the class by parsing."""
    lab = chord_steps(spark, d).withColumn("label", V.class_label(F.col("idx")))
    return lab.select("l_orderkey", "l_linenumber", "l_partkey", "label", V.label_index(F.col("label")).alias("idx"))


@query(f"WITH {STEPS}, {VOC} SELECT label, root, quality, count(*) AS n FROM st JOIN voc USING (idx) GROUP BY ALL")
def chord_label(spark: SparkSession, d: str) -> DataFrame:
    """Lines per class, with the class's label, root and quality from the vocabulary table."""
    voc = F.broadcast(V.vocabulary(spark).select("idx", "label", "root", "quality"))
    return chord_steps(spark, d).join(voc, "idx").groupBy("label", "root", "quality").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {STEPS}, p AS (SELECT idx AS a, (idx * 5 + 3) % 157 AS b, count(*) AS n FROM st GROUP BY ALL) SELECT a, b, n, CAST(b // 12 * 12 + ((b - a) % 12 + 12) % 12 AS INT) AS sub, CAST(a // 12 * 12 + (a + b) % 12 AS INT) AS added FROM p")
def mod_arith(spark: SparkSession, d: str) -> DataFrame:
    """Block-keeping subtraction and addition modulo 12."""
    p = chord_steps(spark, d).select(F.col("idx").alias("a"), F.expr("cast((idx * 5 + 3) % 157 as int)").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return p.select("a", "b", "n", V.subtract_mod(F.col("a"), F.col("b")).alias("sub"), V.add_mod(F.col("a"), F.col("b")).alias("added"))


@query(f"""WITH {STEPS}, {VOC}, r AS (SELECT unnest(range(12)) AS k, unnest({ROOT_NAMES}) AS name),
p AS (SELECT DISTINCT idx AS a, (idx * 5 + 3) % 157 AS b FROM st)
SELECT x.label AS ref, y.label AS est, CASE WHEN x.idx = 156 THEN 'N' ELSE 'C:' || x.quality END AS ref_c,
CASE WHEN y.idx = 156 THEN 'N' ELSE r.name || ':' || y.quality END AS est_c FROM p JOIN voc x ON x.idx = a JOIN voc y ON y.idx = b JOIN r ON r.k = ((y.root - x.root) % 12 + 12) % 12""")
def transpose_pair(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of labels moved so that the reference's root is C."""
    p = chord_steps(spark, d).select(V.class_label(F.col("idx")).alias("ref"), V.class_label(F.expr("(idx * 5 + 3) % 157")).alias("est")).distinct()
    ref, est = V.relative_labels(F.col("ref"), F.col("est"))
    return p.select("ref", "est", ref.alias("ref_c"), est.alias("est_c"))


_BIG = f"""WITH {STEPS}, p AS (SELECT lag(idx) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS a, idx AS b FROM st),
q AS (SELECT a, b, CASE WHEN a IS NULL THEN NULL WHEN a = 156 OR b = 156 THEN a ELSE a // 12 * 12 + ((a - b % 12) % 12 + 12) % 12 END AS ra, CASE WHEN b = 156 THEN 156 ELSE b // 12 * 12 END AS rb FROM p),
lex AS (SELECT ra, rb, row_number() OVER (ORDER BY count(*) DESC, ra NULLS FIRST, rb) - 1 AS i FROM q GROUP BY ra, rb ORDER BY count(*) DESC, ra NULLS FIRST, rb LIMIT 834)"""


@query(_BIG + ", n AS (SELECT count(*) AS n FROM lex) SELECT q.a, q.b, CAST(CASE WHEN lex.i IS NULL THEN NULL ELSE n.n * CASE WHEN q.b = 156 THEN 0 ELSE q.b % 12 END + lex.i END AS BIGINT) AS state, count(*) AS lines FROM q CROSS JOIN n LEFT JOIN lex ON q.ra IS NOT DISTINCT FROM lex.ra AND q.rb = lex.rb GROUP BY ALL")
def bigram_state(spark: SparkSession, d: str) -> DataFrame:
    """State of each pair of successive classes in a lexicon of the 834 heaviest relative pairs, times twelve roots; unknown pairs are null."""
    return T.bigram_states(chord_steps(spark, d), "l_orderkey", ["l_linenumber", "l_partkey"], 834)


@query(f"WITH {VOC} SELECT idx, label, chroma, list_transform(range(24), lambda i: CASE WHEN i % 2 = 0 THEN CAST(substr(chroma, i // 2 + 1, 1) AS INT) ELSE 0 END) AS spread FROM voc")
def chord_chroma(spark: SparkSession, d: str) -> DataFrame:
    """Twelve-bit chroma of every class by turning its quality's bits, and spread to two bins per semitone."""
    bits, root = F.col("bits"), F.greatest(F.col("root"), F.lit(0))
    turned = F.concat(F.expr("substring(bits, 13 - greatest(root, 0), 12)"), F.substring(bits, F.lit(1), F.lit(12) - root))
    v = V.vocabulary(spark).select("idx", "label", turned.alias("chroma"))
    spread = F.flatten(F.transform(F.split(F.col("chroma"), ""), lambda b: F.array(b.cast("int"), F.lit(0))))
    return v.select("idx", "label", "chroma", spread.alias("spread"))


_TON = ", ".join("round((" + " + ".join(f"CAST(substr(chroma, {k + 1}, 1) AS DOUBLE) * ({x!r})" for k, x in enumerate(row)) + f") / greatest(len(replace(chroma, '0', '')), 1), 9) + 0.0 AS t{i}" for i, row in enumerate(V.tonnetz_basis()))


@query(f"WITH {VOC} SELECT idx, {_TON} FROM voc")
def chord_tonnetz(spark: SparkSession, d: str) -> DataFrame:
    """Six tonnetz coordinates of every class."""
    bits = F.transform(F.split(F.col("chroma"), ""), lambda b: b.cast("double"))
    t = T.chroma_tonnetz(bits)
    return V.vocabulary(spark).select("idx", *[(F.round(t[i], 9) + 0.0).alias(f"t{i}") for i in range(6)])


_AFF = [(q, i, w) for q, t in enumerate(V.AFFINITY) for i, w in t]


@query(f"WITH a AS {_values(_AFF, 'q, i, w')}, r AS (SELECT unnest(range(12)) AS r) SELECT CAST(q * 12 + r AS INT) AS class_idx, CAST(i // 12 * 12 + (i + r) % 12 AS INT) AS other_idx, CAST(w AS DOUBLE) AS weight FROM a CROSS JOIN r UNION ALL SELECT 156, 156, 1.0")
def affinity(spark: SparkSession, d: str) -> DataFrame:
    return V.affinity(spark)


_PATH = "'/data/' || coalesce(subset, '') || '/' || key || CASE WHEN CAST(floor(coalesce(duration, 0)) AS BIGINT) % 3 = 0 THEN '.tar.gz' WHEN CAST(floor(coalesce(duration, 0)) AS BIGINT) % 3 = 1 THEN '' ELSE '.npz' END"


@query(f"WITH p AS (SELECT DISTINCT {_PATH} AS path FROM tracks), b AS (SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(path, '([^/]*)$', 1) AS name FROM p) SELECT path, dir, CASE WHEN instr(name, '.') > 1 THEN regexp_replace(name, '\\.[^.]*$', '') ELSE name END AS base, CASE WHEN instr(name, '.') > 1 THEN regexp_extract(name, '(\\.[^.]*)$', 1) ELSE '' END AS ext, '/out/' || (CASE WHEN instr(name, '.') > 1 THEN regexp_replace(name, '\\.[^.]*$', '') ELSE name END) || '.json' AS mapped FROM b")
def path_parts(spark: SparkSession, d: str) -> DataFrame:
    """Directory, base and last extension of a path, and the path it maps to."""
    p = table(spark, d, "tracks").select(F.expr(_PATH).alias("path")).distinct()
    c = F.col("path")
    return p.select("path", P.file_dir(c).alias("dir"), P.file_base(c).alias("base"), P.file_ext(c).alias("ext"), P.map_path(c, "/out", "json").alias("mapped"))


@query(f"WITH {STEPS}, {VOC} SELECT DISTINCT idx, CASE WHEN idx = 156 THEN 13 ELSE CAST(idx % 12 AS INT) END AS root, CAST(idx // 12 AS INT) AS quality, CASE WHEN idx = 156 THEN 'N' ELSE {ROOT_NAMES}[(idx % 12 + 7) % 12 + 1] || ':' || quality END AS up_a_fifth FROM st JOIN voc USING (idx)")
def joint_index(spark: SparkSession, d: str) -> DataFrame:
    """Root and quality targets of every class met, and its label a fifth higher."""
    c = F.col("idx")
    rows = chord_steps(spark, d).select("idx").distinct()
    return rows.select("idx", F.when(c == 156, 13).otherwise(F.pmod(c, F.lit(12))).cast("int").alias("root"), F.floor(c / 12).cast("int").alias("quality"), V.transpose_label(V.class_label(c), F.lit(7)).alias("up_a_fifth"))


@query(f"""WITH {STEPS}, c AS (SELECT idx // 12 AS quality, count(*) AS n FROM st GROUP BY 1), w AS (SELECT quality, (SELECT max(n) FROM c) / n AS r FROM c)
SELECT CAST(quality AS INT) AS quality, round((r - (SELECT avg(r) FROM w)) / (SELECT stddev_pop(r) FROM w) + 1, 6) AS weight FROM w""")
def class_weights(spark: SparkSession, d: str) -> DataFrame:
    """Largest count over own count, as z-score with population deviation, plus one."""
    c = chord_steps(spark, d).groupBy(F.floor(F.col("idx") / 12).cast("int").alias("quality")).agg(F.count(F.lit(1)).alias("n"))
    r = c.join(F.broadcast(c.agg(F.max("n").alias("m")))).select("quality", (F.col("m") / F.col("n")).alias("r"))
    z = r.join(F.broadcast(r.agg(F.avg("r").alias("a"), F.stddev_pop("r").alias("s"))))
    return z.select("quality", F.round((F.col("r") - F.col("a")) / F.nullif(F.col("s"), F.lit(0.0)) + 1, 6).alias("weight"))
