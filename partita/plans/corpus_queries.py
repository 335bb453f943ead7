"""Queries of relative counts, importing, voicings and sampling streams over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partita import vocab as V
from partita.functions import paths as P
from partita.functions import tabs as T
from partita.operators import importing as M
from partita.operators import kernels as K
from partita.operators import sampling as R
from partita.operators import sequences as S
from partita.operators.vectors import near_mean
from partita.plans import score_queries as SC
from partita.plans.extra_queries import _ANN, _annotation, _holding, _points
from partita.plans.model_queries import KERNEL, ORACLE_KERNEL, _conv_sql
from partita.plans.sqltext import QUALITY_BITS, QUALITY_NAMES, chroma_sql, label_sql
from partita.plans.standins import EV, FRAMES, IV, RUNS, STEPS, chord_steps, events, frames, intervals
from partita.session import table

QUERIES, SQL = {}, {}
ORDER = ["us", "event_id"]
IORDER = ["s", "event_id"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _hash(*parts: Column | str | int) -> Column:
    """32 bits of md5 of the parts as a number."""
    return F.conv(F.substring(R.md5_key(*parts), 1, 8), 16, 10).cast("bigint")


def _hash_sql(*parts: str) -> str:
    text = " || '|' || ".join(p if p.startswith("'") else f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)"


# counts of classes as seen from a root

_CLASS = "cast((event_id * 7 + user_id) % 157 as int)"
_CL = IV + f", cl AS (SELECT user_id, event_id, s, e, {_CLASS.upper().replace('EVENT_ID', 'event_id').replace('USER_ID', 'user_id')} AS idx FROM iv)"


def _rel(root: str, x: str) -> str:
    return f"CAST(CASE WHEN {root} = 156 OR {x} = 156 THEN {x} ELSE {x} // 12 * 12 + (({x} % 12 - {root} % 12) % 12 + 12) % 12 END AS INT)"


def _classes(spark: SparkSession, d: str) -> DataFrame:
    return intervals(events(spark, d)).withColumns({"idx": F.expr(_CLASS), "micros": F.col("e") - F.col("s")})


@query(f"WITH {_CL} SELECT {_rel('idx', 'idx')} AS state, CAST(sum(e - s) AS BIGINT) AS micros FROM cl GROUP BY 1")
def state_durations(spark: SparkSession, d: str) -> DataFrame:
    """Time of each class seen from its own root."""
    c = F.col("idx")
    return _classes(spark, d).groupBy(V.relative_class(c, c).alias("state")).agg(F.sum("micros").alias("micros"))


_LAG = "n AS (SELECT *, lag(idx) OVER w AS p, lead(idx) OVER w AS q FROM cl WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id))"


@query(f"WITH {_CL}, {_LAG} SELECT {_rel('idx', 'p')} AS prev, {_rel('idx', 'idx')} AS cur, CAST(sum(e - s) AS BIGINT) AS micros FROM n WHERE p IS NOT NULL GROUP BY 1, 2")
def bigram_durations(spark: SparkSession, d: str) -> DataFrame:
    """Time of the second class of each pair of successive classes, both seen from its root."""
    n = S.ngrams(_classes(spark, d), "user_id", IORDER, "idx").where("prev is not null")
    c = F.col("idx")
    return n.select(V.relative_class(c, F.col("prev")).alias("prev"), V.relative_class(c, c).alias("cur"), "micros").groupBy("prev", "cur").agg(F.sum("micros").alias("micros"))


def _trigrams(spark: SparkSession, d: str) -> DataFrame:
    n = S.ngrams(_classes(spark, d), "user_id", IORDER, "idx", 3).where("prev is not null and next is not null")
    c = F.col("idx")
    return n.select(V.relative_class(c, F.col("prev")).alias("prev"), V.relative_class(c, c).alias("cur"), V.relative_class(c, F.col("next")).alias("nxt"), "idx", "micros")


@query(f"WITH {_CL}, {_LAG} SELECT {_rel('idx', 'p')} AS prev, {_rel('idx', 'idx')} AS cur, {_rel('idx', 'q')} AS nxt, CAST(sum(e - s) AS BIGINT) AS micros FROM n WHERE p IS NOT NULL AND q IS NOT NULL GROUP BY 1, 2, 3")
def trigram_durations(spark: SparkSession, d: str) -> DataFrame:
    """Time of the middle class of each three successive classes, all seen from its root."""
    return _trigrams(spark, d).groupBy("prev", "cur", "nxt").agg(F.sum("micros").alias("micros"))


@query(f"""WITH {_CL}, {_LAG}, t AS (SELECT {_rel('idx', 'p')} AS a, {_rel('idx', 'idx')} AS b, {_rel('idx', 'q')} AS c, idx, e - s AS m FROM n WHERE p IS NOT NULL AND q IS NOT NULL)
SELECT {chroma_sql('a')} AS prev, {chroma_sql('b')} AS cur, {chroma_sql('c')} AS nxt, CAST(sum(m) AS BIGINT) AS micros, list_sort(list(DISTINCT {label_sql('idx')})) AS labels FROM t GROUP BY 1, 2, 3""")
def chroma_trigrams(spark: SparkSession, d: str) -> DataFrame:
    """Trigrams as three twelve-bit chroma: time and labels of the middle."""
    t = _trigrams(spark, d)
    names = [V.class_chroma(F.col(c)).alias(c) for c in ("prev", "cur", "nxt")]
    return t.select(*names, V.class_label(F.col("idx")).alias("label"), "micros").groupBy("prev", "cur", "nxt").agg(F.sum("micros").alias("micros"), F.array_sort(F.collect_set("label")).alias("labels"))


_RANKED = "CASE label " + " ".join(f"WHEN '{k}' THEN {12 * v} + user_id % 12" for k, v in SC.RANK.items()) + " ELSE 156 END"


@query(f"""WITH {RUNS}, r AS (SELECT user_id, label, min(i) AS i, arg_min(us, i) AS s, arg_max(us, i) AS l FROM num GROUP BY user_id, label, g),
x AS (SELECT user_id, s AS start, coalesce(lead(s) OVER (PARTITION BY user_id ORDER BY i), l) AS "end", {_RANKED} AS idx FROM r) SELECT user_id, start, "end", {chroma_sql('idx')} AS chroma FROM x""")
def segment_chroma(spark: SparkSession, d: str) -> DataFrame:
    """Chroma, start and end of each stretch of one label."""
    r = S.runs_to_intervals(events(spark, d), "user_id", ORDER, "label", "us")
    return r.select("user_id", "start", "end", V.class_chroma(SC._class("label")).alias("chroma"))


@query(f"""WITH {STEPS}, c AS (SELECT idx // 12 AS q, count(*) AS n FROM st GROUP BY 1), w AS (SELECT q, (SELECT max(n) FROM c) / n AS r FROM c), z AS (SELECT q, (r - (SELECT avg(r) FROM w)) / (SELECT stddev_pop(r) FROM w) + 1 AS w FROM w)
SELECT l_orderkey, l_linenumber, l_partkey, idx, round(w, 6) AS weight FROM st JOIN z ON z.q = idx // 12""")
def weighted_steps(spark: SparkSession, d: str) -> DataFrame:
    """Every line with the weight of its class's quality; lines without a class are dropped."""
    from partita.plans.label_queries import class_weights

    w = class_weights(spark, d).select("quality", "weight")
    st = chord_steps(spark, d).where("idx is not null").withColumn("quality", F.floor(F.col("idx") / 12).cast("int"))
    return st.join(F.broadcast(w), "quality").drop("quality")  # fourteen qualities


@query("SELECT user_id, event_type AS mode, count(*) AS n FROM events GROUP BY user_id, event_type QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) = 1")
def smallest_mode(spark: SparkSession, d: str) -> DataFrame:
    return S.smallest_mode(table(spark, d, "events"), "user_id", "event_type")


# importing

_FOLDS = "CASE ({h} + fold) % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'valid' ELSE 'train' END"


@query(f"""WITH {_ANN}, {_holding('h', "annotator = 'ann_a'")}, ks AS (SELECT DISTINCT key, {_hash_sql('key', "'3'")} AS h FROM chord_frames WHERE key IS NOT NULL), sp AS (SELECT key, fold, {_FOLDS.format(h='h')} AS split FROM ks, (SELECT unnest(range(5)) AS fold))
SELECT CAST(fold AS INT) AS fold, split, key, l AS label, count(*) AS n, CAST(sum((frame * 3 % 7 + 7) % 7) AS BIGINT) AS total FROM sp JOIN h USING (key) GROUP BY ALL""")
def import_entities(spark: SparkSession, d: str) -> DataFrame:
    """Frames of every key in every fold and split with the label of the first annotator that holds: how many, and the sum of their second bin."""
    keys = table(spark, d, "chord_frames").where("key is not null").select("key").distinct()
    splits = keys.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("split", F.element_at(F.array(F.lit("test"), F.lit("valid"), F.lit("train"), F.lit("train"), F.lit("train")), (F.pmod(_hash(F.col("key"), 3) + F.col("fold"), F.lit(5)) + 1).cast("int")))
    features = _points(spark, d).withColumn("bins", F.array(*[F.pmod(F.col("frame") * i, F.lit(7)).cast("double") for i in range(2, 5)]))
    ivs = _annotation(spark, d, "key", "annotator").where("annotator = 'ann_a'").drop("annotator")
    e = M.import_entities(splits, features, ivs, "key", "t", "bins", 60_000)
    return e.groupBy("fold", "split", "key", "label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.get("bins", F.lit(1))).cast("bigint").alias("total"))


# labels, names and tablature

_FORM = "'^(N|X|[A-G][#b]*)(?::([A-Za-z0-9+-]*))?(?:\\(([^()]*)\\))?(?:/([^/]+))?$'"


@query(f"""WITH l AS (SELECT DISTINCT chord_labels AS label FROM chord_frames WHERE chord_labels IS NOT NULL), p AS (SELECT label, regexp_extract(label, {_FORM}, ['root', 'quality', 'ext', 'bass']) AS p FROM l WHERE regexp_matches(label, {_FORM}))
SELECT label, p.root AS root, p.quality AS quality, CASE WHEN p.ext = '' THEN 0 ELSE len(string_split(p.ext, ',')) END AS n_extensions, p.bass AS bass, true AS same FROM p""")
def label_parts(spark: SparkSession, d: str) -> DataFrame:
    """The four parts of every spelling that fits the form, and whether they join to it again (but for a colon or brackets without content)."""
    rows = table(spark, d, "chord_frames").select(F.col("chord_labels").alias("label")).where("label is not null").distinct().withColumn("p", V.split_label(F.col("label"))).where("p is not null")
    back = F.regexp_replace(F.regexp_replace("label", r"\(\)", ""), " *, *", ",")
    same = F.regexp_replace(back, ":(?=$|/)", "") == F.regexp_replace(V.join_label(F.col("p")), ":(?=$|/)", "")
    return rows.select("label", "p.root", "p.quality", F.size("p.extensions").cast("bigint").alias("n_extensions"), "p.bass", same.alias("same"))


_SCALE = "[0, 2, 4, 5, 7, 9, 11]"
_PITCH = "(CASE substr({l}, 1, 1) WHEN 'C' THEN 0 WHEN 'D' THEN 2 WHEN 'E' THEN 4 WHEN 'F' THEN 5 WHEN 'G' THEN 7 WHEN 'A' THEN 9 ELSE 11 END + len(replace({a}, 'b', '')) - len(replace({a}, '#', '')) + 24) % 12"


@query(f"""WITH l AS (SELECT DISTINCT chord_labels AS label FROM chord_frames WHERE chord_labels IS NOT NULL UNION SELECT DISTINCT unnest(chord_labels) FROM chord_entities),
q AS (SELECT unnest({QUALITY_NAMES}) AS name, unnest({QUALITY_BITS}) AS bits, unnest(range(13)) AS i),
p AS (SELECT label, regexp_extract(label, '^[A-G]([#b]*)', 1) AS acc, coalesce(nullif(regexp_extract(label, '^[A-G][#b]*:?([a-z0-9]*)', 1), ''), 'maj') AS name,
 list_transform(list_filter(string_split(regexp_extract(label, '\\(([^)]*)\\)', 1), ','), lambda x: regexp_matches(x, '^[#b]*[0-9]+$')), lambda x: ({_SCALE}[(CAST(regexp_extract(x, '([0-9]+)', 1) AS INT) - 1) % 7 + 1] + len(replace(x, 'b', '')) - len(replace(x, '#', '')) + 24) % 12) AS added FROM l WHERE label IS NOT NULL),
s AS (SELECT label, {_PITCH.format(l='label', a='acc')} AS root, array_to_string(list_transform(range(12), lambda k: CASE WHEN substr(b.bits, CAST(k + 1 AS INT), 1) = '1' OR list_contains(added, k) THEN '1' ELSE '0' END), '') AS bits FROM p JOIN q b ON b.name = p.name WHERE regexp_matches(label, '^[A-G]'))
SELECT p.label, CAST(CASE WHEN p.label = 'N' THEN 156 ELSE s.root + 12 * q.i END AS INT) AS soft FROM p LEFT JOIN s ON s.label = p.label LEFT JOIN q ON q.bits = s.bits""")
def chord_soft_index(spark: SparkSession, d: str) -> DataFrame:
    """Sounding-semitone class of every spelling in both chord tables; null where there is none."""
    one = table(spark, d, "chord_frames").select(F.col("chord_labels").alias("label"))
    two = table(spark, d, "chord_entities").select(F.explode("chord_labels").alias("label"))
    return one.unionByName(two).where("label is not null").distinct().select("label", V.soft_label_index(F.col("label")).alias("soft"))


_FRET = "((p_partkey * (i + 3)) % 11 - 1)"
_TAB = f"CASE WHEN {_FRET} < 0 THEN 'X' WHEN {_FRET} % 4 = 2 THEN 'p' || CAST({_FRET} AS VARCHAR) ELSE ' ' || CAST({_FRET} AS VARCHAR) END"
_TUNED = "[40, 45, 50, 55, 59, 64]"


def _tabs(spark: SparkSession, d: str) -> DataFrame:
    fret = lambda i: F.pmod(F.col("p_partkey") * (i + 3), F.lit(11)) - 1
    text = lambda i: F.when(fret(i) < 0, "X").when(F.pmod(fret(i), F.lit(4)) == 2, F.concat(F.lit("p"), fret(i).cast("string"))).otherwise(F.concat(F.lit(" "), fret(i).cast("string")))
    return table(spark, d, "part").select("p_partkey", F.concat_ws(",", *[text(i) for i in range(6)]).alias("tab"))


@query(f"""WITH f AS (SELECT p_partkey, array_to_string(list_transform(range(6), lambda i: {_TAB}), ',') AS tab, list_transform(range(6), lambda i: CAST({_FRET} AS INT)) AS frets FROM part),
n AS (SELECT *, list_filter(list_transform(range(6), lambda i: CASE WHEN frets[i + 1] >= 0 THEN frets[i + 1] + {_TUNED}[i + 1] END), lambda x: x IS NOT NULL) AS notes FROM f)
SELECT p_partkey, tab, frets, notes, array_to_string(list_transform(range(12), lambda k: CASE WHEN list_contains(list_transform(notes, lambda x: x % 12), CAST(k AS INT)) THEN '1' ELSE '0' END), '') AS chroma,
array_to_string(list_transform(frets, lambda x: CASE WHEN x < 0 THEN 'X' ELSE CAST(x AS VARCHAR) END), ',') AS encoded, list_transform(frets, lambda x: CAST((x % 9 + 9) % 9 AS INT)) AS targets FROM n""")
def tab_codec(spark: SparkSession, d: str) -> DataFrame:
    """Tablature of every part to frets, notes, chroma and targets, and back."""
    rows, f = _tabs(spark, d).withColumn("frets", T.decode_tab(F.col("tab"))), F.col("frets")
    return rows.select("p_partkey", "tab", "frets", T.frets_notes(f).alias("notes"), T.notes_chroma(T.frets_notes(f)).alias("chroma"), T.encode_tab(f).alias("encoded"), T.fret_targets(f, 9).alias("targets"))


@query(f"""WITH f AS (SELECT p_partkey, list_transform(range(6), lambda i: CAST({_FRET} AS INT)) AS frets, {_hash_sql('p_partkey', "'6'")} AS h FROM part), o AS (SELECT *, list_filter(frets, lambda x: x >= 0) AS s FROM f),
r AS (SELECT *, CASE WHEN len(s) > 0 AND list_min(s) > 0 AND list_max(s) <= 12 THEN 1 - list_min(s) ELSE 0 END AS lo, CASE WHEN len(s) > 0 AND list_min(s) > 0 AND list_max(s) <= 12 THEN 12 - list_max(s) ELSE 0 END AS hi FROM o),
k AS (SELECT *, lo + h % (hi - lo + 1) AS shift FROM r) SELECT p_partkey, CAST(shift AS INT) AS shift, list_transform(frets, lambda x: CAST(CASE WHEN x < 0 THEN x ELSE x + shift END AS INT)) AS moved FROM k""")
def fret_shift_random(spark: SparkSession, d: str) -> DataFrame:
    """Every tablature moved by a hash-derived number of frets that keeps all strings on the neck of twelve."""
    f = _tabs(spark, d).withColumn("frets", T.decode_tab(F.col("tab")))
    lo, hi = T.shift_range(F.col("frets"), 12)
    f = f.withColumn("shift", (lo + F.pmod(_hash(F.col("p_partkey"), 6), (hi - lo + 1).cast("bigint"))).cast("int"))
    return f.select("p_partkey", "shift", T.shift_frets(F.col("frets"), F.col("shift"), 12).alias("moved"))


_VOICE = "CASE WHEN (idx + 5 * i) % 10 = 0 THEN 'X' ELSE CAST((idx + 5 * i) % 10 - 1 AS VARCHAR) END"


@query(f"""WITH {STEPS}, v AS (SELECT {label_sql('idx')} AS label, array_to_string(list_transform(range(6), lambda i: {_VOICE}), ',') AS tab, list_transform(range(6), lambda i: CAST(((idx + 5 * i) % 10 - 1 + 9) % 9 AS INT)) AS targets FROM (SELECT unnest(range(60)) AS idx))
SELECT v.label, tab, targets, count(*) AS n FROM (SELECT {label_sql('idx')} AS label FROM st) s JOIN v ON v.label = s.label GROUP BY ALL""")
def voicing_targets(spark: SparkSession, d: str) -> DataFrame:
    """Lines per label with the label's voicing and fret targets; labels without a voicing are dropped."""
    voice = lambda i: F.when(F.pmod(F.col("idx") + 5 * i, F.lit(10)) == 0, "X").otherwise((F.pmod(F.col("idx") + 5 * i, F.lit(10)) - 1).cast("string"))
    voicings = V.vocabulary(spark).where("idx < 60").select("label", F.concat_ws(",", *[voice(i) for i in range(6)]).alias("tab"))
    steps = chord_steps(spark, d).groupBy(V.class_label(F.col("idx")).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return T.with_voicing(steps, "label", F.broadcast(voicings), 9).select("label", "tab", "targets", "n")  # sixty voicings


@query(f"""WITH p AS (SELECT s_suppkey, s_suppkey % 12 AS pc, s_suppkey % 9 AS o, ['flute', 'oboe', 'Gong', 'run'][s_suppkey % 4 + 1] AS c FROM supplier)
SELECT '/vsl/' || c || CAST(s_suppkey AS VARCHAR) || '/' || c || '-mV_' || ['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'][pc + 1] || CAST(o AS VARCHAR) || '.wav' AS path,
CAST(12 * o + pc AS INT) AS number, c AS code, c || CAST(s_suppkey AS VARCHAR) AS folder_code, c NOT IN ('Gong', 'run') AS kept FROM p""")
def note_from_name(spark: SparkSession, d: str) -> DataFrame:
    """Note number and instrument codes in a file name for every supplier, and whether the name passes the filters."""
    k = F.col("s_suppkey")
    pick = lambda names, i: F.element_at(F.array(*[F.lit(n) for n in names]), (i + 1).cast("int"))
    c = pick(["flute", "oboe", "Gong", "run"], k % 4)
    path = F.concat(F.lit("/vsl/"), c, k.cast("string"), F.lit("/"), c, F.lit("-mV_"), pick(["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"], k % 12), (k % 9).cast("string"), F.lit(".wav"))
    rows, p = table(spark, d, "supplier").select(path.alias("path")), F.col("path")
    return rows.select("path", P.file_note_number(p).alias("number"), P.instrument_code(p).alias("code"), P.folder_code(p).alias("folder_code"), P.usable_name(p).alias("kept"))


@query("""WITH p AS (SELECT p_partkey, list_transform(range(p_partkey % 5), lambda i: CAST((p_partkey * (i + 1) * 7) % 85 AS INT)) AS n FROM part)
SELECT p_partkey, '[' || array_to_string(n, ', ') || ']' AS notes, array_to_string(list_transform(range(12), lambda k: CASE WHEN list_contains(list_transform(n, lambda x: x % 12), CAST(k AS INT)) THEN '1' ELSE '0' END), '') AS chroma, CAST(len(list_distinct(n)) AS INT) AS n FROM p""")
def note_sets(spark: SparkSession, d: str) -> DataFrame:
    """Text of a set of notes for every part, parsed as JSON (never evaluated), to chroma and to how many of 85 pitches sound."""
    k = F.col("p_partkey")
    notes = F.slice(F.array(*[F.pmod(k * (i + 1) * 7, F.lit(85)).cast("string") for i in range(4)]), F.lit(1), (k % 5).cast("int"))
    rows = table(spark, d, "part").select("p_partkey", F.concat(F.lit("["), F.array_join(notes, ", "), F.lit("]")).alias("notes")).withColumn("p", F.from_json("notes", "array<int>"))
    pitch = F.transform(F.sequence(F.lit(0), F.lit(84)), lambda i: F.array_contains("p", i).cast("int"))
    return rows.select("p_partkey", "notes", T.notes_chroma(F.col("p")).alias("chroma"), F.aggregate(pitch, F.lit(0), lambda a, x: a + x).alias("n"))


# sampling streams

_MD5 = "md5(CAST({0} AS VARCHAR) || '|{1}')"


@query(f"""WITH {FRAMES}, r AS (SELECT track, vec_id, row_number() OVER (PARTITION BY track ORDER BY {_MD5.format('vec_id', 8)}, vec_id) - 1 AS k FROM fr), v AS (SELECT *, k // 25 AS visit, k % 25 AS draw FROM r),
q AS (SELECT track, visit, row_number() OVER (ORDER BY visit, md5(CAST(track AS VARCHAR) || '|' || CAST(visit AS VARCHAR) || '|8'), track) - 1 AS q FROM (SELECT DISTINCT track, visit FROM v))
SELECT row_number() OVER (ORDER BY q // 10, draw, q % 10) - 1 AS position, q % 10 AS slot, track, vec_id FROM v JOIN q USING (track, visit)""")
def working_set_stream(spark: SparkSession, d: str) -> DataFrame:
    """Vectors from a pool of ten open tracks, each replaced after twenty-five samples."""
    return R.working_set_stream(frames(spark, d), "vec_id", "track", 10, 25, 8)


@query(f"""WITH r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY {_MD5.format('vec_id', 5)}, vec_id) AS k FROM embeddings), x AS (SELECT *, label * 17 % 157 AS idx FROM r WHERE label IS NOT NULL)
SELECT row_number() OVER (ORDER BY k, label) - 1 AS position, vec_id, {chroma_sql('idx')} AS target FROM x""")
def chroma_stream(spark: SparkSession, d: str) -> DataFrame:
    """The uniform class stream with the class's chroma as target."""
    s = R.uniform_classes(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id", "label", 5)
    return s.select("position", "vec_id", V.class_chroma(F.pmod(F.col("label") * 17, F.lit(157))).alias("target"))


@query(f"""WITH u AS (SELECT 0 AS source, vec_id, label FROM embeddings WHERE vec_id % 3 <> 0 UNION ALL SELECT 1, vec_id, label FROM embeddings WHERE vec_id % 3 = 0 AND label >= 2 AND label < 5),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('{{' || CAST(source AS VARCHAR) || ', ' || CAST(vec_id AS VARCHAR) || '}}|4'), '{{' || CAST(source AS VARCHAR) || ', ' || CAST(vec_id AS VARCHAR) || '}}') AS k FROM u WHERE label IS NOT NULL)
SELECT row_number() OVER (ORDER BY k, label) - 1 AS position, CAST(source AS INT) AS source, vec_id, label FROM r""")
def two_set_stream(spark: SparkSession, d: str) -> DataFrame:
    """A uniform class stream of two sets, the second of which gives classes 2 to 4 alone."""
    e = table(spark, d, "embeddings").select("vec_id", "label")
    return R.two_set_stream(e.where("vec_id % 3 <> 0"), e.where("vec_id % 3 = 0"), "vec_id", "label", 2, 5, 4)


@query(f"""WITH r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY {_MD5.format('vec_id', 9)}, vec_id) AS k FROM embeddings WHERE label IS NOT NULL), c AS (SELECT label, count(*) AS n, row_number() OVER (ORDER BY label) - 1 AS i FROM r GROUP BY label),
f AS (SELECT a.label, b.label AS far, b.n FROM c a JOIN c b ON b.i = (a.i + 1) % (SELECT count(*) FROM c)), p AS (SELECT r.vec_id, r.label, r.k // 2 AS pair, s.vec_id AS second FROM r JOIN r s ON s.label = r.label AND s.k = r.k + 1 WHERE r.k % 2 = 1),
t AS (SELECT p.vec_id, p.second, z.vec_id AS third FROM p JOIN f USING (label) JOIN r z ON z.label = f.far AND z.k = p.pair % f.n + 1)
SELECT vec_id, second AS other, 1 AS target FROM t UNION ALL SELECT vec_id, third, 0 FROM t""")
def scored_triples(spark: SparkSession, d: str) -> DataFrame:
    """Pairs with targets from triples of two of a class and one of the next."""
    return R.scored_triples(table(spark, d, "embeddings"), "vec_id", "label", 9)


@query(f"""WITH {STEPS}, k AS (SELECT DISTINCT l_orderkey, idx FROM st WHERE idx < 60), e AS (SELECT unnest(range(2)) AS epoch), r AS (SELECT l_orderkey, epoch, idx, row_number() OVER (PARTITION BY l_orderkey, epoch ORDER BY md5(CAST(idx AS VARCHAR) || '|' || CAST(epoch AS VARCHAR) || '|6'), idx) - 1 AS position FROM k, e)
SELECT l_orderkey, CAST(epoch AS INT) AS epoch, position, list_transform(range(6), lambda i: CAST(((idx + 5 * i) % 10 - 1 + 9) % 9 AS INT)) AS targets FROM r""")
def fret_stream(spark: SparkSession, d: str) -> DataFrame:
    """Two shuffled epochs of every order's classes that have a voicing, as fret targets."""
    k = chord_steps(spark, d).where("idx < 60").select("l_orderkey", "idx").distinct()
    voice = lambda i: F.when(F.pmod(F.col("idx") + 5 * i, F.lit(10)) == 0, "X").otherwise((F.pmod(F.col("idx") + 5 * i, F.lit(10)) - 1).cast("string"))
    voicings = F.broadcast(V.vocabulary(spark).where("idx < 60").select(F.col("idx").alias("label"), F.concat_ws(",", *[voice(i) for i in range(6)]).alias("tab")))  # sixty voicings
    return T.with_voicing(R.epochs(k, "idx", "l_orderkey", 2, 6), "idx", voicings, 9).select("l_orderkey", "epoch", "position", "targets")


@query(f"""WITH d AS (SELECT DISTINCT key, subset FROM tracks WHERE key IS NOT NULL AND subset IS NOT NULL), n AS (SELECT subset, count(*) AS n FROM d GROUP BY subset), r AS (SELECT key, subset, row_number() OVER (PARTITION BY subset ORDER BY {_MD5.format('key', 7)}, key) AS r FROM d), f AS (SELECT unnest(range(5)) AS fold),
e AS (SELECT key, subset, fold, (r - 1) * 5 // n AS own, n - count(*) FILTER ((r - 1) * 5 // n = fold) OVER (PARTITION BY subset, fold) AS rest FROM r JOIN n USING (subset), f),
p AS (SELECT *, row_number() OVER (PARTITION BY subset, fold ORDER BY md5(key || '|' || CAST(fold AS VARCHAR) || '|7'), key) AS k FROM e WHERE own <> fold)
SELECT subset, CAST(fold AS INT) AS fold, CASE WHEN k <= floor(rest * CAST(0.15 AS DOUBLE)) THEN 'valid' ELSE 'train' END AS split, key FROM p UNION ALL SELECT subset, CAST(fold AS INT), 'test', key FROM e WHERE own = fold""")
def kfold_by_subset(spark: SparkSession, d: str) -> DataFrame:
    """Five folds of the keys of each subset."""
    keys = table(spark, d, "tracks").select("key", "subset").where("key is not null and subset is not null").distinct()
    return R.kfold(keys, "key", 5, 0.15, 7, "subset")


# walks, tiles, outliers, noise

_STEP = f"({_hash_sql('event_id', chr(39) + '2' + chr(39))} / 4294967296.0 - 0.5) * 3"


@query(f"""WITH {EV}, s AS (SELECT user_id, event_id, us, sum({_STEP}) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS w FROM ev), n AS (SELECT *, sum(w) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) / 5 AS m FROM s),
z AS (SELECT *, avg(m) OVER (PARTITION BY user_id) AS a, stddev_pop(m) OVER (PARTITION BY user_id) AS d FROM n) SELECT user_id, event_id, round(CASE WHEN d > 0 THEN (m - a) / d ELSE 0 END * 2 + 10, 5) AS walk FROM z""")
def random_walk(spark: SparkSession, d: str) -> DataFrame:
    """Random walks of every user with hash-derived steps: smoothed, as z-score, scaled by 2 about 10."""
    e = events(spark, d).select("user_id", *ORDER)
    step = (_hash(F.col("event_id"), 2) / F.lit(4294967296.0) - 0.5) * 3
    return S.random_walk(e, "user_id", ORDER, step, 5, F.lit(10.0), F.lit(2.0)).select("user_id", "event_id", F.round("walk", 5).alias("walk"))


@query(f"""WITH {FRAMES}, n AS (SELECT track, frame, x, row_number() OVER (PARTITION BY track ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY track) AS n, CASE WHEN (vec_id * 5) % 7 = 0 THEN 'X' ELSE 'c' || CAST(label AS VARCHAR) END AS lab FROM fr), s AS (SELECT *, {_hash_sql('track', "'3'")} % (n - 8 + 1) AS first FROM n WHERE n >= 8)
SELECT track, first, list(x ORDER BY i) AS tile, nullif(max(CASE WHEN i = first + 4 THEN lab END), 'X') AS label FROM s WHERE i >= first AND i < first + 8 GROUP BY track, first""")
def random_tiles(spark: SparkSession, d: str) -> DataFrame:
    """A tile of eight frames from a random start of each track, with its middle label; X is none."""
    f = frames(spark, d).withColumn("lab", F.when(F.pmod(F.col("vec_id") * 5, F.lit(7)) == 0, "X").otherwise(F.concat(F.lit("c"), F.col("label").cast("string"))))
    return S.random_tiles(f, "track", ["frame"], "x", "lab", 8, 3)


@query(f"""WITH {FRAMES}, nt AS (SELECT *, label * 3 + 14 AS note FROM fr WHERE label IS NOT NULL), lg AS (SELECT note, unnest(range(64)) AS i, unnest(x) AS v FROM nt WHERE note BETWEEN 16 AND 30), m AS (SELECT note, list(a ORDER BY i) AS m FROM (SELECT note, i, avg(v) AS a FROM lg GROUP BY ALL) GROUP BY note)
SELECT vec_id, note FROM nt JOIN m USING (note) WHERE round(1 - list_dot_product(x, m) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(m, m))), 6) <= 0.85""")
def note_outliers(spark: SparkSession, d: str) -> DataFrame:
    """Vectors near the mean of their note, of notes 16 to 30 alone."""
    f = frames(spark, d).withColumn("note", F.col("label") * 3 + 14)
    return near_mean(f, "note", "x", 0.85, 16, 30, 0).select("vec_id", "note")


@query("WITH g AS (SELECT p_brand AS grp, count(*) AS n FROM part GROUP BY 1) SELECT grp, n FROM g WHERE grp IN (SELECT grp FROM g ORDER BY grp LIMIT 24)")
def instrument_limit(spark: SparkSession, d: str) -> DataFrame:
    """Parts of the first twenty-four codes by name; the limit is the feature."""
    g = table(spark, d, "part").groupBy(F.col("p_brand").alias("grp")).agg(F.count(F.lit(1)).alias("n"))
    return g.orderBy("grp").limit(24)


_NORMAL = "sqrt(-2 * ln((h1 + 1) / 4294967297.0)) * cos(2 * pi() * h2 / 4294967296.0)"


@query(f"""WITH {FRAMES}, r AS (SELECT vec_id, {_hash_sql('vec_id', "'11'")} AS drop_, {_hash_sql('vec_id', "'21'")} AS h1, {_hash_sql('vec_id', "'22'")} AS h2, unnest(range(64)) AS i, unnest(x) AS v FROM fr), s AS (SELECT *, 0.25 * {_NORMAL} AS scale FROM r),
e AS (SELECT vec_id, drop_, i, v, scale, {_hash_sql('vec_id', 'i', "'31'")} AS mask, {_hash_sql('vec_id', 'i', "'41'")} AS h1, {_hash_sql('vec_id', 'i', "'42'")} AS h2 FROM s)
SELECT vec_id, list(round(CASE WHEN drop_ < 0.05 * 4294967296 THEN 0.0 ELSE CASE WHEN mask < 0.9 * 4294967296 THEN v ELSE 0.0 END + scale * {_NORMAL} END, 6) + 0.0 ORDER BY i) AS x FROM e GROUP BY vec_id""")
def augment_noise(spark: SparkSession, d: str) -> DataFrame:
    """Every vector with bins masked at random, Gaussian noise of one scale per vector, and some vectors dropped to zero; all from hashes."""
    full = 4294967296.0

    def normal(first: int, *of: Column) -> Column:
        """Box and Muller's normal number from two hashes."""
        return F.sqrt(-2 * F.ln((_hash(*of, first) + 1) / F.lit(full + 1))) * F.cos(2 * F.pi() * _hash(*of, first + 1) / full)

    k = F.col("vec_id")
    rows = frames(spark, d).select("vec_id", "x", _hash(k, 11).alias("drop"), (0.25 * normal(21, k)).alias("scale"))
    noisy = F.transform("x", lambda v, i: F.when(F.col("drop") < 0.05 * full, 0.0).otherwise(F.when(_hash(k, i, 31) < 0.9 * full, v).otherwise(0.0) + F.col("scale") * normal(41, k, i)))
    return rows.select("vec_id", F.transform(noisy, lambda v: F.round(v, 6) + 0.0).alias("x"))


_HALVES = f"{FRAMES}, lg AS (SELECT track * 2 + c AS track, frame, unnest(range(32)) AS bin, unnest(x[c * 32 + 1 : c * 32 + 32]) AS v FROM fr CROSS JOIN (SELECT unnest([0, 1]) AS c)), len AS (SELECT track, max(frame) + 1 AS n FROM lg GROUP BY track)"


@query(f"""WITH {_HALVES}, {_conv_sql('lo', 'lg', 'v', ORACLE_KERNEL, 32)}, hp AS (SELECT track, frame, bin, lg.v - lo.c AS v, (lg.v - lo.c) * (lg.v - lo.c) AS v2 FROM lg JOIN lo USING (track, frame, bin)), {_conv_sql('sq', 'hp', 'v2', ORACLE_KERNEL, 32)},
dv AS (SELECT track, frame, bin, hp.v, sqrt(sq.c) AS s FROM hp JOIN sq USING (track, frame, bin)), m AS (SELECT track, avg(s) AS m FROM dv GROUP BY track) SELECT track // 2 AS track, frame, CAST(track % 2 AS INT) AS channel, CAST(bin AS INT) AS bin, round(v / greatest(s, m), 6) + 0.0 AS value FROM dv JOIN m USING (track)""")
def lcn_channels(spark: SparkSession, d: str) -> DataFrame:
    """Contrast normalisation of each of two channels of 32 bins on its own."""
    f = frames(spark, d).select("track", "frame", F.array(F.slice("x", 1, 32), F.slice("x", 33, 32)).alias("x"))
    out = K.apply_channels(f, "track", "frame", "x", lambda x: K.lcn(x, KERNEL))
    return out.select("track", "frame", F.posexplode("x").alias("channel", "y")).select("track", "frame", "channel", F.posexplode("y").alias("bin", "v")).select("track", "frame", "channel", "bin", (F.round("v", 6) + 0.0).alias("value"))


@query("SELECT key, split_part(key, '_', 1) AS prefix FROM (SELECT DISTINCT key FROM tracks) WHERE split_part(key, '_', 1) IN (SELECT DISTINCT subset FROM tracks WHERE subset < 'm')")
def prefix_filter(spark: SparkSession, d: str) -> DataFrame:
    """Keys whose part before the first underscore is in a list of subsets."""
    wanted = table(spark, d, "tracks").where("subset < 'm'").select(F.col("subset").alias("prefix")).distinct()
    keys = table(spark, d, "tracks").select("key").distinct().withColumn("prefix", F.substring_index("key", "_", 1))
    return keys.join(wanted, "prefix", "left_semi").select("key", "prefix")


@query()
def predict_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Posteriors of a network over the tiles of every track, decoded with three penalties."""
    from partita.operators.models import MODELS

    tiles = S.tiles(frames(spark, d), "track", ["frame"], "x", 8).select("track", "frame", F.flatten("tile").alias("x"))
    return M.predict_sweep(tiles, ["track"], "frame", F.col("frame") / 20.0, "x", (1, 8, 64), MODELS["chords_S"](frames=8, bins=64), [-1.0, -4.0, -8.0])
