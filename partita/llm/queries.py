"""Queries of the training-data problems (pN_...) and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partita.functions.chords import canonical_chord, chord_quality, with_canonical_chord
from partita.llm.groups import ARTICLES, PLACEHOLDERS, assign_splits, connected_groups, latest_rows, related_links
from partita.llm.leaks import leaked_passages
from partita.llm.mixing import mix, shortfalls
from partita.llm.overlap import cross_split_cases
from partita.llm.runs import collapse_runs
from partita.llm.sampling import stratified_sample
from partita.llm.spam import spam_pages
from partita.plans.sqltext import CHORD_SQL, chord_sql
from partita.session import cut_lineage, table

#: Problem 2: splits and their shares of the keys.
SPLITS, SHARES = ["train", "valid", "test"], [0.6, 0.2, 0.2]


def p1_cases(spark: SparkSession, d: str) -> DataFrame:
    """Every overlap of a held-out record with its fold's train split, with kind and overlap fraction."""
    return cross_split_cases(table(spark, d, "chord_entities"), table(spark, d, "split_keys"), "ingested_at")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a fold that are the same key or the same recording on both sides of the split."""
    return p1_cases(spark, d).select("fold", "key_a", "key_b").distinct()


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Number of pairs per fold, held-out split, subset and kind."""
    return p1_cases(spark, d).groupBy("fold", "split", "subset", "kind").agg(F.count_distinct("key_a", "key_b").alias("n_pairs"))


def _entities(spark: SparkSession, d: str) -> DataFrame:
    chords = F.transform(F.col("chord_labels"), canonical_chord).alias("chords")
    return cut_lineage(latest_rows(table(spark, d, "chord_entities"), "key", "ingested_at", chords))


def _groups(spark: SparkSession, d: str) -> DataFrame:
    """(node, root) for every key; a key without relatives is its own group."""
    e = _entities(spark, d)
    found = connected_groups(related_links(e, table(spark, d, "tracks")))
    return e.select(F.col("key").alias("node")).join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Keys of groups of at least two related keys, with the smallest key of the group."""
    e = _entities(spark, d)
    return connected_groups(related_links(e, table(spark, d, "tracks"))).select(F.col("node").alias("key"), F.col("root").alias("group_key"))


def p2_splits(spark: SparkSession, d: str) -> DataFrame:
    """Every key with its group and its split, 60/20/20."""
    return assign_splits(cut_lineage(_groups(spark, d)), SPLITS, SHARES).select(F.col("node").alias("key"), F.col("root").alias("group_key"), "split")


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    """(key, frame, quality) of every labelled frame of the recordings: the latest row of each (key, frame), then without null labels."""
    rows = table(spark, d, "chord_frames").where("key is not null and frame is not null")
    # per (key, frame), so that a key with very many frames is spread over the tasks
    latest = rows.groupBy("key", "frame").agg(F.max(F.struct("ingested_at", F.col("chord_labels").alias("label"))).alias("r"))
    frames = latest.select("key", "frame", "r.label").where("label is not null")
    return with_canonical_chord(frames, "label", "chord").select("key", "frame", chord_quality(F.col("chord")).alias("quality"))


def p4_sample(spark: SparkSession, d: str) -> DataFrame:
    """(key, frame, quality) of the drawn frames."""
    return stratified_sample(_labelled(spark, d), "quality", ["key", "frame"], table(spark, d, "quality_targets"), 0.25)[0]


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """What exists, is wanted and is drawn of each quality."""
    return stratified_sample(_labelled(spark, d), "quality", ["key", "frame"], table(spark, d, "quality_targets"), 0.25)[1]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Qualities whose target cannot be met, by the report that the sample's quotas come from."""
    return p4_report(spark, d).where("short").select("quality")


def p6_events(spark: SparkSession, d: str) -> DataFrame:
    """Every run of every key: chord, first frame, number of frames, duration in seconds by time_point."""
    rows = with_canonical_chord(table(spark, d, "chord_frames"), "chord_labels", "chord")
    r = collapse_runs(rows, "key", "frame", "chord", "ingested_at", "time_point")
    return r.select("key", F.col("value").alias("chord"), F.col("first_pos").alias("first_frame"), F.col("n").cast("int").alias("n_frames"), F.round(F.col("end_time") - F.col("start_time"), 6).alias("duration"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Runs of at least two frames."""
    return p6_events(spark, d).where("n_frames >= 2").select("key", "first_frame", "n_frames")


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Every document with the items it leaks, the edits of the best passage and the longest exact run."""
    return leaked_passages(table(spark, d, "documents"), table(spark, d, "heldout_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Leaks with an exact passage of at least twelve words."""
    return p7_leaks(spark, d).where("edits = 0").select("doc_id", "item_id").distinct()


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """How many documents each leaked item is in."""
    return p7_leaks(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("edits") == 0).alias("n_exact"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Quota, available and drawn tokens and actual share of each source."""
    return mix(table(spark, d, "documents"), table(spark, d, "source_weights"))[1]


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The selected texts and how often each is used."""
    return mix(table(spark, d, "documents"), table(spark, d, "source_weights"))[0]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources whose quota the largest flow leaves unfilled."""
    return shortfalls(table(spark, d, "documents"), table(spark, d, "source_weights")).where("short").select("source")


def p9_pages(spark: SparkSession, d: str) -> DataFrame:
    """Sentences, coverage and verdict of every page."""
    return spam_pages(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Spam pages."""
    return p9_pages(spark, d).where("is_spam").select("doc_id").distinct()


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p2_found, p2_splits, p4_found, p4_report, p4_sample, p6_found, p6_events, p7_found, p7_leaks, p7_items, p8_found, p8_report, p8_mixture, p9_found, p9_pages)}

_P4 = f"""
WITH latest AS (SELECT key, frame, arg_max(struct_pack(l := chord_labels), ingested_at) AS v FROM chord_frames GROUP BY key, frame),
named AS (SELECT {chord_sql('v.l')} AS c FROM latest WHERE v.l IS NOT NULL),
q AS (SELECT CASE WHEN contains(c, ':') THEN split_part(c, ':', 2) ELSE c END AS quality, count(*) AS m FROM named GROUP BY 1),
size AS (SELECT floor((SELECT count(*) FROM named) / 4) AS n),
r AS (SELECT t.quality, coalesce(q.m, 0) AS available, CAST(greatest(ceil(t.target_share * size.n), t.min_frames) AS BIGINT) AS wanted
      FROM quality_targets t CROSS JOIN size LEFT JOIN q ON q.quality = t.quality)
"""
_P2 = f"""
WITH RECURSIVE ent AS (SELECT key, arg_max(struct_pack(l := chord_labels), ingested_at) AS v FROM chord_entities WHERE key IS NOT NULL GROUP BY key),
lab AS (SELECT key, i, {chord_sql('lab')} AS c FROM (SELECT key, unnest(v.l) AS lab, generate_subscripts(v.l, 1) AS i FROM ent)),
named AS (SELECT * FROM lab WHERE c LIKE '%:%' AND c NOT LIKE '?%'),
kept AS (SELECT * FROM (SELECT *, lag(c) OVER (PARTITION BY key ORDER BY i) AS p FROM named) WHERE p IS DISTINCT FROM c),
rooted AS (SELECT *, CAST(split_part(c, ':', 1) AS INT) AS r, first_value(CAST(split_part(c, ':', 1) AS INT)) OVER (PARTITION BY key ORDER BY i) AS r0 FROM kept),
comp AS (SELECT key, 'c ' || string_agg(CAST((r - r0 + 12) % 12 AS VARCHAR) || ':' || split_part(c, ':', 2), ' ' ORDER BY i) AS att FROM rooted GROUP BY key HAVING count(DISTINCT c) >= 3),
art AS (SELECT DISTINCT key, strip_accents(lower(artist)) AS a FROM tracks WHERE artist IS NOT NULL AND key IN (SELECT key FROM ent)),
word AS (SELECT key, regexp_extract_all(a, '[\\p{{L}}\\p{{N}}]+') AS w, regexp_extract_all(regexp_extract(a, '^(.*),', 1), '[\\p{{L}}\\p{{N}}]+') AS h, regexp_extract_all(CASE WHEN contains(a, ',') THEN regexp_extract(a, ',([^,]*)$', 1) ELSE '' END, '[\\p{{L}}\\p{{N}}]+') AS t FROM art),
name AS (SELECT key, 'a ' || array_to_string(list_sort(CASE WHEN len(t) > 0 AND list_contains({list(ARTICLES)!r}, t[1]) THEN list_concat(h, t[2:]) WHEN len(w) > 1 AND list_contains({list(ARTICLES)!r}, w[1]) THEN w[2:] ELSE w END), ' ') AS att FROM word WHERE NOT list_contains({list(PLACEHOLDERS)!r}, array_to_string(w, ' '))),
attr AS (SELECT key, 't ' || regexp_replace(key, '_[^_]*$', '') AS att FROM ent UNION SELECT * FROM comp UNION SELECT * FROM name),
star AS (SELECT a.key AS b, m.key AS a FROM attr a JOIN (SELECT att, min(key) AS key FROM attr GROUP BY att) m USING (att) WHERE a.key <> m.key),
link AS (SELECT a, b FROM star UNION SELECT b, a FROM star),
reach AS (SELECT a AS node, a AS root FROM link UNION SELECT link.b, reach.root FROM reach JOIN link ON link.a = reach.node WHERE reach.root < link.b)
SELECT node AS key, min(root) AS group_key FROM reach GROUP BY node
"""
_P6 = f"""
WITH latest AS (SELECT key, frame, arg_max(struct_pack(c := {CHORD_SQL}, t := time_point), ingested_at) AS v FROM chord_frames GROUP BY key, frame),
k AS (SELECT key, frame, v.c AS c, v.t AS t FROM latest WHERE v.c IS NOT NULL),
b AS (SELECT *, CASE WHEN lag(c) OVER (PARTITION BY key ORDER BY frame) = c THEN 0 ELSE 1 END AS s FROM k),
r AS (SELECT *, sum(s) OVER (PARTITION BY key ORDER BY frame ROWS UNBOUNDED PRECEDING) AS i FROM b),
ev AS (SELECT key, c AS chord, min(frame) AS first_frame, CAST(count(*) AS INT) AS n_frames, round(max(t) - min(t), 6) AS duration FROM r GROUP BY key, c, i)
"""
SQL = {
    "p2_found": _P2,
    "p4_found": _P4 + "SELECT quality FROM r WHERE available < wanted",
    "p6_events": _P6 + "SELECT * FROM ev",
    "p6_found": _P6 + "SELECT key, first_frame, n_frames FROM ev WHERE n_frames >= 2",
}
