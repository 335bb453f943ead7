"""Queries of the general training-data problems (3 and 5) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partita.functions.chords import with_canonical_chord
from partita.operators.balanced import key_summary
from partita.operators.coverage import interval_rows, periods_and_gaps
from partita.plans.sqltext import CHORD_SQL
from partita.session import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Covered periods and gaps of every key of range_annotations."""
    return periods_and_gaps(interval_rows(table(spark, d, "range_annotations"))).distinct()


def p3_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Per key: number of periods and gaps, covered and missing milliseconds."""
    is_gap = F.col("kind") == "gap"
    length = F.col("end_ms") - F.col("start_ms")
    return p3_found(spark, d).groupBy("key").agg(
        F.count_if(~is_gap).alias("n_periods"),
        F.count_if(is_gap).alias("n_gaps"),
        F.sum(F.when(is_gap, 0).otherwise(length)).alias("covered_ms"),
        F.sum(F.when(is_gap, length).otherwise(0)).alias("gap_ms"),
    )


def p5_key_summary(spark: SparkSession, d: str) -> DataFrame:
    """Frames, rows, most frequent chord and chord changes of every key of chord_frames; which keys are hot."""
    return key_summary(table(spark, d, "chord_frames"), "key", "frame", "chord_labels", "ingested_at", with_canonical_chord)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Keys that hold at least 2 % of all rows of chord_frames."""
    return p5_key_summary(spark, d).where("is_hot").select("key")


QUERIES = {f.__name__: f for f in (p3_found, p3_coverage, p5_found, p5_key_summary)}

_P3 = """
WITH iv AS (SELECT key, unnest(intervals) AS v FROM range_annotations),
ms AS (SELECT key, CAST(round(v.start * 1000) AS BIGINT) AS s, CAST(round(v."end" * 1000) AS BIGINT) AS e FROM iv
       WHERE v.start IS NOT NULL AND v."end" IS NOT NULL),
ok AS (SELECT DISTINCT key, s, e FROM ms WHERE e > s),
far AS (SELECT *, max(e) OVER (PARTITION BY key ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ok),
isl AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM far),
per AS (SELECT key, i, min(s) AS start_ms, max(e) AS end_ms FROM isl GROUP BY key, i),
nxt AS (SELECT *, lead(start_ms) OVER (PARTITION BY key ORDER BY start_ms) AS after FROM per),
found AS (SELECT key, 'period' AS kind, start_ms, end_ms FROM per
          UNION ALL SELECT key, 'gap', end_ms, after FROM nxt WHERE after > end_ms)
"""
_LATEST = f"""
WITH latest AS (SELECT key, frame, arg_max(coalesce({CHORD_SQL}, '~'), ingested_at) AS c, count(*) AS n FROM chord_frames GROUP BY key, frame),
v AS (SELECT key, frame, n, nullif(c, '~') AS c FROM latest)
"""
SQL = {
    "p3_found": _P3 + "SELECT key, kind, start_ms, end_ms FROM found",
    "p3_coverage": _P3
    + """SELECT key, count(*) FILTER (kind = 'period') AS n_periods, count(*) FILTER (kind = 'gap') AS n_gaps,
    CAST(sum(CASE WHEN kind = 'period' THEN end_ms - start_ms ELSE 0 END) AS BIGINT) AS covered_ms,
    CAST(sum(CASE WHEN kind = 'gap' THEN end_ms - start_ms ELSE 0 END) AS BIGINT) AS gap_ms FROM found GROUP BY key""",
    "p5_found": "SELECT key FROM chord_frames GROUP BY key HAVING count(*) >= 0.02 * (SELECT count(*) FROM chord_frames)",
    "p5_key_summary": _LATEST
    + """, tot AS (SELECT key, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_frames FROM v GROUP BY key),
    chg AS (SELECT key, CAST(sum(CASE WHEN p IS NOT NULL AND p <> c THEN 1 ELSE 0 END) AS BIGINT) AS n_changes FROM
        (SELECT key, c, lag(c) OVER (PARTITION BY key ORDER BY frame) AS p FROM v WHERE c IS NOT NULL) GROUP BY key),
    cnt AS (SELECT key, c, count(*) AS m FROM v WHERE c IS NOT NULL GROUP BY key, c),
    best AS (SELECT key, c AS top_value, m AS n_top FROM cnt QUALIFY row_number() OVER (PARTITION BY key ORDER BY m DESC, c) = 1)
    SELECT tot.key, n_rows, n_frames, top_value, n_top, coalesce(n_changes, 0) AS n_changes,
    n_rows >= 0.02 * (SELECT count(*) FROM chord_frames) AS is_hot
    FROM tot LEFT JOIN best USING (key) LEFT JOIN chg USING (key)""",
}
