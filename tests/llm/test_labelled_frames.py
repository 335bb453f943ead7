"""Problem 4 draws from the labelled frames of chord_frames."""

import math
from datetime import datetime, timedelta

import pytest
from oracle import connect

from partita.llm import queries as Q
from partita.plans.sqltext import chord_sql

T0 = datetime(2020, 1, 1)

#: The definition of TESTDATA, written apart from the registered SQL.
LABELLED = f"""WITH latest AS (SELECT key, frame, arg_max(struct_pack(l := chord_labels), ingested_at) AS v FROM chord_frames GROUP BY key, frame),
c AS (SELECT key, frame, {chord_sql('v.l')} AS c FROM latest WHERE v.l IS NOT NULL),
f AS (SELECT key, frame, CASE WHEN contains(c, ':') THEN split_part(c, ':', 2) ELSE c END AS quality FROM c)
"""


def test_latest_row_of_a_frame_holds(spark, tmp_path):
    rows = [("a", 0, "C:maj", 0), ("a", 0, "D:min", 5), ("a", 1, "N", 1), ("a", 2, "G:7", 1), ("a", 2, None, 3), ("b", 0, "Eb", 2), ("b", 0, "Eb", 2), ("b", 7, "x", 0)]
    df = spark.createDataFrame([(k, f, f / 10, c, T0 + timedelta(seconds=t)) for k, f, c, t in rows], "key string, frame int, time_point double, chord_labels string, ingested_at timestamp_ntz")
    df.write.parquet(f"{tmp_path}/chord_frames.parquet")
    got = sorted(tuple(r) for r in Q._labelled(spark, str(tmp_path)).collect())
    assert got == [("a", 0, "min"), ("a", 1, "N"), ("b", 0, "maj"), ("b", 7, "X")]


@pytest.mark.parametrize("d", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_against_the_definition(spark, sf, d):
    c = connect(d)
    want = {(k, f): q for k, f, q in c.execute(LABELLED + "SELECT key, frame, quality FROM f").fetchall()}
    n = len(want) // 4
    have = {}
    for q in want.values():
        have[q] = have.get(q, 0) + 1
    short = {q for q, s, m in c.execute("SELECT * FROM quality_targets").fetchall() if have.get(q, 0) < max(math.ceil(s * n), m)}
    report = Q.p4_report(spark, d).collect()
    assert {r.quality: r.available for r in report} == {r.quality: have.get(r.quality, 0) for r in report}
    assert {r.quality for r in Q.p4_found(spark, d).collect()} == short
    sample = Q.p4_sample(spark, d).collect()
    assert len({(r.key, r.frame) for r in sample}) == len(sample) == sum(r.quota for r in report)
    assert all(want[r.key, r.frame] == r.quality for r in sample)
