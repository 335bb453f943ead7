"""Problem 5: balanced per-key summaries against a plain count."""

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

from partita.functions.chords import with_canonical_chord
from partita.operators.balanced import key_summary

SCHEMA = "key string, frame int, chord_labels string, ingested_at timestamp_ntz, value string, pid int"
T0 = datetime(2020, 1, 1)


def brute(rows):
    by, n = defaultdict(dict), Counter()
    for key, frame, label, t, *_ in rows:
        n[key] += 1
        if frame not in by[key] or t > by[key][frame][0]:
            by[key][frame] = (t, label)
    out = {}
    for key, frames in by.items():
        seq = [frames[f][1] for f in sorted(frames, key=lambda f: (f is not None, f or 0)) if frames[f][1] is not None]
        c = Counter(seq)
        top = min(c, key=lambda v: (-c[v], v)) if c else None
        out[key] = (n[key], len(frames), top, c[top] if c else None, sum(a != b for a, b in zip(seq, seq[1:])), n[key] >= 0.02 * len(rows))
    return out


def run(spark, rows, chunk):
    df = spark.createDataFrame(rows, SCHEMA)
    got = key_summary(df, "key", "frame", "chord_labels", "ingested_at", lambda d, a, b: d.withColumn(b, d[a]), chunk_rows=chunk).collect()
    return {r[0]: tuple(r[1:]) for r in got}


def test_random_skewed(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.6 else rng.choice(["a", "b", None, *map(str, range(60))]), rng.randrange(0, 300), rng.choice(["C", "D", "E", None]), T0 + timedelta(seconds=i), "clash", 7) for i in range(3000)]
    for chunk in (7, 100, 50_000):
        assert run(spark, rows, chunk) == brute(rows)


def test_nulls_and_empty(spark):
    rows = [("a", None, "C", T0, None, None), ("a", None, "D", T0 + timedelta(1), None, None), ("b", 1, None, T0, None, None)]
    assert run(spark, rows, 10) == brute(rows)
    assert run(spark, [], 10) == {}


def test_chord_parser_agrees_with_itself(spark):
    from pyspark.sql import functions as F

    from partita.functions.chords import canonical_chord

    labels = ["C:maj", " c:MAJ ", "B#", "Dbb:maj/3", "C:maj(9)", "N", "n.c.", "NC", " x", "Ebb:min7", "A♭♭:7", "B♭♭:min", "bb:hdim7", "b", "", "H:maj", "C:", "?", None, "C/5"]
    df = spark.createDataFrame([(x,) for x in labels], "label string")
    a = [r[0] for r in df.select(canonical_chord(F.col("label"))).collect()]
    b = [r[0] for r in with_canonical_chord(df, "label", "c").select("c").collect()]
    assert a == b
    assert a == ["0:maj", "0:maj", "0:maj", "0:maj", "0:maj", "N", "N", "N", "X", "2:min7", "7:7", "9:min", "10:hdim7", "11:maj", "?", "?h:maj", "0:maj", "??", None, "0:maj"]
