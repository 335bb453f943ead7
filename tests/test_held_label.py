"""Labels of points where intervals overlap and nest."""

import random

import pytest
from oracle import same

from partita.operators.intervals import held_label
from partita.plans import extra_queries as X

#: The rule of SURVEY J3 as a range join, written apart from the registered SQL.
HELD = """(SELECT pt.key, pt.frame, pt.t, coalesce(max(struct_pack(s := o.s, e := o.e, label := o.label)).label, 'N') AS label
FROM pt LEFT JOIN (SELECT * FROM ms WHERE e > s {0}) o ON pt.key = o.key AND pt.t >= o.s AND pt.t < o.e GROUP BY ALL)"""


def test_frame_in_the_outer_interval_after_a_nested_one(spark):
    points = spark.createDataFrame([("k", t) for t in (0, 5, 10, 19, 20, 29, 30, 99, 100, -7)], "k string, t bigint")
    ivs = spark.createDataFrame([("k", 0, 100, "outer"), ("k", 10, 20, "inner"), ("k", 20, 30, "a"), ("k", 20, 25, "b"), ("j", -9, 999, "other")], "k string, s bigint, e bigint, label string")
    want = {0: "outer", 5: "outer", 10: "inner", 19: "inner", 20: "a", 29: "a", 30: "outer", 99: "outer", 100: "N", -7: "N"}
    for width in (1, 7, 1000):
        assert {t: x for _, t, x in held_label(points, ivs, "k", "t", width).collect()} == want


def test_against_every_interval(spark):
    rng = random.Random(8)
    pts = [(rng.choice("ab"), i, rng.randrange(-50, 400)) for i in range(400)] + [(None, 900, 5), ("a", 901, None), ("c", 902, 3)]
    ivs = [(rng.choice("ab"), s, s + rng.randrange(1, 120), rng.choice("xyz")) for s in (rng.randrange(-90, 380) for _ in range(90))] + [("a", -(10**12), 10**12, "all")]
    want = set()
    for k, i, t in pts:
        held = [] if k is None or t is None else [(s, e, x) for j, s, e, x in ivs if j == k and s <= t < e]
        want.add((k, i, t, max(held)[2] if held else "N"))
    df = spark.createDataFrame(pts, "k string, i int, t bigint")
    iv = spark.createDataFrame(ivs, "k string, s bigint, e bigint, label string")
    for width in (9, 100_000):
        got = [tuple(r) for r in held_label(df, iv, "k", "t", width).collect()]
        assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("d", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_imports_against_a_range_join(spark, sf, d):
    same(X.import_labels(spark, d), f"WITH {X._ANN} SELECT * FROM " + HELD.format(""), d)
    a, b = (HELD.format(f"AND annotator = '{x}'") for x in ("ann_a", "ann_b"))
    same(X.import_two_annotators(spark, d), f"WITH {X._ANN}, a AS {a}, b AS {b} SELECT key, frame, t, a.label AS first, b.label AS second FROM a JOIN b USING (key, frame, t)", d)
