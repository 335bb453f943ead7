"""Problem 2: union-find and group splits against plain versions."""

import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from partita.functions.chords import canonical_chord
from partita.llm import groups as G
from partita.llm.queries import p2_found, p2_splits


def components(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_connected_groups(spark):
    rng = random.Random(3)
    for per_task in (5, 40, 10_000):
        links = [(f"n{rng.randrange(300):03d}", f"n{rng.randrange(300):03d}") for _ in range(180)] + [("hub", f"n{i:03d}") for i in range(60)] + [(None, "n000"), ("loop", "loop"), ("chain00", "chain01")]
        links += [(f"chain{i:02d}", f"chain{i + 1:02d}") for i in range(40)]
        got = {r.node: r.root for r in G.connected_groups(spark.createDataFrame(links, "a string, b string"), per_task).collect()}
        assert got == components(links)
    assert G.connected_groups(spark.createDataFrame([], "a string, b string")).count() == 0


def test_artist_names(spark):
    same = ["Zavoka Kudubu Quartet", "zavoka_kudubu_quartet", "The Zavoka  Kudubu Quartet ", "Kudubu Quartet, Zavoka", "Závöka-Kudubu Quartet", "ZAVOKA KUDUBU QUARTET!"]
    none = [None, "", " ", "-", "???", "Unknown", "unknown artist", "N/A", "Various Artists", "V.A."]
    df = spark.createDataFrame([(str(i), a) for i, a in enumerate(same + none)], "key string, artist string")
    got = [r.artist for r in G.artist_names(df).orderBy(F.col("key").cast("int")).collect()]
    assert len(set(got[: len(same)])) == 1 and got[0]
    assert got[len(same) :] == [None] * len(none)


def test_composition(spark):
    rows = [["C", "C", "F:maj", None, "N", "G:7"], ["D:maj", "G", "X", "A:7", "A:7/3"], ["C", "F:min", "G:7"], ["C", "G", "C"], None, []]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, l array<string>")
    got = [r[0] for r in df.select(G.composition_signature(F.transform("l", canonical_chord)), "i").orderBy("i").collect()]
    assert got[0] == got[1] is not None
    assert got[2] not in (None, got[0])
    assert got[3:] == [None, None, None]


def test_found_equals_brute_force(spark, sf):
    import unicodedata

    import regex

    ents = {}
    for r in spark.read.parquet(f"{sf}/chord_entities.parquet").select("key", "ingested_at", F.transform("chord_labels", canonical_chord).alias("c")).collect():
        if r.key not in ents or r.ingested_at > ents[r.key][0]:
            ents[r.key] = (r.ingested_at, r.c)
    at = defaultdict(list)
    for k, (_, c) in ents.items():
        at["tape", k.rsplit("_", 1)[0]].append(k)
        seq = [x for x in c or [] if x and ":" in x]
        seq = [x for i, x in enumerate(seq) if not i or x != seq[i - 1]]
        if len(set(seq)) >= 3:
            r0 = int(seq[0].split(":")[0])
            at["comp", tuple(((int(x.split(":")[0]) - r0) % 12, x.split(":")[1]) for x in seq)].append(k)
    for r in spark.read.parquet(f"{sf}/tracks.parquet").select("key", "artist").distinct().collect():
        if r.key in ents and r.artist:
            plain = "".join(x for x in unicodedata.normalize("NFKD", r.artist).lower() if not unicodedata.combining(x))
            w = regex.findall(r"[\p{L}\p{N}]+", plain)
            if w and w[0] == "the":
                w = w[1:]
            if " ".join(w) not in ("", "unknown", "unknown artist", "various artists", "n a", "v a"):
                at["artist", tuple(sorted(w))].append(r.key)
    want = components([(g[0], k) for g in at.values() for k in g[1:]])
    got = {r.key: r.group_key for r in p2_found(spark, sf).collect()}
    assert got == want


def test_splits_keep_groups(spark, sf):
    rows = p2_splits(spark, sf).collect()
    by = defaultdict(set)
    for r in rows:
        by[r.group_key].add(r.split)
    assert all(len(s) == 1 for s in by.values())
    assert len(rows) == len({r.key for r in rows})
    # the splits' sizes are those of the greedy over the groups, one by one
    n = Counter(r.split for r in rows)
    sizes = sorted(Counter(r.group_key for r in rows).values(), reverse=True)
    assert n == {k: v for k, v in zip(("train", "valid", "test"), greedy(sizes, [Fraction(x, 10) * len(rows) for x in (6, 2, 2)])[1]) if v}


def greedy(sizes, targets):
    """([how many groups of each size each split took], [rows of each split])."""
    left, took = list(targets), [Counter() for _ in targets]
    for size in sorted(sizes, reverse=True):
        k = max(range(len(left)), key=lambda i: (left[i], -i))
        left[k] -= size
        took[k][size] += 1
    return took, [sum(s * m for s, m in t.items()) for t in took]


@pytest.mark.parametrize("groups", [1, 3, 40, 1000, 10_000])
def test_fill_is_greedy(groups):
    rng = random.Random(groups)
    for top in (1, 2, 9, 400):
        for shares in ((6, 2, 2), (1, 1, 1), (9, 1, 0), (5, 3, 1, 1), (1,)):
            sizes = [min(top, int(rng.paretovariate(1))) for _ in range(groups)]
            targets = [Fraction(x, sum(shares)) * sum(sizes) for x in shares]
            got = [Counter() for _ in shares]
            for size, k, m in G._fill(list(Counter(sizes).items()), targets):
                got[k][size] += m
            assert got == greedy(sizes, targets)[0]


def test_equal_groups_meet_the_shares(spark):
    df = spark.createDataFrame([(f"n{i}", f"n{i}") for i in range(1000)], "node string, root string")
    got = Counter(r.split for r in G.assign_splits(df, ["a", "b", "c"], [0.6, 0.2, 0.2]).collect())
    assert got == {"a": 600, "b": 200, "c": 200}


def test_empty_splits(spark):
    assert G.assign_splits(spark.createDataFrame([], "node string, root string"), ["a", "b"], [0.5, 0.5]).count() == 0
