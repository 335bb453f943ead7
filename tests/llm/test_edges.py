"""Nulls, repeats, long texts, clashing names and empty tables for the operators of problems 1, 2, 7, 8 and 9."""

from datetime import datetime

from pyspark.sql import functions as F

from partita.llm import groups as G
from partita.llm import leaks as L
from partita.llm import mixing as M
from partita.llm import overlap as O

T0 = datetime(2020, 1, 1)


def test_latest_rows(spark):
    rows = [("a", T0, "old", 1), ("a", datetime(2021, 1, 1), "new", 1), ("a", None, "none", 1), ("b", None, "only", 1), (None, T0, "x", 1)]
    df = spark.createDataFrame(rows, "key string, ingested_at timestamp_ntz, v string, __extra int")
    got = {r.key: r.v for r in G.latest_rows(df, "key", "ingested_at", F.col("v")).collect()}
    assert got == {"a": "new", "b": "only"}


def test_related_links_with_dirty_tables(spark):
    ents = spark.createDataFrame([("s_t1_01", ["0:maj", "2:min", "5:7"], 1), ("s_t1_02", None, 1), ("s_t2_01", ["3:maj", "3:maj", "5:min", None, "8:7"], 1), ("s_t3_01", [], 1), ("s_t4_01", ["?x", "N", "X"], 1), ("s_t5_01", None, 1)], "key string, chords array<string>, at int")
    tracks = spark.createDataFrame([("s_t3_01", "The Ab Cd", 5), ("s_t4_01", "cd, AB", 5), ("s_t4_01", None, 5), (None, "Ab Cd", 5), ("s_t5_01", "Unknown", 5), ("gone", "Ab Cd", 5), ("s_t3_01", "The Ab Cd", 5)], "key string, artist string, b int")
    got = {r.node: r.root for r in G.connected_groups(G.related_links(ents, tracks)).collect()}
    assert got == {"s_t1_01": "s_t1_01", "s_t1_02": "s_t1_01", "s_t2_01": "s_t1_01", "s_t3_01": "s_t3_01", "s_t4_01": "s_t3_01"}
    assert G.connected_groups(G.related_links(ents.limit(0), tracks.limit(0))).count() == 0


def test_long_chain_and_hub(spark):
    names = [f"n{i:05d}" for i in range(400)]
    links = list(zip(names, names[1:])) + [("a_hub", n) for n in names[::7]]
    got = {r.root for r in G.connected_groups(spark.createDataFrame(links, "a string, b string"), 3).collect()}
    assert got == {"a_hub"}


def test_records_of_odd_shapes(spark):
    good = [[[float((i * 7 + j * j) % 5) for j in range(12)] for i in range(20)]]
    rows = [("a", good), ("b", good), ("c", [[None] * 9]), ("d", [[]]), ("e", []), ("f", [None]), ("g", None), ("h", [[[float("nan")] * 12] * 10]), ("i", [[[1.0, 2.0]] * 10]), (None, good)]
    df = spark.createDataFrame(rows, "key string, cqt array<array<array<float>>>")
    pairs, members = O.similar_pairs(O.prepared_records(df).withColumn("sides", F.lit(3)))
    assert {r.key: r.rep for r in members.collect()} == {"a": "a", "b": "a"}
    assert pairs.count() == 0


def test_leaks_in_long_texts_with_clashing_names(spark):
    words = " ".join(f"w{i}" for i in range(40))
    far = "filler " * 60_000 + words
    docs = spark.createDataFrame([(1, far, 9, 9), (1, far, 9, 9), (None, words, 9, 9), (2, None, 9, 9)], "doc_id bigint, text string, item_id int, edits int")
    items = spark.createDataFrame([(7, words, "x"), (None, words, "x"), (8, None, "x"), (7, words, "x")], "item_id bigint, text string, doc_id string")
    got = sorted(map(tuple, L.leaked_passages(docs, items).collect()), key=repr)
    assert got == sorted([(1, 7, 0, 40), (1, 7, 0, 40), (None, 7, 0, 40)], key=repr)
    assert L.leaked_passages(docs.limit(0), items).count() == 0
    assert L.leaked_passages(docs, items.limit(0)).count() == 0


def test_mixture_with_a_hot_text(spark):
    rows = [(i, "same words here", "big") for i in range(300)] + [(1000 + i, f"other {i} text " * 2000 if i == 0 else f"other {i}", "small") for i in range(50)] + [(None, "no id", "small")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    w = spark.createDataFrame([("big", 0.9, 1), ("small", 0.1, 1), (None, 0.0, 1)], "source string, target_weight double, max_repeats int")
    sel, rep = M.mix(df, w)
    uses = {r.doc_id: r.uses for r in sel.where("source = 'big'").collect()}
    assert set(uses) == {0} and 0 < uses[0] <= 300
    r = {x.source: x for x in rep.collect()}
    assert r["big"].short and r["big"].drawn == r["big"].available
