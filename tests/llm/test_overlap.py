"""Problem 1 against all pairs."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from partita.llm import overlap as O

E_SCHEMA = "key string, cqt array<array<array<float>>>, fold int"
S_SCHEMA = "subset string, fold string, split string, key string, cqt string"


def entity(key, x):
    return (key, None if x is None else [[[float(v) for v in f] for f in x]], 1)


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(5)
    base = {f"k{i:03d}": np.abs(rng.normal(size=(rng.integers(12, 30), 12))).astype(np.float32) for i in range(60)}
    for m in base.values():
        m[np.arange(len(m)), rng.integers(0, 12, len(m))] += 2
    copies = {}
    for i, (k, m) in enumerate(list(base.items())[:24]):
        kind = i % 4
        if kind == 0:
            copies[f"c{i:03d}"] = m.copy()
        elif kind == 1:
            copies[f"c{i:03d}"] = m * 1.7 + np.abs(rng.normal(size=m.shape)).astype(np.float32) * 0.08
        elif kind == 2:
            copies[f"c{i:03d}"] = np.concatenate([np.zeros((2, 12), np.float32), m])
        else:
            n = m * 0.5
            n[3] = 0
            copies[f"c{i:03d}"] = n[1:]
    base |= copies
    base["zero"] = np.zeros((12, 12), np.float32)
    base["short"] = base["k000"][:6]
    return base


def records(df):
    return O.prepared_records(df).withColumn("sides", F.lit(3))


@pytest.mark.parametrize("frequent", [O.FREQUENT, 2])
def test_pairs_equal_brute_force(spark, corpus, monkeypatch, frequent):
    monkeypatch.setattr(O, "FREQUENT", frequent)
    want = {(a, b) for a, b in combinations(sorted(corpus), 2) if O.best_match(corpus[a].astype(float), corpus[b].astype(float)) >= O.MIN_COSINE}
    df = spark.createDataFrame([entity(k, m) for k, m in corpus.items()] + [entity("none", None)], E_SCHEMA)
    pairs, members = O.similar_pairs(records(df))
    rep = {r.key: r.rep for r in members.collect()}
    links = {(r.ra, r.rb) for r in pairs.collect()}
    got = {(a, b) for a, b in combinations(sorted(rep), 2) if rep[a] == rep[b] or tuple(sorted((rep[a], rep[b]))) in links}
    assert len(want) >= 20
    # joined with sign bands, digests lose some noisy pairs
    assert got == want if frequent > 2 else got <= want and len(got) >= 0.9 * len(want)
    assert "zero" not in rep and "none" not in rep


def test_cases_of_folds(spark, corpus):
    df = spark.createDataFrame([entity(k, corpus[k]) for k in ("k000", "c000", "k001", "k002")] + [entity("zero", corpus["zero"])], E_SCHEMA)
    rows = [
        ("s", "0", "TRAIN ", "k000", "x"), ("s", "0", "val", "feat/a/c000.npz", "x"), ("s", "0", "train", "c000", "x"), ("s", "0", None, "k001", "x"),
        ("s", "1", "testing", "k000.npz", "x"), ("s", "1", "train", "missing", "x"), ("s", "1", "test", "c000", "x"), ("s", "2", "train", "zero", "x"), ("s", "2", "test", "zero", "x"), (None, None, "test", "k000", "x"),
    ]
    got = {tuple(r) for r in O.cross_split_cases(df, spark.createDataFrame(rows, S_SCHEMA)).select("fold", "key_a", "key_b").collect()}
    assert got == {("0", "c000", "c000"), ("0", "c000", "k000"), ("2", "zero", "zero")}


def test_empty(spark):
    df = spark.createDataFrame([], E_SCHEMA)
    assert O.cross_split_cases(df, spark.createDataFrame([], S_SCHEMA)).count() == 0


def test_file_key(spark):
    got = [r[0] for r in spark.createDataFrame([("a/b/x_1.npz",), ("x.tar.gz",), (".hidden",), (None,), ("x",)], "k string").select(O.file_key(F.col("k"))).collect()]
    assert got == ["x_1", "x.tar", ".hidden", None, "x"]


def brute_pairs(x):
    keys = sorted(k for k, v in x.items() if (np.abs(v).sum(axis=1) > 0).sum() >= O.MIN_FRAMES)
    return {(a, b) for a, b in combinations(keys, 2) if O.best_match(x[a], x[b]) >= O.MIN_COSINE}


def test_recall_on_whole_table(spark):
    """Against all pairs of sf0.01 (some 170,000); the least cosine of a true pair there is 0.99."""
    e = spark.read.parquet("/root/testdata/sf0.01/chord_entities.parquet")
    recs = O.prepared_records(e, "ingested_at").withColumn("sides", F.lit(3))
    x = {r.key: np.frombuffer(r.frames, np.float32).reshape(-1, 12).astype(float) for r in recs.collect()}
    want = brute_pairs(x)
    pairs, members = O.similar_pairs(recs)
    rep = {r.key: r.rep for r in members.collect()}
    links = {(r.ra, r.rb) for r in pairs.collect()}
    got = {(a, b) for a, b in combinations(sorted(rep), 2) if rep[a] == rep[b] or tuple(sorted((rep[a], rep[b]))) in links}
    assert len(want) > 30 and got <= want and len(got) >= 0.97 * len(want)


def test_constant_symbols_and_scattered_silence(spark):
    rng = np.random.default_rng(2)
    drone = np.abs(rng.normal(size=(20, 12))) * 0.3
    drone[:, 4] += 3
    noisy = drone * 1.3 + np.abs(rng.normal(size=drone.shape)) * 0.02
    gaps = np.abs(rng.normal(size=(24, 12)))
    gaps[2::3] = 0
    other = gaps * 0.7 + np.abs(rng.normal(size=gaps.shape)) * 0.01
    other[2::3] = 0
    df = spark.createDataFrame([entity(k, m) for k, m in (("a", drone), ("b", noisy), ("c", gaps), ("d", other))], E_SCHEMA)
    assert {(r.ra, r.rb) for r in O.similar_pairs(records(df))[0].collect()} == {("a", "b"), ("c", "d")}


def test_only_pairs_across_splits(spark, corpus):
    df = spark.createDataFrame([entity(k, corpus[k]) for k in ("k001", "c001")], E_SCHEMA)
    for a, b, n in ((1, 1, 0), (2, 2, 0), (1, 2, 1), (2, 1, 1), (3, 2, 1)):
        recs = O.prepared_records(df).withColumn("sides", F.when(F.col("key") == "k001", a).otherwise(b))
        assert O.similar_pairs(recs)[0].count() == n


def test_chunks_follow_content():
    """The chunks of a record are those of a longer one that holds it, but for its edges."""
    rng = np.random.default_rng(3)
    x = np.abs(rng.normal(size=(60, 12))).astype(np.float32)
    whole = O.cut_chunks(x, np.array([60]))
    part = O.cut_chunks(np.concatenate([x[:9], x[20:50]]), np.array([9, 30]))
    inner = {(d, a) for r, d, a in zip(*(c.tolist() for c in part[:3])) if r == 1}
    outer = {(d, a - 20) for d, a in zip(*(c.tolist() for c in whole[1:3]))}
    assert len(inner & outer) >= 0.8 * len(inner)
    assert all(O.MIN_CHUNK <= n <= O.MAX_CHUNK for n in part[3])
    # a third: chunks of other content are others
    assert not set(O.cut_chunks(np.abs(rng.normal(size=(60, 12))).astype(np.float32), np.array([60]))[1].tolist()) & set(whole[1].tolist())


def test_pairs_do_not_depend_on_how_many_records_there_are(spark, monkeypatch):
    """Three noisy versions of each record: what is found of one does not change with the chunks that others share."""
    rng = np.random.default_rng(11)
    x = {}
    for i in range(30):
        m = rng.exponential(size=(10, 12))
        for j in range(3):
            x[f"r{i:02d}{j}"] = np.abs(m + rng.normal(size=m.shape) * 0.2)
    want = brute_pairs({k: m.astype(np.float32).astype(float) for k, m in x.items()})

    def found(frequent, keys):
        monkeypatch.setattr(O, "FREQUENT", frequent)
        df = spark.createDataFrame([entity(k, x[k]) for k in keys], E_SCHEMA)
        return {(r.ra, r.rb) for r in O.similar_pairs(records(df))[0].collect()}

    whole = found(O.FREQUENT, x)
    assert len(want) >= 80 and whole <= want and len(whole) >= 0.95 * len(want)
    # as if each digest were one of a large table
    assert found(1, x) == whole
    assert found(1, [k for k in x if k < "r05"]) == {p for p in whole if p[1] < "r05"}


def test_little_is_shuffled(spark):
    """No more than a few times the tables, and frames as packed are the frames."""
    from pathlib import Path

    d = Path("/root/testdata/sf0.01")
    entities, splits = (spark.read.parquet(str(d / f"{t}.parquet")) for t in ("chord_entities", "split_keys"))
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = written()
    assert O.cross_split_cases(entities, splits, "ingested_at").count() > 0
    size = sum((d / f"{t}.parquet").stat().st_size for t in ("chord_entities", "split_keys"))
    assert written() - before < 8 * size


def test_packed_frames():
    x = np.random.default_rng(1).normal(size=(9, 12)).astype(np.float32)
    assert (O.unpack(O.pack(x.tobytes())) == x).all() and O.unpack(O.pack(b"")).shape == (0, 12)


def test_every_run_is_a_chunk_however_long_the_record():
    """The chunks of the first frames of a record are chunks of the whole record, at any length of either."""
    x = np.random.default_rng(7).exponential(size=(120, 12)).astype(np.float32)
    chunks = lambda n: set(zip(*(c.tolist() for c in O.cut_chunks(x[:n], np.array([n]))[1:3])))
    whole = chunks(120)
    for n in (5, 12, 16, 17, 24, 60):
        part = chunks(n)
        assert part <= whole and {a for _, a in part} == set(range(n - 4))


def test_copies_with_scattered_silence_at_any_length(spark):
    """Copies with every sixth, or every fifth, frame silent are found, in short records and in long ones."""
    rng = np.random.default_rng(8)
    rows, want = [], set()
    for i in range(60):
        x = rng.exponential(size=(14 + i % 3 * 8, 12))
        y = x * 0.7
        y[5 - i % 2 :: 6 - i % 2] = 0
        rows += [entity(f"r{i:02d}", x), entity(f"s{i:02d}", y)]
        want.add((f"r{i:02d}", f"s{i:02d}"))
        assert O.best_match(x, y) >= O.MIN_COSINE
    pairs = O.similar_pairs(records(spark.createDataFrame(rows, E_SCHEMA)))[0]
    assert {(r.ra, r.rb) for r in pairs.collect()} == want


def test_runs_around_silence():
    live = [np.array(k) for k in ([0, 1, 2, 4, 5, 6, 7, 10], [3, 5, 6, 7, 8], [0, 2], [2, 3, 4, 5, 9])]
    begins, want = np.cumsum([0, *map(len, live)]), set()
    for b, k in zip(begins, live):
        number = {p: b + i for i, p in enumerate(k.tolist())}
        for p in range(k[0] - 1, k[-1] + 1):
            run = [number.get(q, begins[-1]) for q in range(p, p + 5)]
            silent = [j for j, r in enumerate(run) if r == begins[-1]]
            if len(silent) == 1 and k[0] < p + silent[0] < k[-1]:
                want.add((*run, silent[0]))
    frames, silent = O._around_silence(np.repeat(np.arange(4), [len(k) for k in live]), np.concatenate(live))
    assert {(*f, s) for f, s in zip(frames.tolist(), silent.tolist())} == want and len(frames) == len(want) >= 5
