"""Readers and sinks: round trips on small files."""

import json
import struct
import wave

import pytest
from pyspark.sql import functions as F

from partita.sources import annotations as A


def test_intervals(spark, tmp_path):
    (tmp_path / "a.lab").write_text("0.0 1.0 C:maj\n1.0\t2.0\tC:maj\r\n\n2.0 4.0 N\n")
    (tmp_path / "b.json").write_text(json.dumps({"intervals": [[0, 1], [1, 3]], "labels": ["x", "y"]}))
    got = [tuple(r)[2:] for r in A.read_intervals(spark, str(tmp_path / "a.lab")).orderBy("position").collect()]
    assert got == [(0.0, 1.0, "C:maj"), (1.0, 2.0, "C:maj"), (2.0, 4.0, "N")]
    joined = [tuple(r)[1:] for r in A.read_intervals(spark, str(tmp_path / "a.lab"), compress=True).orderBy("start").collect()]
    assert joined == [("C:maj", 0.0, 2.0), ("N", 2.0, 4.0)]
    assert [r.label for r in A.read_intervals(spark, str(tmp_path / "b.json")).collect()] == ["x", "y"]
    with pytest.raises(ValueError):
        A.read_intervals(spark, "x.csv")


def test_textlist_and_files(spark, tmp_path):
    A.write_textlist(spark.createDataFrame([("a",), ("b b",)], "v string").coalesce(1), "v", str(tmp_path / "list"))
    assert [r.value for r in A.read_textlist(spark, str(tmp_path / "list")).collect()] == ["a", "b b"]
    for p in ("x.wav", "d/y.wav", "d/e/z.wav", "d/n.txt"):
        (tmp_path / "w" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "w" / p).write_bytes(b"1")
    got = [(r.path.rsplit("/", 1)[1], r.depth) for r in A.collect_files(spark, str(tmp_path / "w"), "*.wav", 1, 6).collect()]
    assert sorted(got) == [("y.wav", 1), ("z.wav", 2)]


def notes(rows):
    return sorted((r.key, r.annotation, tuple(sorted((r.metadata or {}).items())), tuple(sorted((r.sandbox or {}).items())), r.start, r.end, r.label, r.confidence) for r in rows.collect())


NOTES = "key string, annotation int, metadata map<string,string>, sandbox map<string,string>, start double, end double, label string, confidence double"


def test_annotation_set(spark, tmp_path):
    rows = spark.createDataFrame(
        [
            ("k1", 0, {"annotator": "a"}, {"source_file": "x"}, 0.0, 1.0, "C:maj", 0.5), ("k1", 0, {"annotator": "a"}, {"source_file": "x"}, 1.0, 2.0, "N", None),
            ("k1", 1, {}, {"penalty": "-1"}, 0.0, 2.0, "G\"7\n", 1.0), ("k2", 0, {}, {}, 0.0, 3.0, "G:min", 1.0), ("k\"3", 0, {"a": "b"}, {}, None, None, None, None),
        ],
        NOTES,
    )
    A.write_annotation_set(rows, str(tmp_path / "set"))
    assert notes(A.read_annotation_set(spark, str(tmp_path / "set"))) == notes(rows)
    for r in spark.read.text(str(tmp_path / "set")).collect():
        assert set(json.loads(r.value)) <= {"k1", "k2", "k\"3"}
    one = tmp_path / "one.json"
    one.write_text(json.dumps({"k": {"chord": [{"data": [{"start": 0, "end": 1, "label": "N", "confidence": 1}], "sandbox": {"penalty": "-1"}}]}, "j": {"chord": []}}, indent=1))
    r = A.read_annotation_set(spark, str(one)).collect()
    assert [(x.key, x.label, x.sandbox, x.metadata) for x in r] == [("k", "N", {"penalty": "-1"}, None)]


def test_intervals_to_annotations(spark, tmp_path):
    (tmp_path / "a.lab").write_text("0.0 1.0 C:maj\n1.0 2.0 N\n")
    (tmp_path / "b.lab").write_text("0.0 1.0 G\n")
    meta = spark.createDataFrame([("a", {"artist": "z"})], "key string, metadata map<string,string>")
    got = A.intervals_to_annotations(A.read_intervals(spark, str(tmp_path / "*.lab")), meta, "now").collect()
    assert {(r.key, r.label, r.metadata.get("artist"), r.sandbox["source_file"], r.sandbox["timestamp"]) for r in got} == {("a", "C:maj", "z", "a.lab", "now"), ("a", "N", "z", "a.lab", "now"), ("b", "G", None, "b.lab", "now")}


def test_decodes(spark, tmp_path):
    seg = spark.createDataFrame([("t", -1.0, 0, 3, 0.0, 1.0, -0.5, "m/0.5/1/test.npz"), ("t", -5.0, 0, 3, 0.0, 2.0, None, "m/0.5/1/test.npz")], "key string, penalty double, segment int, state int, start double, end double, confidence double, path string")
    rows = A.decoded_annotations(seg, "key", F.col("state").cast("string"), F.col("penalty"), F.col("path"))
    assert {(r.annotation, r.penalty, r.sandbox["penalty"], r.sandbox["checkpoint"], r.metadata["data_source"]) for r in rows.collect()} == {(0, -5.0, "-5.0", "best", "machine estimation"), (1, -1.0, "-1.0", "best", "machine estimation")}
    A.write_decodes(rows, str(tmp_path / "out"))
    assert [(r.start, r.end) for r in A.read_annotation_set(spark, str(tmp_path / "out" / "penalty=-1.0")).collect()] == [(0.0, 1.0)]


def test_voicings_and_public_columns(spark, tmp_path):
    (tmp_path / "v.json").write_text(json.dumps({"C:maj": "X,3,2,0,1,0", "G:maj": "3,2,0,0,0,3"}))
    assert {tuple(r) for r in A.read_voicings(spark, str(tmp_path / "v.json")).collect()} == {("C:maj", "X,3,2,0,1,0"), ("G:maj", "3,2,0,0,0,3")}
    df = spark.createDataFrame([(1, 2, (3, (4, 5)))], "a int, _b int, s struct<_c: int, t: struct<d: int, _e: int>>")
    out = A.public_columns(df)
    assert out.schema.simpleString() == "struct<a:int,s:struct<t:struct<d:int>>>" and out.first().s.t.d == 4


def test_splits_stash_and_names(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"0": {"train": ["a", "b"], "test": ["c"]}}))
    s = A.read_splits(spark, str(tmp_path / "s.json"))
    assert sorted(map(tuple, s.collect())) == [("0", "test", "c"), ("0", "train", "a"), ("0", "train", "b")]
    A.write_stash(s, str(tmp_path / "stash"), "fold", "split")
    part = spark.read.parquet(str(tmp_path / "stash")).where("split = 'test'")
    assert [r.key for r in part.collect()] == ["c"]
    df = spark.createDataFrame([("/x/FL1_C4_f.npz",)], "p string")
    assert tuple(df.select(*A.timbre_fields(F.col("p"))).first()) == ("FL1", "C4", "f")
    with pytest.raises(Exception, match="not three parts"):
        spark.createDataFrame([("/x/a_b.npz",)], "p string").select(*A.timbre_fields(F.col("p"))).collect()
    df = spark.createDataFrame([("m/0.5/1/test/ck-10.hdf5",), ("m/0.5/1/test.hdf5",)], "p string").select(A.run_parameters(F.col("p")).alias("r"))
    assert [tuple(r.r) for r in df.collect()] == [("m", "0.5", "1", "test", "ck-10"), ("m", "0.5", "1", "test", "best")]


def test_sweep_and_annotators(spark):
    cks = spark.createDataFrame([(f"c{i:02d}",) for i in range(10)], "path string")
    got = A.checkpoint_sweep(cks, spark.createDataFrame([("k",)], "key string"), 1, 4)
    assert sorted(r.checkpoint for r in got.collect()) == ["c01", "c05", "c09"]
    fields = "path string, start double, end double, label string"
    a = spark.createDataFrame([("/l/song_dt.lab", 0.0, 1.0, "N")], fields)
    b = spark.createDataFrame([("/l/alone_tdc.lab", 0.0, 1.0, "D"), ("/l/song_tdc.lab", 0.0, 1.0, "C")], fields)
    both = A.pair_annotators(a, b, lambda base: F.regexp_replace(base, "_(dt|tdc)$", ""), ("dt", "tdc"))
    assert sorted((r.key, r.annotation, r.metadata["annotator"], r.label, r.paired) for r in both.collect()) == [("alone", 1, "tdc", "D", False), ("song", 0, "dt", "N", True), ("song", 1, "tdc", "C", True)]


def test_wav(spark, tmp_path):
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(8000)
        w.writeframes(struct.pack("<4h", 16384, 0, -32768, -32768))
    (tmp_path / "b.wav").write_bytes(b"not audio")
    got = {r.path.rsplit("/", 1)[1]: r for r in A.read_wav(spark, str(tmp_path / "*.wav")).collect()}
    assert got["a.wav"].samples == [0.25, -1.0] and got["a.wav"].samplerate == 8000.0 and got["b.wav"].samples is None


def test_stream_runs(spark, tmp_path):
    from partita.streaming.runs import stream_runs, windowed_counts

    rows = [("u", i, f"2024-01-01 00:0{i}:00", lab) for i, lab in enumerate("aabba")]
    df = spark.createDataFrame(rows, "u string, id int, ts string, label string").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = stream_runs(stream, "u", "id", "ts", "label").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.label, r.run_len) for r in spark.read.parquet(str(tmp_path / "out")).where("closed").collect())
    assert got == [("a", 2), ("b", 2)]
    q = windowed_counts(stream, "ts", "label", "2 minutes", "0 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out2")).option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.label, r.n) for r in spark.read.parquet(str(tmp_path / "out2")).collect()} >= {("a", 2), ("b", 2)}


def test_files(spark, tmp_path):
    from partita.sources import files as H

    (tmp_path / "none").write_bytes(b"")
    (tmp_path / "some").write_bytes(b"1")
    assert H.is_empty(spark, str(tmp_path / "none")) and not H.is_empty(spark, str(tmp_path / "some")) and not H.is_empty(spark, str(tmp_path / "gone"))
    H.create_directory(spark, str(tmp_path / "a" / "b"))
    H.copy(spark, str(tmp_path / "some"), str(tmp_path / "a" / "b" / "copy"))
    assert (tmp_path / "a" / "b" / "copy").read_bytes() == b"1"
    with H.temporary(spark, str(tmp_path), ".json") as p:
        open(p, "w").write("x")
    assert not list(tmp_path.glob("tmp_*"))
