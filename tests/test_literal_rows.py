"""Labels, tablatures, names and note sets with known results."""

from pyspark.sql import functions as F

from partita import vocab as V
from partita.functions import paths as P
from partita.functions import tabs as T

# label, strict class, class by sounding semitones
ODD = [("C:maj6", 60, 60), ("A:min7", 45, 45), ("C:maj(6)", None, 60), ("F#", 6, 6), ("Gb:maj", 6, 6), ("C:maj/3", None, 0), ("C/1", 0, 0), ("N", 156, 156), ("X", None, None), ("C:maj(b7)", None, 48), ("D:min(b7)", None, 38), ("G:9", None, None), ("Cb:min", 23, 23), ("C:maj(9)", None, None)]
# tab, frets, notes, chroma
TABS = [("X, 0, 2, 2, 2, 0", [-1, 0, 2, 2, 2, 0], [45, 52, 57, 61, 64], "010010000100"), ("3,2,0,0,0,3", [3, 2, 0, 0, 0, 3], [43, 47, 50, 55, 59, 67], "001000010001"), ("x,x,p0,2,3,2", [-1, -1, 0, 2, 3, 2], [50, 57, 62, 66], "001000100100"), ("X,X,X,X,X,X", [-1] * 6, [], "0" * 12)]
# path, note number, code, folder code, passes the filters
NAMES = [("/vsl/FL1/FL1mV_C#4.wav", 49, "FL1mV", "FL1", True), ("/vsl/HO/Ho-stac_A3.wav", 45, "Ho", "HO", True), ("/vsl/KB/KB_run_D2.wav", 26, "KB", "KB", False), ("/vsl/X/noise.wav", None, "noise", "X", False), ("/vsl/TU/TU_B1_E2.wav", 28, "TU", "TU", True), ("/vsl/Gong/G_F3.wav", 41, "G", "Gong", False)]
# text, chroma, how many pitches
SETS = [("[60, 64, 67]", "100010010000", 3), ("[60, 72, 48]", "100000000000", 3), ("[]", "0" * 12, 0), ("[83, 84]", "100000000001", 2), ("import os", None, None)]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_odd_spellings(spark):
    df = spark.createDataFrame([(r[0],) for r in ODD], "label string")
    assert rows(df.select("label", V.label_index(F.col("label")), V.soft_label_index(F.col("label")))) == sorted(ODD, key=repr)


def test_tabs(spark):
    df = spark.createDataFrame([(t[0],) for t in TABS], "tab string").withColumn("f", T.decode_tab(F.col("tab")))
    f = F.col("f")
    assert rows(df.select("tab", "f", T.frets_notes(f), T.notes_chroma(T.frets_notes(f)))) == sorted(TABS, key=repr)
    assert all(r[0] == r[1] for r in df.select("f", T.decode_tab(T.encode_tab(f))).collect())


def test_names(spark):
    df, c = spark.createDataFrame([(r[0],) for r in NAMES], "path string"), F.col("path")
    assert rows(df.select("path", P.file_note_number(c), P.instrument_code(c), P.folder_code(c), P.usable_name(c))) == sorted(NAMES, key=repr)


def test_note_sets(spark):
    df = spark.createDataFrame([(s[0],) for s in SETS], "notes string").withColumn("p", F.from_json("notes", "array<int>"))
    got = df.select("notes", F.when(F.col("p").isNotNull(), T.notes_chroma(F.col("p"))), F.when(F.col("p").isNotNull(), F.size(F.array_distinct("p"))))
    assert rows(got) == sorted(SETS, key=repr)


def test_label_parts(spark):
    want = {"C:maj(9,b7)/3": ("C", "maj", ["9", "b7"], "3"), "Gb": ("Gb", "", [], ""), "N": ("N", "", [], ""), "X": ("X", "", [], ""), "A:min7": ("A", "min7", [], ""), "D/5": ("D", "", [], "5")}
    df = spark.createDataFrame([(x,) for x in [*want, "H:maj", "", None, "c:maj"]], "label string").withColumn("p", V.split_label(F.col("label")))
    got = {r.label: (tuple(r.p) if r.p else None, r.back) for r in df.withColumn("back", V.join_label(F.col("p"))).collect()}
    assert {k: v[0] for k, v in got.items() if v[0]} == want
    assert all(k == v[1] for k, v in got.items() if v[0])


def test_voicing_misses_are_dropped(spark):
    df = spark.createDataFrame([("C:maj", 1), ("G:9", 2), (None, 3)], "label string, tab_no int")
    v = spark.createDataFrame([("C:maj", "X,3,2,0,1,0")], "label string, tab string")
    assert [tuple(r) for r in T.with_voicing(df, "label", v, 9).collect()] == [("C:maj", 1, "X,3,2,0,1,0", [-1, 3, 2, 0, 1, 0], [8, 3, 2, 0, 1, 0])]
