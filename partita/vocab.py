"""The 157-class chord vocabulary and its tables, as constants and small DataFrames."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spelling of each pitch class.
ROOTS = ["C", "C#", "D", "Eb", "E", "F", "F#", "G", "Ab", "A", "Bb", "B"]
# Qualities in class order with their semitones above the root, and the sizes of the smaller vocabularies.
QUALITIES = {
    "maj": "100010010000", "min": "100100010000", "maj7": "100010010001", "min7": "100100010010", "7": "100010010010",
    "maj6": "100010010100", "min6": "100100010100", "dim": "100100100000", "aug": "100010001000", "sus4": "100001010000",
    "sus2": "101000010000", "dim7": "100100100100", "hdim7": "100100100010",
}
DIMS = {25: 2, 61: 5, 157: 13}
NO_CHORD_INDEX = 156
# For each quality at root C, the classes it resembles and how much.
AFFINITY = [
    [(0, 1.0)],
    [(12, 1.0)],
    [(0, 0.75), (15, 0.5), (24, 1.0)],
    [(3, 0.5), (12, 0.75), (36, 1.0), (63, 0.5)],
    [(0, 0.75), (48, 1.0), (88, 0.5)],
    [(0, 0.75), (21, 0.25), (45, 0.5), (60, 1.0)],
    [(12, 0.75), (72, 1.0), (93, 0.25), (153, 0.5)],
    [(56, 0.25), (75, 0.25), (84, 1.0), (132, 0.75), (135, 0.5), (138, 0.5), (141, 0.5), (144, 0.75)],
    [(96, 1.0), (100, 0.5), (104, 0.5)],
    [(108, 1.0), (125, 0.5)],
    [(115, 0.5), (120, 1.0)],
    [(84, 0.75), (87, 0.25), (90, 0.25), (93, 0.25), (132, 1.0), (135, 0.75), (138, 0.75), (141, 0.75)],
    [(15, 0.25), (75, 0.75), (84, 0.5), (144, 1.0)],
]
# Radii of the fifths, minor thirds and major thirds circles and their steps per semitone in units of pi.
TONNETZ = [(1.0, 7 / 6), (1.0, 3 / 2), (0.5, 2 / 3)]


def rotated(bits: str, root: int) -> str:
    """Bits of a quality moved to a root."""
    return "".join(bits[(i - root) % 12] for i in range(12))


def vocabulary_rows() -> list[tuple[int, str, int, int, str, str, str]]:
    """(idx, label, root, quality_idx, quality, bits above the root, chroma bits) of all 157 classes."""
    out = [(12 * q + r, f"{ROOTS[r]}:{name}", r, q, name, bits, rotated(bits, r)) for q, (name, bits) in enumerate(QUALITIES.items()) for r in range(12)]
    return [*out, (NO_CHORD_INDEX, "N", -1, 13, "", "0" * 12, "0" * 12)]


def vocabulary(spark: SparkSession) -> DataFrame:
    """157 rows; broadcast it."""
    return spark.createDataFrame(vocabulary_rows(), "idx int, label string, root int, quality_idx int, quality string, bits string, chroma string")


def class_label(idx: Column) -> Column:
    """Label of a class index; null outside 0..156."""
    names = F.array(*[F.lit(r[1]) for r in vocabulary_rows()])
    return F.when((idx >= 0) & (idx <= NO_CHORD_INDEX), F.element_at(names, idx.cast("int") + 1))


def class_chroma(idx: Column) -> Column:
    """12-bit chroma string of a class index."""
    return F.element_at(F.array(*[F.lit(r[6]) for r in vocabulary_rows()]), idx.cast("int") + 1)


def affinity(spark: SparkSession) -> DataFrame:
    """(class_idx, other_idx, weight): template of the class's quality, turned to its root inside each block of twelve."""
    rows = [(12 * q + r, i // 12 * 12 + (i + r) % 12, w) for q, t in enumerate(AFFINITY) for r in range(12) for i, w in t]
    return spark.createDataFrame([*rows, (NO_CHORD_INDEX, NO_CHORD_INDEX, 1.0)], "class_idx int, other_idx int, weight double")


def tonnetz_basis() -> list[list[float]]:
    """Six rows of twelve: sine and cosine of each circle."""
    return [[r * f(step * math.pi * k) for k in range(12)] for r, step in TONNETZ for f in (math.sin, math.cos)]


def label_index(label: Column, dim: int = 157) -> Column:
    """Strict class index: null for X, extensions, a bass other than the root, or a quality outside the vocabulary.

    N is dim - 1. Any spelling of the root counts.
    """
    part = lambda i: F.regexp_extract(label, r"^([A-G])([#b]*)(?::([a-z0-9]*))?(\([^)]*\))?(?:/(.*))?$", i)
    quality = F.when((part(3) == "") & (part(1) != ""), F.lit("maj")).otherwise(part(3))
    names = list(QUALITIES)[: DIMS[dim]]
    position = F.array_position(F.array(*[F.lit(q) for q in names]), quality)
    root = pitch_number(part(1), part(2))
    ok = (part(1) != "") & (part(4) == "") & part(5).isin("", "1") & (position > 0)
    return F.when(label == "N", F.lit(dim - 1)).when(ok, (root + 12 * (position - 1)).cast("int"))


def pitch_number(letter: Column, accidentals: Column) -> Column:
    """Pitch class of a letter with sharps and flats."""
    sharps = F.length(F.translate(accidentals, "b", "")) - F.length(F.translate(accidentals, "#", ""))
    return F.pmod(F.instr(F.lit("C D EF G A B"), letter) - 1 + sharps, F.lit(12))


def soft_label_index(label: Column) -> Column:
    """Class index by sounding semitones: extensions that give a quality's bits match it, the bass is ignored, N and empty sets are N."""
    root = pitch_number(F.substring(label, 1, 1), F.regexp_extract(label, r"^[A-G]([#b]*)", 1))
    name = F.regexp_extract(label, r"^[A-G][#b]*:?([a-z0-9]*)", 1)
    name = F.when(name == "", F.lit("maj")).otherwise(name)
    base = F.element_at(F.create_map(*[F.lit(x) for q in QUALITIES.items() for x in q]), name)
    extra = F.filter(F.split(F.regexp_extract(label, r"\(([^)]*)\)", 1), ","), lambda x: x.rlike("^[#b]*[0-9]+$"))
    # Semitones of the degrees of a major scale.
    degree = lambda x: F.pmod(F.element_at(F.array(*[F.lit(n) for n in (0, 2, 4, 5, 7, 9, 11)]), F.pmod(F.regexp_extract(x, "([0-9]+)", 1).cast("int") - 1, F.lit(7)) + 1) + F.length(x) - F.length(F.replace(x, F.lit("#"), F.lit(""))) - (F.length(x) - F.length(F.replace(x, F.lit("b"), F.lit("")))), F.lit(12))
    added = F.transform(extra, degree)
    bits = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.when(F.substring(base, i + 1, F.lit(1)).eqNullSafe("1") | F.array_contains(added, i), "1").otherwise("0")), "")
    position = F.array_position(F.array(*[F.lit(b) for b in QUALITIES.values()]), bits)
    return F.when(label == "N", F.lit(NO_CHORD_INDEX)).when(label.rlike("^[A-G]") & base.isNotNull() & (position > 0), (root + 12 * (position - 1)).cast("int"))


def subtract_mod(reference: Column, index: Column, base: int = 12) -> Column:
    """index seen from reference, in index's own block of ``base``; null if either is null."""
    return (F.floor(index / base) * base + F.pmod(index - reference, F.lit(base))).cast("int")


def add_mod(reference: Column, value: Column, base: int = 12) -> Column:
    """reference moved by value, in reference's own block; null if either is null."""
    return (F.floor(reference / base) * base + F.pmod(reference + value, F.lit(base))).cast("int")


def relative_class(reference: Column, index: Column) -> Column:
    """Class seen from the root of a reference class; N stays N, and a chord seen from N stays itself."""
    return F.when((reference == NO_CHORD_INDEX) | (index == NO_CHORD_INDEX), index).otherwise(subtract_mod(F.pmod(reference, F.lit(12)), index))


def rotate(vec: Column, root: Column) -> Column:
    """Turn each block of twelve of an array by root; elements after the last whole block stay."""
    blocks = F.floor(F.size(vec) / 12) * 12
    return F.transform(vec, lambda x, i: F.when(i < blocks, F.element_at(vec, (F.floor(i / 12) * 12 + F.pmod(i - root, F.lit(12)) + 1).cast("int"))).otherwise(x))


def transpose_label(label: Column, shift: Column) -> Column:
    """Label with its root moved by shift semitones; N and X stay, the rest of the label is kept."""
    letter, acc = F.regexp_extract(label, "^([A-G])([#b]*)", 1), F.regexp_extract(label, "^([A-G])([#b]*)", 2)
    names = F.array(*[F.lit(r) for r in ROOTS])
    moved = F.element_at(names, (F.pmod(pitch_number(letter, acc) + shift, F.lit(12)) + 1).cast("int"))
    return F.when(label.rlike("^[A-G]"), F.concat(moved, F.regexp_replace(label, "^[A-G][#b]*", ""))).otherwise(label)


def label_root(label: Column) -> Column:
    """Root 0-11; -1 for N, null for X and what has no root."""
    letter, acc = F.regexp_extract(label, "^([A-G])([#b]*)", 1), F.regexp_extract(label, "^([A-G])([#b]*)", 2)
    return F.when(label == "N", F.lit(-1)).when(letter != "", pitch_number(letter, acc))


def relative_labels(ref: Column, est: Column) -> tuple[Column, Column]:
    """Both labels moved so that the reference's root is C; an N has root -1 in that arithmetic and itself stays."""
    re_root = lambda label, root: F.when(label.rlike("^[A-G]"), F.concat(F.element_at(F.array(*[F.lit(r) for r in ROOTS]), (root + 1).cast("int")), F.regexp_replace(label, "^[A-G][#b]*", ""))).otherwise(label)
    return re_root(ref, F.lit(0)), re_root(est, F.pmod(label_root(est) - F.coalesce(label_root(ref), F.lit(0)), F.lit(12)))


def split_label(label: Column) -> Column:
    """(root, quality, extensions, bass) of a label ``root:quality(extensions)/bass``; parts that are not there are empty, N and X are roots, what does not fit the form is null."""
    form = r"^(N|X|[A-G][#b]*)(?::([A-Za-z0-9+-]*))?(?:\(([^()]*)\))?(?:/([^/]+))?$"
    part = lambda i: F.regexp_extract(label, form, i)
    extensions = F.when(part(3) == "", F.array().cast("array<string>")).otherwise(F.split(part(3), " *, *"))
    return F.when(label.rlike(form), F.struct(part(1).alias("root"), part(2).alias("quality"), extensions.alias("extensions"), part(4).alias("bass")))


def join_label(parts: Column) -> Column:
    """The inverse of split_label()."""
    ext = F.when(F.size(parts["extensions"]) > 0, F.concat(F.lit("("), F.array_join(parts["extensions"], ","), F.lit(")"))).otherwise("")
    colon = F.when((parts["quality"] != "") | (F.size(parts["extensions"]) > 0), F.concat(F.lit(":"), parts["quality"])).otherwise("")
    return F.concat(parts["root"], colon, ext, F.when(parts["bass"] != "", F.concat(F.lit("/"), parts["bass"])).otherwise(""))
