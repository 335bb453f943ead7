"""Tablature, chroma and bigram functions as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partita import vocab as V
from partita.operators.sequences import ngrams

# Notes of the open strings.
TUNING = [40, 45, 50, 55, 59, 64]


def decode_tab(tab: Column) -> Column:
    """Frets of a comma-separated tab; X is -1, P and blanks are dropped, anything else that is no number is null."""
    parts = F.split(F.regexp_replace(F.upper(tab), "[P ]", ""), ",")
    return F.transform(parts, lambda x: F.when(x == "X", F.lit(-1)).otherwise(x.try_cast("int")))


def encode_tab(frets: Column) -> Column:
    """The inverse of decode_tab(); negative frets are X."""
    return F.array_join(F.transform(frets, lambda f: F.when(f < 0, F.lit("X")).otherwise(f.cast("string"))), ",")


def frets_notes(frets: Column) -> Column:
    """Note numbers of the strings that sound, in string order."""
    pairs = F.zip_with(frets, F.array(*[F.lit(n) for n in TUNING]), lambda f, o: F.when(f >= 0, f + o))
    return F.filter(pairs, lambda n: n.isNotNull())


def notes_chroma(notes: Column) -> Column:
    """Twelve bits of the pitch classes of a set of notes."""
    classes = F.transform(notes, lambda n: F.pmod(n, F.lit(12)))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.when(F.array_contains(classes, i), "1").otherwise("0")), "")


def fret_targets(frets: Column, n: int) -> Column:
    """Fret classes: off (-1) is the last of n."""
    return F.transform(frets, lambda f: F.pmod(f, F.lit(n)))


def fret_bitmap(frets: Column, n: int) -> Column:
    """One-hot rows of the fret classes."""
    return F.transform(fret_targets(frets, n), lambda f: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == f).cast("int")))


def shift_frets(frets: Column, by: Column, max_frets: int) -> Column:
    """Move all fretted strings by some frets if no string is open, at least one sounds, and all stay within 1..max_frets; else as they are."""
    sounding = F.filter(frets, lambda f: f >= 0)
    moved = F.transform(frets, lambda f: F.when(f < 0, f).otherwise(f + by))
    low, high = F.array_min(sounding) + by, F.array_max(sounding) + by
    return F.when((F.size(sounding) > 0) & (F.array_min(sounding) > 0) & (low >= 1) & (high <= max_frets), moved).otherwise(frets)


def shift_range(frets: Column, max_frets: int) -> tuple[Column, Column]:
    """(least, most) frets by which all strings can move and stay within 1..max_frets; (0, 0) if a string is open or none sounds."""
    sounding = F.filter(frets, lambda f: f >= 0)
    free = (F.size(sounding) > 0) & (F.array_min(sounding) > 0) & (F.array_max(sounding) <= max_frets)
    return F.when(free, 1 - F.array_min(sounding)).otherwise(0), F.when(free, max_frets - F.array_max(sounding)).otherwise(0)


def with_voicing(df: DataFrame, label: str, voicings: DataFrame, n: int) -> DataFrame:
    """Adds tab, frets and fret targets of each row's label from a table (label, tab); rows without a voicing are dropped."""
    joined = df.join(voicings.select(F.col("label").alias("__l"), "tab"), F.col(label) == F.col("__l")).drop("__l").withColumn("frets", decode_tab(F.col("tab")))
    return joined.withColumn("targets", fret_targets(F.col("frets"), n))


def chroma_tonnetz(bits: Column) -> Column:
    """Six tonnetz coordinates of an array of twelve numbers, divided by their sum (or 1)."""
    total = F.aggregate(bits, F.lit(0.0), lambda a, x: a + x)
    total = F.when(total == 0, 1.0).otherwise(total)
    rows = [F.aggregate(F.zip_with(bits, F.array(*[F.lit(x) for x in row]), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x) / total for row in V.tonnetz_basis()]
    return F.array(*rows)


def interval_chord(notes: Column) -> Column:
    """Name of a set of notes: root and quality of the first root, from the lowest note up, whose set is in the vocabulary;
    else the lowest note with the semitones above it in parentheses; N for no notes, null for null."""
    bass = F.pmod(F.array_min(notes), F.lit(12))
    roots = F.array(*[F.lit(r) for r in V.ROOTS])
    steps = F.array_sort(F.array_distinct(F.transform(notes, lambda n: F.pmod(n - bass, F.lit(12)))))
    above = lambda root: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.when(F.array_contains(steps, F.pmod(i + root, F.lit(12)).cast("int")), "1").otherwise("0")), "")
    bits = F.array(*[F.lit(b) for b in V.QUALITIES.values()])
    names = F.array(*[F.lit(q) for q in V.QUALITIES])
    fits = F.filter(F.transform(steps, lambda r: F.struct(r.alias("r"), F.array_position(bits, above(r)).alias("q"))), lambda s: s["q"] > 0)
    name = lambda r: F.element_at(roots, (F.pmod(bass + r, F.lit(12)) + 1).cast("int"))
    known = F.concat(name(fits[0]["r"]), F.lit(":"), F.element_at(names, fits[0]["q"].cast("int")))
    plain = F.concat(name(F.lit(0)), F.lit(":("), F.array_join(F.transform(F.slice(steps, 2, 12), lambda x: x.cast("string")), ","), F.lit(")"))
    return F.when(F.size(notes) == 0, F.lit("N")).when(F.size(fits) > 0, known).otherwise(plain)


def bigram_states(df: DataFrame, key: str, order: list[str], size: int) -> DataFrame:
    """(a, b, state, lines): successive classes looked up in a lexicon of the ``size`` heaviest pairs relative to b's root.

    state = size * root of b + position in the lexicon; a null first class is a valid left side, an unknown pair null.
    """
    p = ngrams(df, key, order, "idx").select(F.col("prev").alias("a"), F.col("idx").alias("b"))
    q = p.groupBy("a", "b").agg(F.count(F.lit(1)).alias("lines")).withColumns({"ra": V.relative_class(F.col("b"), F.col("a")), "rb": V.relative_class(F.col("b"), F.col("b"))})
    heavy = q.groupBy("ra", "rb").agg(F.sum("lines").alias("n")).orderBy(F.desc("n"), F.asc_nulls_first("ra"), "rb").limit(size)
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("n"), F.asc_nulls_first("ra"), "rb")) - 1
    lex = heavy.select(F.col("ra").alias("la"), F.col("rb").alias("lb"), rank.alias("i"))
    count = lex.agg(F.count(F.lit(1)).alias("size"))
    joined = q.join(F.broadcast(lex), q["ra"].eqNullSafe(lex["la"]) & (q["rb"] == lex["lb"]), "left").join(F.broadcast(count))
    root = F.when(F.col("b") == V.NO_CHORD_INDEX, 0).otherwise(F.pmod("b", F.lit(12)))
    return joined.select("a", "b", (F.col("size") * root + F.col("i")).cast("bigint").alias("state"), "lines")
