"""Chord labels as column expressions: canonical form, root, quality.

Grammar: ``root:quality(tones)/bass``; the root is a letter with sharps or flats, the
quality is ``maj`` if left out. Everything stays JVM-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Pitch class of a root letter is its position in this string, counted from 0.
LETTER_POSITIONS = "c d ef g a b"
# Spellings of the no-chord and of the skip label, lower case.
NO_CHORD = ("n", "nc", "n.c.", "n.c", "no chord")
SKIP = ("x",)


def _plain(label: Column) -> Column:
    """Lower case, outer blanks and sign variants removed."""
    return F.lower(F.trim(F.translate(label, "♭♯\t ", "b#  ")))


def canonical_chord(label: Column) -> Column:
    """``pitch_class:quality``, ``N`` or ``X``; null for null. Two labels name the same chord iff equal here.

    A label outside the grammar names only itself (``?`` and its plain text).
    """
    t = _plain(label)
    core = F.substring_index(F.substring_index(t, "/", 1), "(", 1)
    root = F.trim(F.substring_index(core, ":", 1))
    rest = F.substr(root, F.lit(2))
    letter = F.substring(root, 1, 1)
    position = F.instr(F.lit(LETTER_POSITIONS), letter) - 1
    sharps = F.length(rest) - F.length(F.replace(rest, F.lit("#"), F.lit("")))
    flats = F.length(rest) - F.length(F.replace(rest, F.lit("b"), F.lit("")))
    known = (letter != " ") & (letter != "") & (position >= 0) & (sharps + flats == F.length(rest))
    quality = F.when(F.instr(core, ":") > 0, F.trim(F.substring_index(core, ":", -1))).otherwise(F.lit("maj"))
    quality = F.when(quality == "", F.lit("maj")).otherwise(quality)
    return (
        F.when(label.isNull(), F.lit(None).cast("string"))
        .when(t.isin(*NO_CHORD), F.lit("N"))
        .when(t.isin(*SKIP), F.lit("X"))
        .when(known, F.concat(F.pmod(position + sharps - flats, F.lit(12)).cast("string"), F.lit(":"), quality))
        .otherwise(F.concat(F.lit("?"), t))
    )


def chord_quality(canonical: Column) -> Column:
    """Quality of a canonical chord; ``N`` and ``X`` are their own quality."""
    return F.when(F.instr(canonical, ":") > 0, F.substring_index(canonical, ":", -1)).otherwise(canonical)


def chord_root(canonical: Column) -> Column:
    """Pitch class 0-11 of a canonical chord; null for N, X and labels outside the grammar."""
    return F.when(F.instr(canonical, ":") > 0, F.substring_index(canonical, ":", 1).try_cast("int"))


def with_canonical_chord(df: DataFrame, label: str, out: str) -> DataFrame:
    """Add canonical_chord() of a column in steps, so that each shared piece is worked out once per row.

    Catalyst keeps projections apart where merging them would repeat a costly expression.
    """
    c = F.col
    df = df.withColumn("__t", _plain(c(label)))
    df = df.withColumn("__core", F.substring_index(F.substring_index(c("__t"), "/", 1), "(", 1))
    df = df.withColumns({"__root": F.trim(F.substring_index(c("__core"), ":", 1)), "__colon": F.instr(c("__core"), ":")})
    df = df.withColumns({"__pc": F.instr(F.lit(LETTER_POSITIONS), F.substring(c("__root"), 1, 1)) - 1, "__rest": F.substr(c("__root"), F.lit(2))})
    df = df.withColumns({"__sharps": F.length(F.translate(c("__rest"), "b", "")), "__len": F.length(c("__rest")), "__none": F.length(F.translate(c("__rest"), "#b", ""))})
    quality = F.when(c("__colon") > 0, F.trim(F.substring_index(c("__core"), ":", -1))).otherwise(F.lit("maj"))
    df = df.withColumn("__quality", quality)
    letter = F.substring(c("__root"), 1, 1)
    known = (c("__pc") >= 0) & (c("__none") == 0) & (c("__root") != "") & (letter != " ")
    # sharps minus flats: what is left without b, minus the rest of the length
    chord = (
        F.when(c("__t").isNull(), F.lit(None).cast("string"))
        .when(c("__t").isin(*NO_CHORD), F.lit("N"))
        .when(c("__t").isin(*SKIP), F.lit("X"))
        .when(known, F.concat(F.pmod(c("__pc") + 2 * c("__sharps") - c("__len"), F.lit(12)).cast("string"), F.lit(":"), F.when(c("__quality") == "", F.lit("maj")).otherwise(c("__quality"))))
        .otherwise(F.concat(F.lit("?"), c("__t")))
    )
    return df.withColumn(out, chord).drop("__t", "__core", "__root", "__colon", "__pc", "__rest", "__sharps", "__len", "__none", "__quality")
