"""File names as columns: parts, mapping, note numbers and instrument codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from partita.vocab import pitch_number

# Tags that rule a file name out.
EXCLUDED_TAGS = ("GLISSANDI", "Percuss", "CHORD", "Gong", "glis", "run")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_dir(path: Column) -> Column:
    """What stands before the last slash; empty if there is none."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def file_base(path: Column) -> Column:
    """Name without its last extension; a leading dot begins a name, not an extension."""
    name = file_name(path)
    return F.when(F.instr(name, ".") > 1, F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def file_ext(path: Column) -> Column:
    """Last extension with its dot, or empty."""
    name = file_name(path)
    return F.when(F.instr(name, ".") > 1, F.regexp_extract(name, r"(\.[^.]*)$", 1)).when(name.isNotNull(), F.lit(""))


def map_path(path: Column, out_dir: str, ext: str) -> Column:
    """The path's base in another directory with another extension."""
    return F.concat(F.lit(out_dir.rstrip("/") + "/"), file_base(path), F.lit("." + ext.lstrip(".")))


def glob_to_regex(pattern: str) -> str:
    """A glob with * and ? as an anchored regular expression."""
    return "^" + "".join({"*": ".*", "?": "."}.get(c, c if c.isalnum() or c == "_" else "\\" + c) for c in pattern) + "$"


def note_name_number(name: Column) -> Column:
    """Octave times twelve plus semitone of a name such as C#4; null if it is none."""
    letter, acc, octave = (F.regexp_extract(name, "^([A-G])([#b]*)([0-9])$", i) for i in (1, 2, 3))
    return F.when(letter != "", octave.try_cast("int") * 12 + pitch_number(letter, acc))


def file_note_number(path: Column) -> Column:
    """Number of the last note name in a file's base; null if there is none."""
    return note_name_number(F.regexp_extract(file_base(path), ".*([A-G]#?[0-9])", 1))


def instrument_code(path: Column) -> Column:
    """First token of the file's base."""
    return F.split(file_base(path), r"[\W_]+")[0]


def folder_code(path: Column) -> Column:
    """First token of the parent directory's name."""
    return F.split(file_name(file_dir(path)), r"[\W_]+")[0]


def usable_name(path: Column) -> Column:
    """Has a note name, and none of the excluded tags anywhere in the path (case counts)."""
    ok = file_base(path).rlike("[A-G]#?[0-9]")
    for tag in EXCLUDED_TAGS:
        ok = ok & ~F.contains(path, F.lit(tag))
    return ok
