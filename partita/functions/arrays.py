"""Array functions as columns: normalisation, shifts, distances, one-hot forms. Nested arrays are matrices, rows first."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once, where a lambda inside the body would work it out for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalize(a: Column) -> Column:
    """Divided by its sum; a zero sum counts as 1."""
    return let(total(a), lambda s: F.transform(a, lambda x: x / F.when(s == 0, 1.0).otherwise(s)))


def lp_scale(a: Column, p: float = 2.0) -> Column:
    """Divided by its Lp norm; a zero norm counts as 1."""
    powers = F.aggregate(a, F.lit(0.0), lambda s, x: s + (x * x if p == 2.0 else F.pow(F.abs(x), F.lit(p))))
    norm = F.sqrt(powers) if p == 2.0 else F.pow(powers, F.lit(1.0 / p))
    return let(norm, lambda n: F.transform(a, lambda x: x / F.when(n == 0, 1.0).otherwise(n)))


def half_wave(a: Column) -> Column:
    """Negative elements become 0; NaN stays."""
    return F.transform(a, lambda x: F.greatest(x, F.lit(0.0)))


def gibbs(energy: Column, beta: float) -> Column:
    """exp(-beta e) over its sum."""
    return normalize(F.transform(energy, lambda e: F.exp(-beta * e)))


def shift(a: Column, by: int, fill: float = 0.0) -> Column:
    """Moved by some places, vacated places filled, size kept."""
    n = F.size(a)
    k = F.least(F.lit(abs(by)), n)
    pad = F.array_repeat(F.lit(fill), k)
    return F.concat(pad, F.slice(a, F.lit(1), n - k)) if by >= 0 else F.concat(F.slice(a, k + 1, n - k), pad)


def circshift(a: Column, by: Column | int) -> Column:
    """Rotated by some places, either way."""
    by = F.lit(by) if isinstance(by, int) else by
    n = F.greatest(F.size(a), F.lit(1))
    k = F.pmod(by, n).cast("int")
    return F.concat(F.slice(a, n - k + 1, k), F.slice(a, F.lit(1), n - k))


def translate2d(m: Column, rows: int, cols: int, fill: float = 0.0) -> Column:
    """A matrix moved along both axes with fill; the size is kept."""
    moved = F.transform(m, lambda r: shift(r, cols, fill))
    k = F.least(F.lit(abs(rows)), F.size(m))
    blank = F.array_repeat(F.transform(F.element_at(m, 1), lambda x: F.lit(fill)), k)
    n = F.size(m)
    return F.concat(blank, F.slice(moved, F.lit(1), n - k)) if rows >= 0 else F.concat(F.slice(moved, k + 1, n - k), blank)


def circshift2d(m: Column, rows: int, cols: int) -> Column:
    """A matrix rotated along both axes."""
    return circshift(F.transform(m, lambda r: circshift(r, cols)), rows)


def one_hot(idx: Column, dim: int) -> Column:
    """0/1 array with a 1 at idx; all 0 for null."""
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(i == idx, F.lit(False)).cast("int"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null if either is all zero."""
    return 1 - dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def duplicate(a: Column) -> Column:
    """An array put behind itself."""
    return F.concat(a, a)


def transpose(m: Column) -> Column:
    """Rows and columns of a matrix exchanged."""
    width = F.size(F.element_at(m, 1))
    return F.transform(F.sequence(F.lit(1), width), lambda j: F.transform(m, lambda r: F.element_at(r, j)))


def reshape(a: Column, width: int) -> Column:
    """A flat array cut into rows of a width; a short last row is dropped."""
    return F.transform(F.sequence(F.lit(0), F.greatest((F.size(a) / width).cast("int") - 1, F.lit(0))), lambda i: F.slice(a, i * width + 1, F.lit(width)))


def drop_empty(m: Column) -> Column:
    """Map entries whose value is null, empty or 0 are dropped; values are strings."""
    return F.map_filter(m, lambda _, v: v.isNotNull() & ~v.isin("", "0"))
