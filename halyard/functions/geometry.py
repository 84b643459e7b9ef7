"""Vectors as arrays of three doubles, image planes and patient axes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NEAR_ZERO = 1e-10


def vec(*xs: Column) -> Column:
    return F.array(*(x.cast("double") for x in xs))


def x(v: Column, k: int) -> Column:
    return F.element_at(v, k + 1)


def add(a: Column, b: Column) -> Column:
    return F.array(*(x(a, k) + x(b, k) for k in range(3)))


def subtract(a: Column, b: Column) -> Column:
    return F.array(*(x(a, k) - x(b, k) for k in range(3)))


def scale(a: Column, s: Column | float) -> Column:
    return F.array(*(x(a, k) * s for k in range(3)))


def negate(a: Column) -> Column:
    return F.array(*(F.lit(0.0) - x(a, k) for k in range(3)))


def dot(a: Column, b: Column) -> Column:
    return reduce(lambda p, q: p + q, (x(a, k) * x(b, k) for k in range(3)))


def cross(a: Column, b: Column) -> Column:
    return F.array(*(x(a, i) * x(b, j) - x(a, j) * x(b, i) for i, j in ((1, 2), (2, 0), (0, 1))))


def magnitude(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Column) -> Column:
    """Unit length; a vector of almost no length is the zero vector, and no part is a negative zero."""
    m = magnitude(a)
    return F.array(*(F.when(m < NEAR_ZERO, 0.0).otherwise(x(a, k) / m + F.lit(0.0)) for k in range(3)))


def close(a: Column, b: Column, tolerance: float) -> Column:
    return reduce(lambda p, q: p & q, (F.abs(x(a, k) - x(b, k)) <= tolerance for k in range(3)))


def dominant_axis(v: Column, threshold: float = 0.8) -> Column:
    """0, 1 or 2: the axis whose part is over the threshold and over the other two; else null."""
    p = [F.abs(x(v, k)) for k in range(3)]
    pick = F.when((p[0] > threshold) & (p[0] > p[1]) & (p[0] > p[2]), 0)
    return pick.when((p[1] > threshold) & (p[1] > p[0]) & (p[1] > p[2]), 1).when((p[2] > threshold) & (p[2] > p[0]) & (p[2] > p[1]), 2)


def plane(row: Column, col: Column, threshold: float = 0.8) -> Column:
    """TRANSVERSE, CORONAL or SAGITTAL by the two dominant axes of an image's rows and columns, else OBLIQUE."""
    a, b = dominant_axis(row, threshold), dominant_axis(col, threshold)
    low, high = F.least(a, b), F.greatest(a, b)
    known = a.isNotNull() & b.isNotNull()
    return (
        F.when(known & (low == 0) & (high == 1), "TRANSVERSE")
        .when(known & (low == 0) & (high == 2), "CORONAL")
        .when(known & (low == 1) & (high == 2), "SAGITTAL")
        .otherwise("OBLIQUE")
    )


def axis_letter(v: Column, k: int, quadruped: bool = False) -> Column:
    """The patient direction that a vector's part points to."""
    low, high = ((("RT", "LE"), ("V", "D"), ("CD", "CR")) if quadruped else (("R", "L"), ("A", "P"), ("F", "H")))[k]
    return F.when(x(v, k) < 0, low).otherwise(high)


def plane_of_letters(row: Column, col: Column) -> Column:
    """The plane of two patient directions such as L and P; null if they are not two different axes."""

    def axis(c: Column) -> Column:
        first = F.substring(F.upper(F.trim(c)), 1, 1)
        return F.when(first.isin("R", "L"), 0).when(first.isin("A", "P"), 1).when(first.isin("F", "H"), 2)

    a, b = axis(row), axis(col)
    low, high = F.least(a, b), F.greatest(a, b)
    both = a.isNotNull() & b.isNotNull()
    return F.when(both & (low == 0) & (high == 1), "TRANSVERSE").when(both & (low == 0) & (high == 2), "CORONAL").when(both & (low == 1) & (high == 2), "SAGITTAL")


OPPOSITE = {"R": "L", "L": "R", "A": "P", "P": "A", "F": "H", "H": "F", "RT": "LE", "LE": "RT", "V": "D", "D": "V", "CD": "CR", "CR": "CD"}


def orientation_code(text: Column) -> Column:
    """A known direction code, trimmed and in capitals; null if it is not known."""
    code = F.upper(F.trim(text))
    return F.when(code.isin(*OPPOSITE), code)


def opposite(text: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(v) for kv in OPPOSITE.items() for v in kv)), orientation_code(text))
