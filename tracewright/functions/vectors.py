"""Vector expressions over array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column) -> Column:
    """L2-normalised; the zero vector stays."""
    # The norm is bound by a lambda: as a plain expression it would be evaluated for every component.
    return F.element_at(F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x))), 1)


def as_double(v: Column) -> Column:
    return v.cast("array<double>")
