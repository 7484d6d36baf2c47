"""Vector functions as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors within [-1, 1]; null for unequal lengths, a zero vector and any value that isn't finite."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = dot(a, b) / norms
    fine = (F.size(a) == F.size(b)) & (norms > 0) & ~F.isnan(norms) & (norms < F.lit(float("inf")))
    return F.when(fine, F.greatest(F.least(value, F.lit(1.0)), F.lit(-1.0)))


def literal(vector: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))
