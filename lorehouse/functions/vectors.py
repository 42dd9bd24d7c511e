"""Vector arithmetic in DOUBLE on array columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(v: Column, query: Sequence[float]) -> Column:
    """1 - cosine; null for vectors that are null, zero or of another length."""
    q = F.array(*[F.lit(float(x)) for x in query])
    v = v.cast("array<double>")
    norms = F.sqrt(dot(v, v)) * F.lit(sum(float(x) ** 2 for x in query) ** 0.5)
    return F.when((F.size(v) == len(query)) & (norms > 0), 1 - dot(v, q) / norms)
