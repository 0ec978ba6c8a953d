"""Vector arithmetic on array columns, in double precision and inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Raw cosine; 0 where a vector has no length."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, dot(a, b) / lengths).otherwise(F.lit(0.0))


def clipped_cosine(a: Column, b: Column) -> Column:
    """Cosine limited to 0..1, as similarity edges store it."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), cosine(a, b)))


def normalized_score(cos: Column) -> Column:
    """Index score (1 + cosine) / 2."""
    return (1 + cos) / 2
