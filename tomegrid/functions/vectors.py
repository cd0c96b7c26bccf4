"""Vector arithmetic as column expressions; cosine with a zero vector is 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def l2_normalize(v: Column) -> Column:
    """Unit vector; the zero vector stays zero."""
    n = norm(v)
    return F.transform(as_double(v), lambda x: F.coalesce(F.try_divide(x, n), F.lit(0.0)))


def literal(values: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])
