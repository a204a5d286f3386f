"""Vector arithmetic as column expressions in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    """Dot product over the shorter length; null if either is null."""
    n = F.least(F.size(a), F.size(b))
    return F.when(a.isNotNull() & b.isNotNull(), F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """Scaled to unit length; a zero vector stays as it is."""
    n = norm(v)
    return F.transform(v, lambda x: x.cast("double") / F.when(n > 0, n).otherwise(1.0))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def usable(v: Column, dims: int) -> Column:
    """True for a vector of ``dims`` finite components that are not all zero."""
    return F.coalesce((F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))


def parse_vector(text: Column) -> Column:
    """A JSON array as a vector, else null."""
    return F.from_json(text, "array<double>")


def merge_centroid(centroid: Column, n: Column, v: Column) -> Column:
    """Centroid of n unit vectors after one more joins: unit((c * n + v) / (n + 1))."""
    return unit(F.zip_with(centroid, v, lambda c, x: (c.cast("double") * n + x.cast("double")) / (n + 1)))
