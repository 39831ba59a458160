"""Vector arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 when lengths differ or a norm is 0."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (size == 0), F.lit(0.0)).otherwise(dot(a, b) / size)


def unit(a: Column) -> Column:
    size = norm(a)
    return F.when(size == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / size))


def without_centre(query: Column, centre: Column, share: float = 0.3) -> Column:
    """The query less a share of the corpus' centre, as a unit vector; as it is if lengths differ."""
    moved = F.zip_with(query, centre, lambda x, y: x.cast("double") - F.lit(share) * y)
    return F.when(F.size(query) == F.size(centre), unit(moved)).otherwise(F.transform(query, lambda x: x.cast("double")))


def half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5)).cast("int")
