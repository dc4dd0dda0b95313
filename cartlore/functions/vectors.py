"""Arithmetic on array columns, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def dot(left: Column, right: Column) -> Column:
    """Inner product in double precision."""
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))


def l2_normalize(vector: Column) -> Column:
    """Unit-length vector; the zero vector stays zero."""
    length = F.greatest(norm(vector), F.lit(EPS))
    return F.transform(vector, lambda x: x.cast("double") / length)


def cosine(left: Column, right: Column) -> Column:
    return dot(left, right) / (F.greatest(norm(left), F.lit(EPS)) * F.greatest(norm(right), F.lit(EPS)))
