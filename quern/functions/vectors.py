"""Dot products, norms, normalisation and pooling of array<float> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    length = F.nullif(norm(a), F.lit(0.0))
    return F.transform(a, lambda x: x.cast("double") / length)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def mean_pool(vectors: Column, mask: Column) -> Column:
    """Mean of the vectors (array<array>) where the mask (array<int>) is set, of unit length."""
    kept = F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda z: z["m"] > 0)
    width = F.size(F.get(vectors, F.lit(0)))
    total = F.aggregate(kept, F.array_repeat(F.lit(0.0), width), lambda s, z: F.zip_with(s, z["v"], lambda x, y: x + y.cast("double")))
    return unit(F.transform(total, lambda x: x / F.nullif(F.size(kept), F.lit(0))))
