"""Vector scalars (M1-M4): everything stays in JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a.cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for a zero vector, so that such rows never rank."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def cosine_or_zero(a: Column, b: Column) -> Column:
    return F.coalesce(cosine(a, b), F.lit(0.0))


def parse_vector(text: Column) -> Column:
    """'[v1,v2,...]' to array<float>."""
    return F.from_json(text, "array<float>")


def format_vector(v: Column) -> Column:
    return F.to_json(v)


def zero_vector(size: int) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), size)
