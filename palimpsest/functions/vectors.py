"""Vector and set arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector, clamped to [-1, 1]."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norm)))


def recency(now: Column, ts: Column, half_life_days: float) -> Column:
    age = (F.unix_micros(now) - F.unix_micros(ts)) / 86400e6
    return F.least(F.lit(1.0), F.pow(F.lit(0.5), age / half_life_days))


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))
