"""Vectors: group means by partial aggregation, norms, cosines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: x - y)
    return F.sqrt(dot(d, d))


def cosine(a: Column, b: Column) -> Column:
    """Zero vectors have similarity 0 to everything."""
    return F.coalesce(dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(0.0))


def cosine_eps(a: Column, b: Column, eps: float = 1e-10) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + eps)


def mean_vectors(df: DataFrame, keys: list[str], vector: str, name: str = "mean") -> DataFrame:
    """Mean vector and row count by key: one partial and one final aggregate over (key, position)."""
    parts = df.select(*keys, F.posexplode(F.col(vector).cast("array<double>")).alias("pos", "x"))
    sums = parts.groupBy(*keys, "pos").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    packed = F.array_sort(F.collect_list(F.struct("pos", "x")))
    return sums.groupBy(*keys).agg(F.transform(packed, lambda s: s["x"]).alias(name), F.max("n").alias("n"))
