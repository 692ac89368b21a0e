"""Vector scoring as Column expressions over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "dot-product", "euclidean")


def _fold(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def score(query: Column, candidate: Column, metric: str) -> Column:
    """Similarity, greater is nearer: cosine (0 for a zero vector), inner product, or the distance negated."""
    if metric == "dot-product":
        return dot(query, candidate)
    if metric == "euclidean":
        gap = F.zip_with(query, candidate, lambda x, y: x.cast("double") - y.cast("double"))
        return F.lit(0.0) - F.sqrt(_fold(F.transform(gap, lambda d: d * d)))
    if metric == "cosine":
        size = F.sqrt(dot(query, query)) * F.sqrt(dot(candidate, candidate))
        return F.when(size == 0, F.lit(0.0)).otherwise(dot(query, candidate) / size)
    raise ValueError(f"unknown metric {metric!r}")


def valid(vector: Column, dimensions: int) -> Column:
    """Whether a vector has the right length and finite components only."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dimensions) & finite, F.lit(False))


def fake_embedding(text: Column, mode: str, dimensions: int) -> Column:
    """A deterministic unit vector from SHA-256 of mode, text and place; float32 components."""
    def component(i: Column) -> Column:
        digest = F.sha2(F.concat(F.lit(mode + "\u0000"), text, F.lit("\u0000"), i.cast("string")), 256)
        word = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
        signed = F.when(word >= 2**31, word - 2**32).otherwise(word)
        return (signed / F.lit(float(2**31))).cast("float").cast("double")

    plain = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), component)
    size = F.sqrt(_fold(F.transform(plain, lambda x: x * x)))
    return F.transform(plain, lambda x: F.when(size > 0, x / size).otherwise(x).cast("float"))


def sigmoid(x: Column) -> Column:
    """Logistic function without overflow for either sign."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))
