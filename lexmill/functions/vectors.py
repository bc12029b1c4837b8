"""Vectors on columns: unit length, shortening, and stand-in embeddings where no model is at hand."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda x, y: x + y.cast("double") * y.cast("double")))


def unit(vector: Column, zero_is_error: bool = False) -> Column:
    """A vector scaled to length 1; a zero vector stays, or stops the job."""
    size = norm(vector)
    scaled = F.transform(vector, lambda x: x.cast("double") / size)
    return F.when(size > 0, scaled).otherwise(F.raise_error(F.lit("a zero vector has no direction")).cast("array<double>") if zero_is_error else F.transform(vector, lambda x: x.cast("double")))


def shortened(vector: Column, dimension: int) -> Column:
    """The first components, scaled anew."""
    return unit(F.slice(vector, 1, dimension))


def stand_in_embedding(text: Column, dimension: int) -> Column:
    """A vector that depends on the text alone: the bytes of its SHA-256, over and over, each mapped to -1 to 1, at unit length."""
    digest = F.sha2(F.coalesce(text, F.lit("")), 256)
    raw = F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.conv(F.substring(digest, i * 2 % 64 + 1, F.lit(2)), 16, 10).cast("double") / 127.5 - 1.0)
    return unit(raw)
