"""Vector expressions over ARRAY<FLOAT>, computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Added to the product of norms, so that zero vectors have similarity 0.
EPS = 1e-10


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """dot / (norm * norm + EPS); null if the lengths differ or either is null."""
    return F.when(F.size(a) == F.size(b), dot(a, b) / (norm(a) * norm(b) + F.lit(EPS)))


def normalized(a: Column) -> Column:
    """Unit length if the norm exceeds EPS, else unchanged."""
    n = norm(a)
    return F.when(n > F.lit(EPS), F.transform(a, lambda x: (x.cast("double") / n).cast("float"))).otherwise(a)


def quantized(a: Column) -> Column:
    """INT8 form of a vector: struct of the greatest magnitude and the rounded 127ths of it."""
    top = F.array_max(F.transform(a, lambda x: F.abs(x)))
    return F.struct(top.alias("top"), F.transform(a, lambda x: F.when(top > 0, F.round(x / top * 127)).otherwise(0).cast("tinyint")).alias("codes"))


def dequantized(codes: Column, top: Column) -> Column:
    """Read path of the old INT8 form: code / 127 * top."""
    return F.transform(codes, lambda x: x.cast("double") / F.lit(127.0) * top)
