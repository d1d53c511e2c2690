"""Vector Column expressions (JVM side, codegen-able).

Spark 4.1 has no built-in vector arithmetic on ARRAY<FLOAT> columns, so these
compose higher-order functions. They are used on bounded per-row work
(anchor checks, signed query vectors); the all-rows similarity scan lives in
``operators.similarity``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .materials import let


def dot(a: Column, b: Column) -> Column:
    """Sum of element-wise products, accumulated in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0).cast("double"),
                              lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null when either vector has zero length."""
    den = norm(a) * norm(b)
    return F.when(den > 0, dot(a, b) / den)


def unit(a: Column) -> Column:
    """The vector of length 1; null without a length. The norm is bound once:
    inside the lambda it would be worked out again for every component."""
    return let(norm(a), lambda n: F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)))


def scale(a: Column, s: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double") * s)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") + y.cast("double"))
