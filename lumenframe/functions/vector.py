"""Vector expressions over ARRAY columns. All are built-in higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value) with value worked out once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column, policy: str = "guard") -> Column:
    """Unit vector. guard leaves vectors of norm up to 1e-6 alone, add divides by norm + 1e-8, clip by at least 1e-12."""
    def scaled(n):
        by = {"guard": F.when(n > 1e-6, n).otherwise(F.lit(1.0)), "add": n + 1e-8, "clip": F.greatest(n, F.lit(1e-12))}[policy]
        return F.transform(v, lambda x: x / by)

    return let(norm(v), scaled)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def softmax(v: Column, temperature: float = 1.0) -> Column:
    """Softmax of temperature * v, shifted by its maximum."""
    e = let(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp((x - top) * temperature)))
    return let(e, lambda e: F.transform(e, lambda x: x / total(e)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def activated(v: Column) -> Column:
    """Probabilities: the vector itself if it lies within [-0.01, 1.01], else its sigmoid."""
    return F.when(F.exists(v, lambda x: (x < -0.01) | (x > 1.01)), F.transform(v, sigmoid)).otherwise(v)


def argmax(v: Column) -> Column:
    """The first place of the greatest element, from 0."""
    return F.array_position(v, F.array_max(v)).cast("int") - 1
