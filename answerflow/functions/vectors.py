"""Vector arithmetic on `array<float>` and `array<double>` columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda total, x: total + x,
    )


def norm(a: Column) -> Column:
    return F.sqrt(
        F.aggregate(a, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    )


def l2_normalize(a: Column) -> Column:
    """Unit vector in double precision; a zero vector stays as it is."""
    # The length goes through a one-element array, or it would be computed once per element.
    return F.transform(
        F.array(norm(a)),
        lambda n: F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0))),
    )[0]


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance."""
    return F.sqrt(
        F.aggregate(
            F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")),
            F.lit(0.0),
            lambda total, x: total + x * x,
        )
    )
