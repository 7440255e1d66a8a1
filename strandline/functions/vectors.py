"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0.0 when either vector has no length."""
    length = norm(a) * norm(b)
    return F.when(length > 0.0, F.try_divide(dot(a, b), length)).otherwise(F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    """Euclidean distance; 1.0 when there is nothing to compare."""
    squares = F.aggregate(
        F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.sqrt(squares))


def distance_to_similarity(distance: Column, max_distance: Column) -> Column:
    """1 - d/max, floored at 0; 1.0 when the largest distance is 0."""
    return F.when(max_distance == 0.0, F.lit(1.0)).otherwise(
        F.greatest(F.lit(0.0), F.lit(1.0) - F.try_divide(distance, max_distance))
    )


def to_unit_sum(a: Column) -> Column:
    """Divide by the sum of the elements when that sum is positive."""
    total = F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return F.when(total > 0.0, F.transform(a, lambda x: x.cast("double") / total)).otherwise(
        F.transform(a, lambda x: x.cast("double"))
    )


def has_nan(a: Column) -> Column:
    return F.exists(a, lambda x: F.isnan(x))


def has_inf(a: Column) -> Column:
    return F.exists(a, lambda x: F.abs(x.cast("double")) == F.lit(float("inf")))
