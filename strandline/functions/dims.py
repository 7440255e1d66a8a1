"""Expressions over the score dimensions of one row (no shuffle, no UDF)."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(cols: list[str]) -> Column:
    """Sum of columns, left to right."""
    return reduce(add, [F.col(c) for c in cols])


def compound(positive: list[str], negative: list[str], mode: str = "sum") -> Column:
    """Positive minus negative dimensions.

    ``mode="sum"`` subtracts the sums, ``mode="mean"`` the means. The wider 12/12
    form is the sum mode over the wider label groups.
    """
    if mode == "sum":
        return total(positive) - total(negative)
    if mode == "mean":
        return total(positive) / F.lit(float(len(positive))) - total(negative) / F.lit(
            float(len(negative))
        )
    raise ValueError(f"unknown compound mode: {mode}")


def strongest_value(cols: list[str]) -> Column:
    """Largest dimension of the row."""
    return F.greatest(*[F.col(c) for c in cols])


def dominant_name(cols: list[str], names: list[str] | None = None, default: str | None = None) -> Column:
    """Name of the largest dimension; ties go to the earlier column."""
    names = names or cols
    peak = strongest_value(cols)
    branch = F.when(peak == F.col(cols[0]), F.lit(names[0]))
    for col, name in zip(cols[1:], names[1:]):
        branch = branch.when(peak == F.col(col), F.lit(name))
    return branch.otherwise(F.lit(default if default is not None else names[-1]))


def _positive_peak(cols: list[str], names: list[str]) -> tuple[Column, Column]:
    value = F.greatest(F.lit(0.0), *[F.coalesce(F.col(c), F.lit(0.0)) for c in cols])
    branch = F.when(value <= 0.0, F.lit(None).cast("string"))
    for col, name in zip(cols, names):
        branch = branch.when(F.col(col) == value, F.lit(name))
    return value, branch


def dominant_signed(
    positive: list[str],
    negative: list[str],
    positive_names: list[str] | None = None,
    negative_names: list[str] | None = None,
) -> Column:
    """Struct(score, name, intensity, polarity); a tie counts as negative."""
    pos_value, pos_name = _positive_peak(positive, positive_names or positive)
    neg_value, neg_name = _positive_peak(negative, negative_names or negative)
    wins = pos_value > neg_value
    return F.struct(
        F.when(wins, pos_value).otherwise(-neg_value).alias("score"),
        F.when(wins, pos_name).otherwise(neg_name).alias("name"),
        F.when(wins, pos_value).otherwise(neg_value).alias("intensity"),
        F.when(wins, F.lit("positive")).otherwise(F.lit("negative")).alias("polarity"),
    )


def row_diversity(cols: list[str], digits: int | None = 4) -> Column:
    """Population standard deviation across the columns of one row."""
    n = float(len(cols))
    values = F.array(*[F.col(c).cast("double") for c in cols])
    mean = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x) / F.lit(n)
    spread = F.aggregate(
        F.transform(values, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda acc, x: acc + x
    )
    out = F.sqrt(spread / F.lit(n))
    return out if digits is None else F.round(out, digits)


def top_dims(cols: list[str], n: int, names: list[str] | None = None) -> Column:
    """The n largest dimensions as array<struct(name, score)>, without a shuffle.

    Ties keep the column order given.
    """
    names = names or cols
    entries = F.array(
        *[
            F.struct(
                (-F.col(c)).alias("neg"),
                F.lit(i).alias("pos"),
                F.lit(name).alias("name"),
                F.col(c).alias("score"),
            )
            for i, (c, name) in enumerate(zip(cols, names))
        ]
    )
    return F.transform(
        F.slice(F.array_sort(entries), 1, n),
        lambda e: F.struct(e["name"].alias("name"), e["score"].alias("score")),
    )


def nonzero_dims(cols: list[str], threshold: float = 0.01, names: list[str] | None = None) -> Column:
    """Map of the dimensions above a threshold."""
    names = names or cols
    pairs = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(c) for c in cols]))
    return F.map_filter(pairs, lambda _, v: v > threshold)


def out_of_range(cols: list[str], low: float = 0.0, high: float = 1.0) -> Column:
    """True when any dimension lies outside the range."""
    return reduce(lambda a, b: a | b, [(F.col(c) < low) | (F.col(c) > high) for c in cols])


def any_null(cols: list[str]) -> Column:
    """True when any dimension is NULL."""
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])
