"""Statistics on single aggregated rows and exact quantiles over whole tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _tail_probability(t: float, dof: float) -> float:
    """Two-sided Student-t tail by the regularised incomplete beta function."""
    import math

    if dof <= 0 or math.isnan(t):
        return float("nan")
    if math.isinf(t):
        return 0.0
    a, b, x = dof / 2.0, 0.5, dof / (dof + t * t)
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0

    def fraction(a: float, b: float, x: float) -> float:
        # Modified Lentz evaluation of the continued fraction.
        tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1.0)
        d = 1.0 / (d if abs(d) > tiny else tiny)
        h = d
        for m in range(1, 500):
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            d = 1.0 + even * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + even / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            d = 1.0 + odd * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + odd / c
            c = c if abs(c) > tiny else tiny
            step = d * c
            h *= step
            if abs(step - 1.0) < 1e-15:
                break
        return h

    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return min(1.0, front * fraction(a, b, x) / a)
    return max(0.0, 1.0 - front * fraction(b, a, 1.0 - x) / b)


def pearson_p_value(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation; meant for one row per tested pair."""

    @F.pandas_udf("double")
    def p_value(r: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for rv, nv in zip(r, n):
            if pd.isna(rv) or pd.isna(nv):
                out.append(None)
            elif nv <= 2:
                out.append(1.0)
            elif abs(rv) >= 1.0:
                out.append(0.0)
            else:
                out.append(_tail_probability(rv * ((nv - 2) / (1 - rv * rv)) ** 0.5, nv - 2))
        return pd.Series(out, dtype="float64")

    return p_value(r, n)


def safe_corr(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation over the pairs without NULL; NULL when a side is constant."""
    x = F.col(x) if isinstance(x, str) else x
    y = F.col(y) if isinstance(y, str) else y
    both = x.isNotNull() & y.isNotNull()
    xs, ys = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    moment = F.covar_pop(xs, ys)
    spread = F.stddev_pop(xs) * F.stddev_pop(ys)
    return F.try_divide(moment, spread)


def exact_quantiles(
    df: DataFrame, column: str, probabilities: list[float], accuracy: int = 10000, most: int = 1_000_000
) -> list[float | None]:
    """Interpolated quantiles (PERCENTILE_CONT) of a whole column.

    A sketch of each bracket proposes a narrower one, a count says which part holds the wanted
    rank, and so on until a bracket holds at most ``most`` values or a single one; only then is
    the exact percentile taken of what is inside. No task holds more than ``most`` values, however
    long the column is, and one row of numbers reaches the driver in each pass.
    """
    values = df.select(F.col(column).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    whole = values.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    n = whole["n"]
    if n == 0:
        return [None] * len(probabilities)
    inside = lambda lo, hi: (F.col("v") >= lo) & (F.col("v") <= hi)
    ranks = [p * (n - 1) for p in probabilities]
    # low edge, high edge, values below it, values inside
    brackets = [(whole["lo"], whole["hi"], 0, n) for _ in ranks]
    margin = 2.0 / accuracy
    while wide := [i for i, (lo, hi, _, m) in enumerate(brackets) if m > most and lo < hi]:
        shares = {i: (ranks[i] - brackets[i][2]) / max(1, brackets[i][3] - 1) for i in wide}
        edges = values.agg(
            *[
                F.percentile_approx(
                    F.when(inside(*brackets[i][:2]), F.col("v")), [max(0.0, shares[i] - margin), min(1.0, shares[i] + margin)], accuracy
                ).alias(f"e{i}")
                for i in wide
            ]
        ).first()
        counts = values.agg(
            *[F.count(F.when(F.col("v") < edges[f"e{i}"][0], 1)).alias(f"b{i}") for i in wide],
            *[F.count(F.when(F.col("v") <= edges[f"e{i}"][1], 1)).alias(f"t{i}") for i in wide],
        ).first()
        stuck = True
        for i in wide:
            lo, hi, below, m = brackets[i]
            new_lo, new_hi, b, t = edges[f"e{i}"][0], edges[f"e{i}"][1], counts[f"b{i}"], counts[f"t{i}"]
            # both neighbours of the rank must lie inside
            first, last = int(ranks[i] // 1), int(-(-ranks[i] // 1))
            if b > first:
                new_lo, b = lo, below
            if t <= last:
                new_hi, t = hi, below + m
            stuck &= (new_lo, new_hi) == (lo, hi)
            brackets[i] = (new_lo, new_hi, b, t - b)
        if stuck:
            margin /= 8
            if margin < 1e-9:
                break
    picks = []
    for i, (lo, hi, below, m) in enumerate(brackets):
        share = 0.0 if m <= 1 else min(1.0, max(0.0, (ranks[i] - below) / (m - 1)))
        picks.append(F.percentile(F.when(inside(lo, hi), F.col("v")), F.lit(share)).alias(f"q{i}"))
    return list(values.agg(*picks).first())


def half_up_ratio(num: Column, den: Column, digits: int) -> Column:
    """num / den of whole numbers, rounded half away from zero, in whole numbers up to the last step.

    Free of the order of sums and of the rounding of doubles; 0 where there is nothing to divide by.
    """
    n, d = (F.coalesce(c, F.lit(0)).cast("decimal(38,0)") for c in (num, den))
    scaled = F.abs(n) * F.lit(2 * 10**digits).cast("decimal(12,0)") + d
    units = F.call_function("div", scaled, F.nullif(d * F.lit(2), F.lit(0).cast("decimal(38,0)")))
    return F.coalesce(F.sign(n) * units / F.lit(float(10**digits)), F.lit(0.0))
