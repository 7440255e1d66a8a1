"""Correlation of metrics and comparison of aligned series."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.stats import pearson_p_value, safe_corr
from strandline.operators.ordered import top_k


def pearson(df: DataFrame, x: str, y: str, p_value: bool = True) -> DataFrame:
    """Correlation of two columns with its strength, direction and significance.

    One aggregation over the pairs without NULL; fewer than two pairs give NULLs and
    the status ``insufficient_data``.
    """
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    one = df.agg(F.count(F.when(both, 1)).alias("n"), safe_corr(x, y).alias("r"))
    strength = F.when(F.abs("r") < 0.3, "weak").when(F.abs("r") < 0.7, "moderate").when(F.abs("r") <= 2.0, "strong")
    out = one.select(
        "n",
        "r",
        strength.alias("strength"),
        F.when(F.col("r") > 0, "positive").when(F.col("r").isNotNull(), "negative").alias("direction"),
        F.when(F.col("n") < 2, "insufficient_data").when(F.col("r").isNull(), "undefined").otherwise("ok").alias("status"),
    )
    if not p_value:
        return out
    return out.withColumn("p_value", pearson_p_value(F.col("r"), F.col("n"))).withColumn(
        "is_significant", F.coalesce(F.col("p_value") < 0.05, F.lit(False))
    )


def align_members(
    series: DataFrame, keys: list[str], time: str, member: str, value: str, members: list[str]
) -> DataFrame:
    """One column per member over the union of buckets, NULL where a member has none."""
    return series.filter(F.col(member).isin(members)).groupBy(*keys, time).agg(
        *[F.max(F.when(F.col(member) == m, F.col(value))).alias(m) for m in members]
    )


def pairwise_correlation(aligned: DataFrame, keys: list[str], members: list[str]) -> DataFrame:
    """Correlation of every member pair over their common buckets (two at least).

    All pairs come out of a single aggregation over the aligned columns.
    """
    pairs = list(combinations(members, 2))
    stats = []
    for i, (a, c) in enumerate(pairs):
        both = F.col(f"`{a}`").isNotNull() & F.col(f"`{c}`").isNotNull()
        stats.append(F.count(F.when(both, 1)).alias(f"n{i}"))
        stats.append(safe_corr(F.col(f"`{a}`"), F.col(f"`{c}`")).alias(f"r{i}"))
    wide = aligned.groupBy(*keys).agg(*stats)
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(a).alias("member_a"),
                    F.lit(c).alias("member_b"),
                    F.col(f"n{i}").alias("n"),
                    F.when(F.col(f"n{i}") >= 2, F.col(f"r{i}")).alias("r"),
                )
                for i, (a, c) in enumerate(pairs)
            ]
        )
    ).alias("_p")
    return wide.select(*keys, rows).select(*keys, "_p.*").filter(F.col("n") >= 2)


def correlation_summary(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Average correlation and the closest and the most different pair."""
    name = F.concat_ws("-", "member_a", "member_b")
    usable = pairs.filter(F.col("r").isNotNull())
    return usable.groupBy(*keys).agg(
        F.avg("r").alias("avg_correlation"),
        F.max_by(name, F.struct("r", name)).alias("closest_pair"),
        F.min_by(name, F.struct("r", name)).alias("most_different_pair"),
    )


def _present(members: list[str]):
    return F.filter(F.array(*[F.col(f"`{m}`") for m in members]), lambda v: v.isNotNull())


def divergence(aligned: DataFrame, keys: list[str], time: str, members: list[str], k: int = 3, digits: int = 9) -> DataFrame:
    """Buckets where the members differ most (population variance, two members at least).

    Variances that agree in ``digits`` decimals count as ties, the earlier bucket first.
    """
    values = _present(members)
    size = F.size(values).cast("double")
    mean = F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), size)
    spread = F.try_divide(
        F.aggregate(F.transform(values, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x), size
    )
    scored = aligned.filter(F.size(values) > 1).withColumn("variance", F.round(spread, digits))
    return top_k(scored, keys, [F.col("variance").desc(), F.col(time).asc()], k).select(
        *keys, time, "variance", "rank"
    )


def arc_stats(series: DataFrame, keys: list[str], member: str, value: str) -> DataFrame:
    """Mean, extremes and number of buckets per member."""
    return series.filter(F.col(value).isNotNull()).groupBy(*keys, member).agg(
        F.avg(value).alias("avg"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("n")
    )


def arc_peaks(series: DataFrame, keys: list[str], time: str, member: str, value: str, k: int = 3) -> DataFrame:
    """Best buckets of every member."""
    return top_k(
        series.filter(F.col(value).isNotNull()).select(*keys, member, time, value),
        [*keys, member],
        [F.col(value).desc(), F.col(time).asc()],
        k,
    )


def distinctive_peaks(
    series: DataFrame,
    aligned: DataFrame,
    keys: list[str],
    time: str,
    member: str,
    value: str,
    members: list[str],
    k: int = 3,
    margin: float = 0.1,
) -> DataFrame:
    """Member peaks that exceed the mean of the other members by a margin."""
    peaks = arc_peaks(series.filter(F.col(member).isin(members)), keys, time, member, value, k)
    values = F.array(*[F.struct(F.lit(m).alias("m"), F.col(f"`{m}`").alias("v")) for m in members])
    joined = peaks.join(aligned, [*keys, time])
    others = F.filter(values, lambda e: (e["m"] != F.col(member)) & e["v"].isNotNull())
    mean = F.try_divide(
        F.aggregate(others, F.lit(0.0), lambda a, e: a + e["v"]), F.size(others).cast("double")
    )
    return (
        joined.withColumn("others_mean", mean)
        .filter(F.col("others_mean").isNotNull() & (F.col(value) > F.col("others_mean") + margin))
        .select(*keys, member, time, value, "rank", "others_mean")
    )
