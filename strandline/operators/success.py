"""Success metrics: standardised scores, tiers, return on investment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.stats import exact_quantiles


def zscores(df: DataFrame, values: list[str], present: str, suffix: str = "_zscore") -> DataFrame:
    """(x - mean) / sample deviation, with statistics over rows where ``present`` is set.

    The statistics are one row, read as scalar subqueries; nothing is shuffled.
    """
    stats = df.filter(F.col(present).isNotNull()).agg(
        F.struct(
            *[F.avg(v).alias(f"m_{v}") for v in values], *[F.stddev_samp(v).alias(f"s_{v}") for v in values]
        ).alias("s")
    )
    out = df.withColumn("_stats", stats.scalar())
    for v in values:
        deviation = F.col("_stats")[f"s_{v}"]
        out = out.withColumn(
            v + suffix,
            F.when(
                F.col(v).isNotNull() & (deviation > 0),
                F.try_divide(F.col(v) - F.col("_stats")[f"m_{v}"], deviation),
            ),
        )
    return out.drop("_stats")


def quartile_tier(df: DataFrame, value: str, out: str = "revenue_tier") -> DataFrame:
    """Quartile class by interpolated quartiles; NULL falls into the lowest class."""
    q75, q50, q25 = exact_quantiles(df, value, [0.75, 0.5, 0.25])
    x = F.col(value)
    return df.withColumn(
        out,
        F.when(x >= F.lit(q75), F.lit("top_quartile"))
        .when(x >= F.lit(q50), F.lit("above_median"))
        .when(x >= F.lit(q25), F.lit("below_median"))
        .otherwise(F.lit("bottom_quartile")),
    )


def threshold_tier(value: str | Column) -> Column:
    """Class by fixed thresholds; NULL falls into the lowest class."""
    x = F.col(value) if isinstance(value, str) else value
    return (
        F.when(x >= 90, F.lit("certified_fresh"))
        .when(x >= 75, F.lit("fresh"))
        .when(x >= 60, F.lit("mixed"))
        .otherwise(F.lit("rotten"))
    )


def roi(revenue: str, budget: str) -> Column:
    """(revenue - budget) / budget for positive budgets."""
    return F.when(
        F.col(budget) > 0, F.try_divide(F.col(revenue) - F.col(budget), F.nullif(F.col(budget), F.lit(0.0)))
    )


def composite_score(scores: list[str], digits: int = 4) -> Column:
    """Mean of the scores that are present; NULL when none is."""
    total = F.lit(0.0)
    present = F.lit(0)
    for s in scores:
        total = total + F.coalesce(F.col(s), F.lit(0.0))
        present = present + F.when(F.col(s).isNotNull(), F.lit(1)).otherwise(F.lit(0))
    return F.round(F.try_divide(total, F.nullif(present, F.lit(0)).cast("double")), digits)


def success_metrics(df: DataFrame, revenue: str, budget: str, critic: str) -> DataFrame:
    """Z-scores, tiers, return and composite score next to the input columns."""
    scored = zscores(df, [revenue, critic], revenue)
    tiers = quartile_tier(scored, revenue)
    z = [f"{revenue}_zscore", f"{critic}_zscore"]
    return (
        tiers.withColumn("roi", roi(revenue, budget))
        .withColumn("critical_reception_tier", threshold_tier(critic))
        .withColumn("has_revenue_data", F.col(revenue).isNotNull())
        .withColumn("has_critic_data", F.col(critic).isNotNull())
        .withColumn("composite_success_score", composite_score(z))
        .withColumns({name: F.round(F.col(name), 4) for name in z})
    )
