"""Profiles of keyed groups: means, spreads, dominant dimensions, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import dims as fd
from strandline.operators.ordered import top_k
from strandline.operators.series import unpivot_dims


def mean_vector(df: DataFrame, keys: list[str], dims: list[str]) -> DataFrame:
    """Mean of every dimension per key."""
    return df.groupBy(*keys).agg(*[F.avg(d).alias(d) for d in dims])


def group_profile(
    df: DataFrame,
    group: str,
    entity: str,
    year: str,
    dims: list[str],
    digits: int = 4,
    prefix: str = "avg_",
) -> DataFrame:
    """Entities, rows, rounded means and year span of every group.

    The rows are first reduced to one per (group, entity), so counting distinct
    entities needs no expansion and a hot group is spread over its entities.
    """
    partial = df.filter(F.col(group).isNotNull()).groupBy(group, entity).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min(year).alias("_lo"),
        F.max(year).alias("_hi"),
        *[F.sum(d).alias(f"_s_{d}") for d in dims],
        *[F.count(d).alias(f"_c_{d}") for d in dims],
    )
    return partial.groupBy(group).agg(
        F.count(entity).alias("entity_count"),
        F.sum("_n").alias("row_count"),
        *[
            F.round(F.try_divide(F.sum(f"_s_{d}"), F.sum(f"_c_{d}").cast("double")), digits).alias(prefix + d)
            for d in dims
        ],
        F.min("_lo").alias("earliest_year"),
        F.max("_hi").alias("latest_year"),
        (F.max("_hi") - F.min("_lo")).alias("span_years"),
    )


def with_top_dims(df: DataFrame, cols: list[str], names: list[str], n: int = 3, prefix: str = "top") -> DataFrame:
    """Names and scores of the n largest dimensions as flat columns."""
    out = df.withColumn("_top", fd.top_dims(cols, n, names))
    for i in range(n):
        out = out.withColumn(f"{prefix}_{i + 1}", F.get("_top", F.lit(i))["name"]).withColumn(
            f"{prefix}_{i + 1}_score", F.get("_top", F.lit(i))["score"]
        )
    return out.drop("_top")


def pooled_diversity(df: DataFrame, keys: list[str], dims: list[str], out: str = "diversity") -> DataFrame:
    """Sample standard deviation over all dimensions and rows of a key together."""
    values = F.explode(F.array(*[F.col(d).cast("double") for d in dims])).alias("_v")
    return df.select(*keys, values).groupBy(*keys).agg(F.stddev_samp("_v").alias(out))


def sentiment_summary(
    df: DataFrame,
    keys: list[str],
    time: str,
    compound: Column,
    neutral: str,
    count: str,
    share: float = 0.1,
) -> DataFrame:
    """Level, spread, extremes and begin/end means of the compound score per key.

    ``df`` is a bucketed series. The end of a key's axis is found with a window over
    the key, so the whole summary needs one shuffle on the key. Level and begin/end means are
    summed along time: the last bit of a sum of doubles depends on the order of addition, and
    classes by threshold on that bit.
    """
    along = Window.partitionBy(*keys).orderBy(time)
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marked = df.withColumn("_x", compound).withColumns({"_last": F.max(time).over(whole), "_i": F.row_number().over(along)})
    marked = marked.withColumns({
        "_begin": F.when(F.col(time) <= F.col("_last") * share, F.col("_x")),
        "_end": F.when(F.col(time) >= F.col("_last") * (1 - share), F.col("_x")),
    })
    so_far = along.rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumns({f"_sum{c}": F.sum(c).over(so_far) for c in ("_x", "_begin", "_end")})

    def mean(c: str) -> Column:
        return F.try_divide(F.max_by(f"_sum{c}", "_i"), F.count(c).cast("double"))

    return marked.groupBy(*keys).agg(
        mean("_x").alias("avg_compound"),
        F.stddev_samp("_x").alias("compound_spread"),
        F.max("_x").alias("peak_positive"),
        F.min("_x").alias("peak_negative"),
        (F.max("_x") - F.min("_x")).alias("emotional_range"),
        mean("_begin").alias("beginning"),
        mean("_end").alias("ending"),
        F.count(F.lit(1)).alias("data_points"),
        F.sum(count).cast("bigint").alias("total_lines"),
        F.avg(neutral).alias("avg_neutral"),
    )


def trajectory_class(df: DataFrame, begin: str = "beginning", end: str = "ending", level: str = "avg_compound") -> DataFrame:
    """Rising, falling or stable; positive, negative or neutral tone."""
    change = F.col(end) - F.col(begin)
    return df.withColumn(
        "trajectory",
        F.when(change > 0.15, F.lit("rising")).when(change < -0.15, F.lit("falling")).otherwise(F.lit("stable")),
    ).withColumn(
        "tone",
        F.when(F.col(level) > 0.1, F.lit("positive"))
        .when(F.col(level) < -0.1, F.lit("negative"))
        .otherwise(F.lit("neutral")),
    )


def coverage(df: DataFrame, entity: str, member: str, count: str) -> DataFrame:
    """Distinct entities and members, lines and rows of a series table.

    Rows collapse to one per (entity, member) first, so the distinct counts run over
    that small table.
    """
    pairs = df.groupBy(entity, member).agg(F.sum(count).alias("_l"), F.count(F.lit(1)).alias("_r"))
    return pairs.agg(
        F.countDistinct(entity).alias("entities"),
        F.countDistinct(member).alias("members"),
        F.sum("_l").cast("bigint").alias("lines"),
        F.sum("_r").cast("bigint").alias("rows"),
    )


def entities_per_member(df: DataFrame, entity: str, member: str) -> DataFrame:
    return df.select(entity, member).distinct().groupBy(member).agg(F.count(F.lit(1)).alias("entities"))


def member_averages(df: DataFrame, member: str, dims: list[str], n: int = 3) -> DataFrame:
    """Mean of every dimension per member and the names of its n largest."""
    means = mean_vector(df, [member], dims)
    return means.withColumn("top_names", F.transform(fd.top_dims(dims, n), lambda x: x["name"]))


def baseline_diff(
    df: DataFrame, member: str, dims: list[str], baseline: str, threshold: float = 10.0, limit: int = 20
) -> DataFrame:
    """Percent difference of member means from a baseline member, largest first.

    The baseline is a single row, read as a scalar.
    """
    means = mean_vector(df, [member], dims)
    base_row = means.filter(F.col(member) == baseline).select(F.struct(*dims).alias("b")).scalar()
    others = means.filter(F.col(member) != baseline).withColumn("_b", base_row)
    pairs = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(d).alias("dimension"),
                    F.col("_b")[d].alias("baseline_score"),
                    F.col(d).alias("member_score"),
                )
                for d in dims
            ]
        )
    ).alias("_p")
    long = others.select(member, pairs).select(member, "_p.*")
    diff = (F.col("member_score") - F.col("baseline_score")) / F.nullif(F.col("baseline_score"), F.lit(0.0)) * 100
    return (
        long.filter(F.col("baseline_score") > 0)
        .withColumn("difference_pct", diff)
        .filter(F.abs("difference_pct") > threshold)
        .orderBy(F.abs("difference_pct").desc(), F.col(member), F.col("dimension"))
        .limit(limit)
    )


def member_pairs(vectors: DataFrame, entity: list[str], member: str, dims: list[str]) -> DataFrame:
    """Pairs a < b of an entity's members with both vectors side by side.

    The vectors are one row per (entity, member), so a group holds at most as many
    rows as there are members; the join runs before the dimensions become rows.
    """
    left = vectors.select(*entity, F.col(member).alias("member_a"), F.struct(*dims).alias("va"))
    right = vectors.select(*entity, F.col(member).alias("member_b"), F.struct(*dims).alias("vb"))
    return left.join(right, entity).filter(F.col("member_a") < F.col("member_b"))


def pair_difference(
    vectors: DataFrame,
    entity: list[str],
    member: str,
    dims: list[str],
    labels: list[str] | None = None,
    significant: float = 20.0,
) -> DataFrame:
    """Difference of two members of an entity in every dimension."""
    names = labels or dims
    rows = F.explode(
        F.array(
            *[
                F.struct(F.lit(n).alias("dimension"), F.col("va")[d].alias("score_a"), F.col("vb")[d].alias("score_b"))
                for n, d in zip(names, dims)
            ]
        )
    ).alias("_r")
    long = member_pairs(vectors, entity, member, dims).select(*entity, "member_a", "member_b", rows)
    diff = F.col("_r.score_b") - F.col("_r.score_a")
    pct = F.round(F.try_divide(diff, F.col("_r.score_a")) * 100, 4)
    return long.select(
        *entity,
        "member_a",
        "member_b",
        F.col("_r.dimension").alias("dimension"),
        F.col("_r.score_a").alias("score_a"),
        F.col("_r.score_b").alias("score_b"),
        diff.alias("difference"),
        pct.alias("percent_difference"),
        F.coalesce(F.abs(pct) > significant, F.lit(False)).alias("is_significant"),
    )


def _column_ranking(df: DataFrame, dims: list[str], fn, n: int, exclude: list[str]) -> DataFrame:
    used = [d for d in dims if d not in exclude]
    order = F.array(*[F.lit(d) for d in used])
    one = df.agg(*[fn(d).alias(d) for d in used])
    long = one.unpivot([], used, "dimension", "score")
    return long.orderBy(F.col("score").desc_nulls_last(), F.array_position(order, F.col("dimension"))).limit(n)


def top_n_dimensions(df: DataFrame, dims: list[str], n: int = 5, exclude: list[str] | None = None) -> DataFrame:
    """Dimensions with the largest mean."""
    return _column_ranking(df, dims, F.avg, n, exclude or [])


def volatile_dimensions(df: DataFrame, dims: list[str], n: int = 5) -> DataFrame:
    """Dimensions with the largest sample standard deviation."""
    return _column_ranking(df, dims, F.stddev_samp, n, [])


def display_series(df: DataFrame, dims: list[str], negative: list[str]) -> DataFrame:
    """Negative dimensions with their sign flipped."""
    return df.withColumns({d: -F.col(d) for d in dims if d in negative})


def segment_compare(
    df: DataFrame, segment: str, first: str, second: str, metric: str
) -> DataFrame:
    """Mean of a metric in two segments and their difference in percent."""
    one = df.filter(F.col(segment).isin(first, second)).agg(
        F.avg(F.when(F.col(segment) == first, F.col(metric))).alias("first_mean"),
        F.avg(F.when(F.col(segment) == second, F.col(metric))).alias("second_mean"),
        F.count(F.when(F.col(segment) == first, 1)).alias("first_count"),
        F.count(F.when(F.col(segment) == second, 1)).alias("second_count"),
    )
    diff = F.try_divide(F.col("first_mean") - F.col("second_mean"), F.col("second_mean")) * 100
    return one.select(
        F.lit(first).alias("first_segment"), F.lit(second).alias("second_segment"), "*", diff.alias("difference_pct")
    )


def version_summary(df: DataFrame, keys: list[str], version: str, wanted: str, count: str) -> DataFrame:
    """Rows, lines and lines per row of one version of the data."""
    return (
        df.filter(F.col(version) == wanted)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("minute_count"),
            F.sum(count).cast("bigint").alias("total_lines"),
            F.avg(count).alias("avg_lines"),
        )
    )


def global_top_k(df: DataFrame, value: str, k: int, tie: list[str]) -> DataFrame:
    """Rows with the largest values of the whole table."""
    return df.orderBy(F.col(value).desc_nulls_last(), *[F.col(t).asc() for t in tie]).limit(k)


def peaks_valleys(
    series: DataFrame,
    keys: list[str],
    time: str,
    positive: list[str],
    negative: list[str],
    k: int = 5,
    threshold: float = 0.0,
    positive_names: list[str] | None = None,
    negative_names: list[str] | None = None,
    mode: str = "mean",
) -> DataFrame:
    """The k highest and k lowest compound scores per key with their driving dimensions."""
    scored = series.withColumn("compound", fd.compound(positive, negative, mode))
    if threshold > 0:
        scored = scored.filter(F.abs("compound") > threshold)
    sides = []
    for side, order, cols, names in [
        ("positive", F.col("compound").desc(), positive, positive_names),
        ("negative", F.col("compound").asc(), negative, negative_names),
    ]:
        best = top_k(scored, keys, [order, F.col(time).asc()], k)
        sides.append(
            best.select(
                *keys,
                time,
                F.lit(side).alias("side"),
                "rank",
                "compound",
                fd.top_dims(cols, 3, names).alias("top_dims"),
            )
        )
    return sides[0].unionByName(sides[1]).withColumn("dominant", F.col("top_dims")[0]["name"])


def partition_totals(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Row count and total of a value per key."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("row_count"), F.sum(F.coalesce(F.col(value), F.lit(0.0))).alias("total")
    )


def pivot_max(df: DataFrame, keys: list[str], selector: str, values: list, out: dict) -> DataFrame:
    """Conditional maximum per listed selector value."""
    return df.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col(selector) == v, F.col(column))).alias(name.format(v))
            for v in values
            for name, column in out.items()
        ]
    )


