"""Time series: bucketing, smoothing, derivatives, peaks, islands.

The input of the window operators is a bucketed series: one row per key and bucket.
A key's window therefore holds as many rows as the time axis has buckets, however
many raw rows the key has; raw rows are averaged with map-side partial sums first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import text
from strandline.operators.ordered import chunked_previous, chunked_running_sum, top_k


def minute_aggregate(
    lines: DataFrame,
    keys: list[str],
    seconds: str,
    dims: list[str],
    width: int = 60,
    bucket: str = "minute_offset",
    count: str = "dialogue_count",
) -> DataFrame:
    """Mean of every dimension and number of lines per key and time bucket."""
    return (
        lines.withColumn(bucket, text.minute_bucket(seconds, width))
        .groupBy(*keys, bucket)
        .agg(F.count(F.lit(1)).alias(count), *[F.avg(F.coalesce(F.col(d), F.lit(0.0))).alias(d) for d in dims])
    )


def frame_centered(before: int, after: int, keys: list[str], time: str):
    return Window.partitionBy(*keys).orderBy(time).rowsBetween(-before, after)


def rolling_mean(
    series: DataFrame,
    keys: list[str],
    time: str,
    dims: list[str],
    before: int = 5,
    after: int = 5,
    suffix: str = "",
    by_value: bool = False,
) -> DataFrame:
    """Centred mean over rows (or, with ``by_value``, over time units)."""
    base = Window.partitionBy(*keys).orderBy(time)
    frame = base.rangeBetween(-before, after) if by_value else base.rowsBetween(-before, after)
    return series.withColumns({d + suffix: F.avg(d).over(frame) for d in dims})


def pandas_frame(window: int) -> tuple[int, int]:
    """Rows before and after for a centred rolling window of this size."""
    return window // 2, (window - 1) // 2


def rolling_mean_window(
    series: DataFrame, keys: list[str], time: str, dims: list[str], window: int = 10, suffix: str = ""
) -> DataFrame:
    """Centred rolling mean of ``window`` rows, shorter at the edges."""
    before, after = pandas_frame(window)
    return rolling_mean(series, keys, time, dims, before, after, suffix)


# Window size -> rows before and after.
SMOOTHING_FRAMES = {3: (1, 1), 5: (2, 2), 10: (4, 5), 15: (7, 7), 20: (9, 10)}


def multi_window_smooth(
    series: DataFrame,
    keys: list[str],
    time: str,
    value: str,
    frames: dict[int, tuple[int, int]] | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """The series smoothed with several window sizes, one row per size.

    All frames share one partitioning and one sort; the sizes are unpivoted after.
    """
    frames = frames or SMOOTHING_FRAMES
    keep = keep or []
    wide = series.select(
        *keys,
        time,
        *keep,
        *[
            F.avg(value).over(frame_centered(b, a, keys, time)).alias(f"_w{size}")
            for size, (b, a) in frames.items()
        ],
    )
    pairs = F.explode(
        F.array(
            *[
                F.struct(F.lit(size).cast("bigint").alias("size"), F.col(f"_w{size}").alias("score"))
                for size in frames
            ]
        )
    ).alias("_p")
    return wide.select(*keys, time, *keep, pairs).select(
        *keys,
        time,
        *keep,
        F.col("_p.size").alias("window_size"),
        F.col("_p.score").alias("smoothed_score"),
    )


def first_derivative(series: DataFrame, keys: list[str], time: str, value: str, out: str = "first_derivative") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(time)
    return series.withColumn(out, F.col(value) - F.lag(value).over(w))


def second_derivative(series: DataFrame, keys: list[str], time: str, value: str, out: str = "second_derivative") -> DataFrame:
    first = first_derivative(series, keys, time, value, "_d1")
    return first_derivative(first, keys, time, "_d1", out).drop("_d1")


def local_maxima(series: DataFrame, keys: list[str], time: str, value: str, out: str = "is_peak") -> DataFrame:
    """1 where the value exceeds both neighbours; edges are 0."""
    w = Window.partitionBy(*keys).orderBy(time)
    above = (F.col(value) > F.lag(value).over(w)) & (F.col(value) > F.lead(value).over(w))
    return series.withColumn(out, F.when(above, F.lit(1)).otherwise(F.lit(0)))


def methodology_metrics(
    series: DataFrame,
    keys: list[str],
    time: str,
    value: str,
    duration: str,
    frames: dict[int, tuple[int, int]] | None = None,
    recommended: int = 10,
) -> DataFrame:
    """Noise, peak count, intensity and precision loss per smoothing window.

    Smoothing, both derivatives and the peak test run over one partitioning of the
    wide series (a struct per window size), so there is one shuffle and one sort
    before the final aggregation. Rows without a second derivative do not count.
    """
    frames = frames or SMOOTHING_FRAMES
    w = Window.partitionBy(*keys).orderBy(time)
    smooth = series.select(
        *keys,
        time,
        duration,
        *[F.avg(value).over(frame_centered(b, a, keys, time)).alias(f"_s{n}") for n, (b, a) in frames.items()],
    )
    first = smooth.withColumns({f"_f{n}": F.col(f"_s{n}") - F.lag(f"_s{n}").over(w) for n in frames})
    second = first.withColumns(
        {
            **{f"_g{n}": F.col(f"_f{n}") - F.lag(f"_f{n}").over(w) for n in frames},
            **{
                f"_p{n}": F.when(
                    (F.col(f"_s{n}") > F.lag(f"_s{n}").over(w)) & (F.col(f"_s{n}") > F.lead(f"_s{n}").over(w)),
                    F.lit(1),
                ).otherwise(F.lit(0))
                for n in frames
            },
        }
    )
    entry = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(n).cast("bigint").alias("n"),
                    F.col(f"_s{n}").alias("s"),
                    F.col(f"_g{n}").alias("g"),
                    F.col(f"_p{n}").alias("p"),
                )
                for n in frames
            ]
        )
    ).alias("_e")
    long = second.select(*keys, duration, entry).filter(F.col("_e.g").isNotNull())
    return long.groupBy(*keys, F.col("_e.n").alias("window_size"), duration).agg(
        F.round(F.stddev_samp("_e.g"), 4).alias("noise_level"),
        F.sum("_e.p").cast("bigint").alias("peak_count"),
        F.round(F.avg("_e.s"), 4).alias("avg_intensity"),
        F.round(
            F.try_divide(F.max("_e.n").cast("double"), F.max(duration).cast("double")) * 100, 2
        ).alias("temporal_precision_loss_pct"),
        (F.max("_e.n") == F.lit(recommended)).alias("is_recommended"),
    )


def noise_reduction(
    series: DataFrame, keys: list[str], time: str, dims: list[str], window: int = 10
) -> DataFrame:
    """Relative drop of the spread of absolute changes through smoothing, per key."""
    w = Window.partitionBy(*keys).orderBy(time)
    smooth = rolling_mean_window(series, keys, time, dims, window, "__s")
    steps = smooth.withColumns(
        {
            **{f"{d}__rd": F.abs(F.col(d) - F.lag(d).over(w)) for d in dims},
            **{f"{d}__sd": F.abs(F.col(f"{d}__s") - F.lag(f"{d}__s").over(w)) for d in dims},
        }
    )
    spread = steps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("data_points"),
        *[F.stddev_samp(f"{d}__rd").alias(f"{d}__r") for d in dims],
        *[F.stddev_samp(f"{d}__sd").alias(f"{d}__v") for d in dims],
    )
    cuts = F.array(
        *[
            F.when(F.col(f"{d}__r") > 0, (F.col(f"{d}__r") - F.col(f"{d}__v")) / F.nullif(F.col(f"{d}__r"), F.lit(0.0)) * 100)
            .otherwise(F.lit(0.0))
            for d in dims
        ]
    )
    volatility = F.array(*[F.col(f"{d}__v") for d in dims])

    def mean(values: Column) -> Column:
        present = F.filter(values, lambda x: x.isNotNull())
        return F.coalesce(
            F.try_divide(
                F.aggregate(present, F.lit(0.0), lambda a, x: a + x), F.size(present).cast("double")
            ),
            F.lit(0.0),
        )

    return spread.select(
        *keys,
        F.lit(window).cast("bigint").alias("window_size"),
        mean(cuts).alias("avg_noise_reduction_pct"),
        mean(volatility).alias("avg_volatility"),
        "data_points",
    )


def unpivot_dims(
    df: DataFrame, ids: list[str], dims: list[str], name: str = "dimension", value: str = "score",
    labels: list[str] | None = None,
) -> DataFrame:
    """Columns to rows in one pass over the input."""
    renamed = df
    if labels:
        renamed = df.withColumnsRenamed(dict(zip(dims, labels)))
        dims = labels
    return renamed.unpivot(ids, dims, name, value)


def peaks_per_dimension(
    series: DataFrame,
    keys: list[str],
    time: str,
    dims: list[str],
    k: int = 5,
    smooth: tuple[int, int] | None = None,
    keep: list[str] | None = None,
    labels: list[str] | None = None,
) -> DataFrame:
    """The k highest buckets of every key and dimension, optionally after smoothing.

    Ranks use the unrounded score and break ties by the earlier bucket.
    """
    source = rolling_mean(series, keys, time, dims, *smooth) if smooth else series
    keep = keep or []
    long = unpivot_dims(source, [*keys, time, *keep], dims, labels=labels)
    long = long.filter(F.col("score").isNotNull())
    ranked = top_k(long, [*keys, "dimension"], [F.col("score").desc(), F.col(time).asc()], k, "peak_rank")
    return ranked.select(
        text.composite_key(*keys, "dimension", time).alias("peak_id"),
        *keys,
        "dimension",
        time,
        *keep,
        F.round("score", 4).alias("intensity_score"),
        "peak_rank",
    )


def intensity_rank(
    series: DataFrame, keys: list[str], time: str, dims: list[str], count: str, k: int = 50
) -> DataFrame:
    """Buckets with lines, ranked by the sum of a few dimensions."""
    total = F.col(dims[0])
    for d in dims[1:]:
        total = total + F.col(d)
    scored = series.filter(F.col(count) > 0).withColumn("intensity", total)
    return top_k(scored, keys, [F.col("intensity").desc(), F.col(time).asc()], k)


def cluster_peaks(
    peaks: DataFrame,
    keys: list[str],
    time: str,
    score: str,
    gap: int = 5,
    chunk_width: int | None = None,
) -> DataFrame:
    """Merge neighbours at most ``gap`` apart into groups (gaps and islands).

    With ``chunk_width`` every key is split along the time axis, which keeps the
    result the same when a key has too many rows for one task.
    """
    if chunk_width:
        chunk = F.floor(F.col(time) / F.lit(chunk_width))
        before = chunked_previous(peaks, keys, [time], time, "_prev", chunk)
        fresh = (F.col("_prev").isNull() | (F.col(time) - F.col("_prev") > gap)).cast("bigint")
        # Rows that share a time never open a group twice: their distance is 0.
        marked = chunked_running_sum(before, keys, [time, score], fresh, "_island", chunk)
    else:
        w = Window.partitionBy(*keys).orderBy(time, score)
        before = peaks.withColumn("_prev", F.lag(time).over(w))
        fresh = (F.col("_prev").isNull() | (F.col(time) - F.col("_prev") > gap)).cast("bigint")
        marked = before.withColumn("_new", fresh).withColumn("_island", F.sum("_new").over(w))
    best = F.max_by(F.col(time), F.struct(F.col(score), (-F.col(time)).alias("t")))
    return (
        marked.groupBy(*keys, "_island")
        .agg(
            F.min(time).alias("start"),
            F.max(time).alias("end"),
            F.max(score).alias("intensity"),
            best.alias("center"),
            F.count(F.lit(1)).alias("members"),
        )
        .drop("_island")
    )


def context_window(peaks: DataFrame, keys: list[str], time: str, reach: int = 2) -> DataFrame:
    """Buckets around every peak, floored at 0, each once per key."""
    span = F.sequence(F.greatest(F.col(time) - reach, F.lit(0)), F.col(time) + reach)
    return peaks.select(*keys, F.explode(span).alias(time)).distinct()


def gaps(
    lines: DataFrame,
    keys: list[str],
    start: str,
    end: str,
    threshold: float = 120.0,
    chunk_width: float | None = None,
    tie: str | None = None,
) -> DataFrame:
    """Number and size of pauses between consecutive lines above a threshold."""
    order = [start] + ([tie] if tie else [end])
    if chunk_width:
        chunk = F.floor(F.col(start) / F.lit(chunk_width))
        paired = chunked_previous(lines, keys, order, end, "_prev_end", chunk)
    else:
        w = Window.partitionBy(*keys).orderBy(*order)
        paired = lines.withColumn("_prev_end", F.lag(end).over(w))
    pause = F.col(start) - F.col("_prev_end")
    big = F.when(pause > threshold, pause)
    return paired.groupBy(*keys).agg(
        F.count(big).alias("gap_count"), F.max(big).alias("largest_gap"), F.count(F.lit(1)).alias("line_count")
    )


def sequence_check(lines: DataFrame, keys: list[str], order: list[str], number: str) -> DataFrame:
    """Rows whose own number differs from their running number.

    The running number is one more than the number of earlier rows of the key.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return (
        lines.withColumn("expected_number", F.row_number().over(w).cast("bigint"))
        .filter(F.col(number) != F.col("expected_number"))
    )


def sequence_check_chunked(
    lines: DataFrame, keys: list[str], order: list[str], number: str, chunk: Column
) -> DataFrame:
    """The same check with every key split along its order."""
    counted = chunked_running_sum(lines, keys, order, F.lit(1).cast("bigint"), "expected_number", chunk)
    return counted.filter(F.col(number) != F.col("expected_number"))


def axis_extent(series: DataFrame, keys: list[str], time: str) -> DataFrame:
    """First and last bucket; a whole-table call on no rows gives (0, 0)."""
    grouped = series.groupBy(*keys) if keys else series.groupBy()
    return grouped.agg(
        F.coalesce(F.min(time), F.lit(0)).cast("bigint").alias("min_minute"),
        F.coalesce(F.max(time), F.lit(0)).cast("bigint").alias("max_minute"),
    )


def lines_of_peaks(
    peaks: DataFrame,
    lines: DataFrame,
    keys: list[str],
    time: str,
    start: str,
    width: int = 60,
) -> DataFrame:
    """Lines that start inside each peak's bucket (interval join as an equi-join)."""
    bucketed = lines.withColumn(time, text.minute_bucket(start, width))
    return peaks.join(bucketed, [*keys, time])


def nearest_lines(
    peaks: DataFrame,
    lines: DataFrame,
    keys: list[str],
    center: str,
    start: str,
    radius: float,
    k: int = 3,
    peak_id: list[str] | None = None,
    tie: str | None = None,
) -> DataFrame:
    """The k lines nearest to each peak within a radius.

    Time is cut into bins as wide as the radius; a peak looks into its own bin and
    both neighbours, so the range join is an equi-join on (key, bin). The top-k runs
    per task before its shuffle.
    """
    ident = peak_id or [*keys, center]
    binned = lines.withColumn("_bin", F.floor(F.col(start) / F.lit(radius)).cast("bigint"))
    home = F.floor(F.col(center) / F.lit(radius)).cast("bigint")
    spread = peaks.withColumn("_bin", F.explode(F.array(home - 1, home, home + 1)))
    near = (
        spread.join(binned, [*keys, "_bin"])
        .withColumn("distance", F.abs(F.col(start) - F.col(center)))
        .filter(F.col("distance") <= radius)
        .drop("_bin")
    )
    order = [F.col("distance").asc(), F.col(start).asc()] + ([F.col(tie).asc()] if tie else [])
    return top_k(near, ident, order, k)


def longest_lines(
    lines: DataFrame,
    keys: list[str],
    text_col: str,
    k: int = 3,
    limit: int = 80,
    order: str | None = None,
    buckets: DataFrame | None = None,
) -> DataFrame:
    """The k longest lines per key, cut with an ellipsis, as one array per key.

    ``buckets`` (the wanted keys) adds a placeholder for a key without any line.
    """
    filled = lines.filter(F.trim(F.col(text_col)) != "")
    by = [F.length(text_col).desc()] + ([F.col(order).asc()] if order else [F.col(text_col).asc()])
    best = top_k(filled, keys, by, k)
    packed = best.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("rank", text.truncate_text(text_col, limit).alias("line")))).alias("_l")
    )
    out = packed.select(*keys, F.transform("_l", lambda x: x["line"]).alias("excerpts"))
    if buckets is None:
        return out
    return buckets.select(*keys).distinct().join(out, keys, "left").withColumn(
        "excerpts", F.coalesce(F.col("excerpts"), F.array(F.lit("[No dialogue]")))
    )
