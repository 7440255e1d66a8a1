"""Streaming forms of batch operators; each equals its batch twin on the same rows.

State is bounded by the watermark: windows and sessions are dropped once it passes
them, and remembered keys expire with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandline.session import scratch_path


def stream_minute_aggregate(
    lines: DataFrame, keys: list[str], ts: str, dims: list[str], width: str = "1 minute", delay: str = "10 minutes"
) -> DataFrame:
    """Mean of every dimension and line count per key and window."""
    return (
        lines.withWatermark(ts, delay)
        .groupBy(*keys, F.window(ts, width).alias("_w"))
        .agg(F.count(F.lit(1)).alias("dialogue_count"), *[F.avg(F.coalesce(F.col(d), F.lit(0.0))).alias(d) for d in dims])
        .withColumn("bucket_start", F.col("_w.start"))
        .drop("_w")
    )


def stream_idempotent(rows: DataFrame, keys: list[str], ts: str, delay: str = "10 minutes") -> DataFrame:
    """Each key once, as long as its copies arrive within the delay."""
    return rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def stream_sessions(
    rows: DataFrame, keys: list[str], ts: str, score: str, gap: str = "5 minutes", delay: str = "10 minutes"
) -> DataFrame:
    """Groups of rows less than a gap apart: first and last time, best score, size."""
    return (
        rows.withWatermark(ts, delay)
        .groupBy(*keys, F.session_window(ts, gap).alias("_s"))
        .agg(
            F.min(ts).alias("start"),
            F.max(ts).alias("end"),
            F.max(score).alias("intensity"),
            F.count(F.lit(1)).alias("members"),
        )
        .drop("_s")
    )


def stream_quality_gate(rows: DataFrame, bad: Column, path: str, state: str) -> StreamingQuery:
    """Append every row below ``path`` under side=good or side=quarantine; NULL counts as bad.

    One pass over the source: each micro-batch is written once, split by side, into a
    folder of its own that a repeated batch replaces.
    """
    side = F.when(F.coalesce(bad, F.lit(True)), F.lit("quarantine")).otherwise(F.lit("good"))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy("side").parquet(f"{path}/batch={number}")

    return (
        rows.withColumn("side", side)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )


def staged_arrivals(rows: DataFrame, part: Column, parts: list, closing: DataFrame | None, name: str, files: int | None = None) -> str:
    """Write a table as files that arrive one part after the other, and return their folder.

    With ``files`` each part comes in that many files, or fewer where it has fewer rows.

    ``closing`` is a last arrival far in the future: it moves the watermark past every open
    window and session, so that an ended input gives complete results.
    """
    path = scratch_path(rows.sparkSession, name)
    for value in parts:
        arriving = rows.filter(part == value)
        (arriving if files is None else arriving.repartition(files)).write.mode("append").parquet(path)
    if closing is not None:
        closing.write.mode("append").parquet(path)
    return path


def run_to_parquet(stream: DataFrame, name: str, timeout: int | None = None) -> str:
    """Run a stream over everything available into a fresh folder and return its path.

    Sink and checkpoint live in the cluster's shared folder, so a restarted query
    continues where it stopped and the file sink commits every batch once.
    """
    spark = stream.sparkSession
    out, state = scratch_path(spark, name), scratch_path(spark, name + "-state")
    query: StreamingQuery = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", state)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    finished = query.awaitTermination(timeout) if timeout else query.awaitTermination()
    if finished is False:
        query.stop()
        raise TimeoutError(f"stream {name} did not finish in {timeout} s")
    if query.exception() is not None:
        raise query.exception()
    return out


def load_batches(stream: DataFrame, path: str, keys: list[str], state: str) -> StreamingQuery:
    """Append each micro-batch's unseen keys to a stored table (idempotent on retries)."""
    from strandline.sources.writers import load_idempotent

    return (
        stream.writeStream.foreachBatch(lambda df, _: load_idempotent(df, path, keys))
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
