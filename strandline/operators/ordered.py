"""Ordered operators that stay exact when one key holds much of the data.

A plain window puts a whole key into one task. Where rows were first averaged into
time buckets that is fine, because a key then has at most one row per bucket. On raw
rows the operators here split each key into chunks that follow the order column,
work inside a chunk, and stitch neighbouring chunks through a summary with one row
per (key, chunk).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.session import cut_lineage, wide_enough


def _with_carry(marked: DataFrame, carry: DataFrame) -> DataFrame:
    """Add one carried row in front of every chunk but the first."""
    return marked.withColumn("_carry", F.lit(1)).unionByName(
        carry.withColumn("_carry", F.lit(0)), allowMissingColumns=True
    )


def chunked_previous(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    value: str,
    out: str,
    chunk: Column,
) -> DataFrame:
    """Value of the previous row of the key, across chunk borders.

    ``chunk`` must not decrease along the order columns. The last value of a chunk is
    carried in front of the key's next chunk, so the only window over a whole key
    sees one row per (key, chunk).
    """
    marked = df.withColumn("_chunk", chunk)
    tails = marked.groupBy(*keys, "_chunk").agg(
        F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_tail")
    )
    across = Window.partitionBy(*keys).orderBy("_chunk")
    carry = (
        tails.withColumn("_next", F.lead("_chunk").over(across))
        .filter(F.col("_next").isNotNull())
        .select(*keys, F.col("_next").alias("_chunk"), F.col("_tail.v").alias("_value"))
    )
    both = _with_carry(marked.withColumn("_value", F.col(value)), carry)
    inside = Window.partitionBy(*keys, "_chunk").orderBy("_carry", *order)
    return (
        both.withColumn(out, F.lag("_value").over(inside)).filter(F.col("_carry") == 1).select(*df.columns, out)
    )


def chunked_running_sum(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    value: Column,
    out: str,
    chunk: Column,
) -> DataFrame:
    """Running sum along the order, across chunk borders."""
    marked = df.withColumn("_chunk", chunk).withColumn("_value", value)
    totals = marked.groupBy(*keys, "_chunk").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        totals.withColumn("_value", F.sum("_sum").over(before))
        .filter(F.col("_value").isNotNull())
        .select(*keys, "_chunk", "_value")
    )
    both = _with_carry(marked, carry)
    inside = (
        Window.partitionBy(*keys, "_chunk")
        .orderBy("_carry", *order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return both.withColumn(out, F.sum("_value").over(inside)).filter(F.col("_carry") == 1).select(*df.columns, out)


def global_row_ids(df: DataFrame, order: list[str], out: str = "row_id", partitions: int | None = None) -> DataFrame:
    """1-based row numbers along a total order, without a single-partition window.

    Rows are range-partitioned and sorted; each row keeps its partition and its
    position there; the partition sizes (one row per partition) give the offsets. The
    numbered rows are checkpointed first, so both uses read the same placement even
    when a task is repeated on another executor.
    """
    parts = partitions or wide_enough(df)
    placed = cut_lineage(
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    split = placed.withColumn("_part", F.shiftright("_place", 33)).withColumn(
        "_pos", F.col("_place").bitwiseAND((1 << 33) - 1)
    )
    sizes = split.groupBy("_part").agg((F.max("_pos") + 1).alias("_size"))
    later = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(later), F.lit(0)).alias("_offset"))
    return (
        split.join(F.broadcast(offsets), "_part")
        .withColumn(out, (F.col("_offset") + F.col("_pos") + 1).cast("bigint"))
        .select(*df.columns, out)
    )


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """Best k rows per key.

    Catalyst limits every task to k rows per key before the shuffle, so a hot key
    sends at most k rows per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window).cast("bigint")).filter(F.col(rank) <= k)
