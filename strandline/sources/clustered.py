"""Marts clustered by an interleaved key, so that lookups read a few row groups.

Each clustering column is cut into ranges at boundaries from a bounded sample; the bits of the range
numbers are interleaved, and rows are dealt to files by ranges of that number and sorted within them.
So the statistics of a row group are narrow in every clustering column, not only in the first, and
a filter on any of them skips most groups. The sample decides the layout only, never the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE_ROWS = 20_000
BITS = 6
#: Names of the stored lower-case forms of text columns, which lookups compare.
FOLDED = "_key_"


def boundaries(df: DataFrame, columns: list[str], bits: int = BITS, sample_rows: int = SAMPLE_ROWS) -> dict[str, list]:
    """Up to 2**bits - 1 boundaries a column, from the rows whose hashes are lowest."""
    picked = df.select(*columns).orderBy(F.xxhash64(*columns)).limit(sample_rows).collect()
    out = {}
    for c in columns:
        values = sorted(r[c] for r in picked if r[c] is not None)
        cuts = [values[len(values) * k >> bits] for k in range(1, 1 << bits)] if values else []
        out[c] = sorted(set(cuts))
    return out


def interleaved(cuts: dict[str, list], bits: int = BITS) -> Column:
    """The bits of the columns' range numbers, in turn, highest first; NULL is in the lowest range."""
    ranges = []
    for c, edges in cuts.items():
        edge = F.array(*[F.lit(e) for e in edges]) if edges else F.array()
        below = F.size(F.filter(edge, lambda e: e <= F.col(c))) if edges else F.lit(0)  # noqa: B023
        ranges.append(F.greatest(below, F.lit(0)))
    key = F.lit(0)
    for bit in reversed(range(bits)):
        for r in ranges:
            key = key * 2 + F.shiftright(r, bit).bitwiseAND(1)
    return key


def write_clustered(df: DataFrame, path: str, columns: list[str], files: int = 8, group_bytes: int = 8 << 20, bits: int = BITS, page_rows: int = 20_000) -> None:
    """Write a mart clustered by ``columns``; text columns are stored in lower case too, for lookups.

    ``group_bytes`` and ``page_rows`` bound the row groups and pages, the units that a lookup can skip.
    """
    texts = [c for c in columns if dict(df.dtypes)[c] == "string"]
    keyed = df.withColumns({FOLDED + c: F.lower(c) for c in texts})
    by = [FOLDED + c if c in texts else c for c in columns]
    out = keyed.withColumn("_place", interleaved(boundaries(keyed, by, bits), bits))
    out = out.repartitionByRange(files, "_place", *by).sortWithinPartitions("_place", *by).drop("_place")
    out.write.mode("overwrite").option("parquet.block.size", group_bytes).option("parquet.page.row.count.limit", page_rows).parquet(path)


def clustered_lookup(spark: SparkSession, path: str, wanted: dict[str, object]) -> DataFrame:
    """The rows of one entity, without regard to case; comparisons are on stored columns and reach the scan."""
    mart = spark.read.parquet(path)
    out = mart
    for column, value in wanted.items():
        if value is None:
            continue
        folded = FOLDED + column in mart.columns and isinstance(value, str)
        out = out.where(F.col(FOLDED + column) == value.lower() if folded else F.col(column) == value)
    return out.select(*[c for c in mart.columns if not c.startswith(FOLDED)])


def rows_scanned(df: DataFrame) -> int:
    """Rows that the Parquet scans of a frame hand on when it is run: those of the pages not skipped."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    while "AdaptiveSparkPlan" in plan.nodeName():
        plan = plan.executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()) if "Scan" in leaves.apply(i).nodeName())
