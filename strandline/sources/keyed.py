"""Stored tables split by key hash: a load meets only the folders of its own keys.

Rows lie in folders ``bucket=N`` by the hash of their key. A load reads the keys of the buckets that
its own rows fall into (partition pruning on the folder names) and appends what is new there, so
the files it reads grow with the buckets it touches, not with the table. A load that is repeated
after a failure finds the keys of whatever was committed and adds the rest: each key is stored once.

Keys may be NULL, and NULL equals NULL. Of rows of one load that share a key any one is kept.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from strandline.sources.writers import read_folders

BUCKETS = 256
BUCKET = "bucket"


@dataclass(frozen=True)
class Load:
    """What a load did: rows it brought with keys of their own, rows appended, and stored files it read keys of."""

    brought: int
    appended: int
    files_read: int


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _with_bucket(schema: StructType) -> StructType:
    return StructType([*[f for f in schema.fields if f.name != BUCKET], StructField(BUCKET, IntegerType())])


def keyed_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The stored rows with their bucket; no file is opened to find the schema."""
    return spark.read.schema(_with_bucket(schema)).parquet(path)


def load_keyed(df: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS) -> Load:
    """Append the rows whose key isn't stored yet. ``buckets`` must be the same for every load of a table."""
    spark = df.sparkSession
    if BUCKET in df.columns:
        raise ValueError(f"a column {BUCKET} would clash with the folders")
    fresh = df.dropDuplicates(keys).withColumn(BUCKET, bucket_of(keys, buckets)).persist()
    try:
        sizes = {r[BUCKET]: r["n"] for r in fresh.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("n")).collect()}
        if not sizes:
            return Load(0, 0, 0)
        near = read_folders(spark, path, BUCKET, sorted(sizes), _with_bucket(df.schema))
        files_read = len(near.inputFiles())
        a, b = fresh.alias("a"), near.select(*keys, BUCKET).alias("b")
        same = [F.col(f"a.{BUCKET}") == F.col(f"b.{BUCKET}"), *[F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`")) for k in keys]]
        new = a.join(b, reduce(Column.__and__, same), "left_anti") if files_read else fresh
        new = new.repartition(min(len(sizes), buckets), BUCKET).persist()
        try:
            appended = new.count()
            if appended:
                new.write.mode("append").partitionBy(BUCKET).parquet(path)
        finally:
            new.unpersist()
        return Load(sum(sizes.values()), appended, files_read)
    finally:
        fresh.unpersist()


def load_keyed_batches(stream: DataFrame, path: str, keys: list[str], state: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Load each micro-batch by :func:`load_keyed`; what each did lies beside the table, below ``path`` + "-loads"."""

    def load(batch: DataFrame, number: int) -> None:
        done = load_keyed(batch, path, keys, buckets)
        row = batch.sparkSession.createDataFrame(
            [(number, done.brought, done.appended, done.files_read)], "batch bigint, brought bigint, appended bigint, files_read bigint"
        )
        row.coalesce(1).write.mode("overwrite").parquet(f"{path}-loads/load={number}")

    return stream.writeStream.foreachBatch(load).option("checkpointLocation", state).trigger(availableNow=True).start()
