"""Writers: idempotent loads, lookups, JSON, CSV and Parquet outputs, freshness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders right below a path; none if it doesn't exist. Nothing deeper is listed."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    disk = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in disk.listStatus(place) if s.isDirectory()) if disk.exists(place) else []


def read_folders(spark: SparkSession, path: str, column: str, values: list, schema: StructType) -> DataFrame:
    """The rows of the folders ``column=value`` for the given values; others aren't even listed."""
    wanted = {f"{column}={v}" for v in values}
    found = [f"{path}/{name}" for name in subfolders(spark, path) if name in wanted]
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(*found)


def load_idempotent(df: DataFrame, path: str, keys: list[str], partition_by: list[str] | None = None) -> None:
    """Append only the rows whose key is not stored yet; each key once."""
    fresh = df.dropDuplicates(keys)
    stored = _existing(df.sparkSession, path)
    if stored is not None:
        fresh = fresh.join(stored.select(*keys), keys, "left_anti")
    writer = fresh.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def load_replacing(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Replace exactly the partitions the new rows fall into."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .parquet(path)
    )


def update_from_lookup(df: DataFrame, lookup: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Overwrite columns with the lookup's values where the key is found.

    Columns that do not exist yet are added. Catalyst broadcasts the lookup when its
    size allows.
    """
    renamed = lookup.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_hit"))
    joined = df.join(renamed, keys, "left")
    for c in columns:
        old = F.col(c) if c in df.columns else F.lit(None)
        joined = joined.withColumn(c, F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(old))
    return joined.drop("_hit", *[f"_new_{c}" for c in columns])


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines with NULL members kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def materialise(df: DataFrame, name: str, kind: str = "view", path: str | None = None) -> DataFrame:
    """A mart as a stored table, as a view, or left inline."""
    if kind == "table":
        if path is None:
            raise ValueError("a table needs a path")
        df.write.mode("overwrite").parquet(path)
        stored = df.sparkSession.read.parquet(path)
        stored.createOrReplaceTempView(name)
        return stored
    if kind == "view":
        df.createOrReplaceTempView(name)
        return df
    if kind == "ephemeral":
        return df
    raise ValueError(f"unknown kind: {kind}")


def freshness(df: DataFrame, loaded_at: str, warn_hours: float = 48.0, now: str | None = None) -> DataFrame:
    """Age of the newest row in hours and whether that is too old."""
    clock = F.expr(f"TIMESTAMP_NTZ'{now}'") if now else F.current_timestamp().cast("timestamp_ntz")
    latest = F.max(F.col(loaded_at).cast("timestamp_ntz"))
    one = df.agg(latest.alias("latest"), clock.alias("now"))
    hours = F.expr("timestampdiff(SECOND, latest, now)") / 3600.0
    return one.select(
        F.round(hours, 4).alias("age_hours"),
        F.when(hours.isNull() | (hours > warn_hours), F.lit("WARN")).otherwise(F.lit("PASS")).alias("status"),
    )


def append_summary_row(df: DataFrame, key: str, summary: DataFrame, label: str = "_SUMMARY_") -> DataFrame:
    """The rows followed by one summary row that carries the summary's columns too."""
    return df.unionByName(summary.withColumn(key, F.lit(label)), allowMissingColumns=True)
