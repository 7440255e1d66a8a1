"""The shared tables in the shapes the operators expect, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import series
from strandline.session import plan_bytes


TEXT_TABLES = {"documents", "pages"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def spread(df: DataFrame, bytes_per_core: int = 32 << 20) -> DataFrame:
    """Share a small input of few files among all cores before costly text work.

    A Parquet file of one row group is one task however long its texts are. Only an
    input with fewer files than cores and less than ``bytes_per_core`` for each of
    them is repartitioned; a large one is left to its own splits.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) < cores and plan_bytes(df) < cores * bytes_per_core:
        return df.repartition(cores)
    return df


EVENT_DIMS = ["click", "error", "purchase", "signup", "view"]
EVENT_WIDTH = 3600


def seconds_since(column: str, base: str) -> F.Column:
    """Whole seconds since a fixed instant, whatever the session time zone."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'{base} 00:00:00', cast({column} as timestamp_ntz))")


def event_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Events as timed lines with one score per event type."""
    return table(spark, folder, "events").select(
        "event_id",
        "user_id",
        "event_type",
        "value",
        seconds_since("ts", "2024-01-01").alias("seconds"),
        *[
            F.when(F.col("event_type") == d, F.col("value") / 997.0).otherwise(F.lit(0.0)).alias(d)
            for d in EVENT_DIMS
        ],
    )


def event_series(spark: SparkSession, folder: str, width: int = EVENT_WIDTH) -> DataFrame:
    return series.minute_aggregate(event_lines(spark, folder), ["user_id"], "seconds", EVENT_DIMS, width)


SQL_EVENT_LINES = """event_lines AS (
  SELECT event_id, user_id, event_type, value,
         date_diff('second', TIMESTAMP '2024-01-01', ts) AS seconds,
         """ + ",\n         ".join(
    f"CASE WHEN event_type = '{d}' THEN value / 997.0 ELSE 0.0 END AS \"{d}\"" for d in EVENT_DIMS
) + """
  FROM events)"""
SQL_EVENT_SERIES = SQL_EVENT_LINES + """,
event_series AS (
  SELECT user_id, CAST(floor(seconds / 3600) AS BIGINT) AS minute_offset, count(*) AS dialogue_count,
         """ + ", ".join(f'avg("{d}") AS "{d}"' for d in EVENT_DIMS) + """
  FROM event_lines GROUP BY ALL)"""

SHIP_DIMS = ["qty", "price", "disc", "tax", "net"]
SHIP_KEYS = ["nation", "flag"]
SHIP_POSITIVE = ["qty", "price", "net"]
SHIP_NEGATIVE = ["disc", "tax"]


def ship_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as scored rows of the supplier's nation and the return flag."""
    lineitem = table(spark, folder, "lineitem")
    supplier = table(spark, folder, "supplier")
    nation = table(spark, folder, "nation")
    return (
        lineitem.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("n_name").alias("nation"),
            F.col("l_returnflag").alias("flag"),
            F.floor(
                F.expr("timestampdiff(DAY, TIMESTAMP_NTZ'1990-01-01 00:00:00', cast(l_shipdate as timestamp_ntz))") / 7
            )
            .cast("bigint")
            .alias("week"),
            "l_orderkey",
            "l_suppkey",
            "l_partkey",
            (F.col("l_quantity") / 53.0).alias("qty"),
            (F.col("l_extendedprice") / 104999.0).alias("price"),
            (F.col("l_discount") / 0.13).alias("disc"),
            (F.col("l_tax") / 0.11).alias("tax"),
            (F.col("l_extendedprice") * (1.0 - F.col("l_discount")) / 104999.0).alias("net"),
        )
    )


def ship_series(spark: SparkSession, folder: str) -> DataFrame:
    """One row per nation, flag and week."""
    return (
        ship_lines(spark, folder)
        .groupBy("nation", "flag", "week")
        .agg(F.count(F.lit(1)).alias("lines"), *[F.avg(d).alias(d) for d in SHIP_DIMS])
    )


SQL_SHIP_LINES = """ship_lines AS (
  SELECT n_name AS nation, l_returnflag AS flag,
         CAST(floor(date_diff('day', TIMESTAMP '1990-01-01', l_shipdate) / 7) AS BIGINT) AS week,
         l_orderkey, l_suppkey, l_partkey,
         l_quantity / 53.0 AS qty, l_extendedprice / 104999.0 AS price, l_discount / 0.13 AS disc,
         l_tax / 0.11 AS tax, l_extendedprice * (1.0 - l_discount) / 104999.0 AS net
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""
SQL_SHIP_SERIES = SQL_SHIP_LINES + """,
ship_series AS (
  SELECT nation, flag, week, count(*) AS lines, avg(qty) AS qty, avg(price) AS price, avg(disc) AS disc,
         avg(tax) AS tax, avg(net) AS net
  FROM ship_lines GROUP BY ALL)"""


def rounded(df: DataFrame, cols: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in cols})


def sql_rounded(cols: list[str], digits: int = 6) -> str:
    return ", ".join(f'round("{c}", {digits}) AS "{c}"' for c in cols)
