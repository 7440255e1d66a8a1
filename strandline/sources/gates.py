"""Quality gates that count in the pass that writes.

The row rules of a load are observed metrics of the write itself: the table is scanned once, the
figures are there when the files are, and the files are then kept or withdrawn. The observed node
stands directly before the write, in its last stage, so a repeated task of an earlier stage counts
nothing twice.

A load is written aside, in a folder that readers skip, and moved to ``load=<id>`` below the table's
path when its rules hold; a repeated load of one id replaces the earlier one.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandline.operators.quality import failing


@dataclass(frozen=True)
class Verdict:
    """Rows seen, failures of each rule, and whether the load was kept."""

    total: int
    failures: dict[str, int]
    kept: bool

    def rows(self, spark: SparkSession, load: int | str) -> DataFrame:
        figures = [(str(load), name, n, self.total, self.kept) for name, n in self.failures.items()]
        return spark.createDataFrame(figures, "load string, rule string, failures bigint, total bigint, kept boolean")


def _fs(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _move(spark: SparkSession, source: str, target: str) -> None:
    a, disk = _fs(spark, source)
    z, _ = _fs(spark, target)
    disk.delete(z, True)
    disk.mkdirs(z.getParent())
    if not disk.rename(a, z):
        raise OSError(f"{source} couldn't be moved to {target}")


def watched(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, Observation]:
    """The rows with the number of rows and of failures of each rule as observed metrics."""
    seen = Observation(f"rules-{uuid.uuid4().hex}")
    counts = [F.count(F.when(bad, 1)).alias(f"r{k}") for k, bad in enumerate(rules.values())]
    return df.observe(seen, F.count(F.lit(1)).alias("total"), *counts), seen


def gated_write(df: DataFrame, path: str, rules: list[dict], load: int | str = 0, most: dict[str, int] | None = None) -> Verdict:
    """Write a load and keep it if no rule fails on more rows than ``most`` allows (none by default).

    ``rules`` are the row rules of :func:`strandline.operators.quality.rule_failures`; rules over several
    rows (unique, relationship) can't be counted row by row and are refused.
    """
    spark, most = df.sparkSession, most or {}
    conditions = {}
    for rule in rules:
        bad = failing(rule)
        if bad is None:
            raise ValueError(f"rule {rule['name']} looks at several rows and needs a pass of its own")
        conditions[rule["name"]] = bad
    rows, seen = watched(df, conditions)
    aside = f"{path}/_aside-{uuid.uuid4().hex}"
    try:
        rows.write.parquet(aside)
        got = seen.get
        failures = {name: got[f"r{k}"] for k, name in enumerate(conditions)}
        kept = all(n <= most.get(name, 0) for name, n in failures.items())
        if kept:
            _move(spark, aside, f"{path}/load={load}")
        return Verdict(got["total"], failures, kept)
    finally:
        place, disk = _fs(spark, aside)
        disk.delete(place, True)


def stream_gated_write(stream: DataFrame, path: str, rules: list[dict], state: str, most: dict[str, int] | None = None) -> StreamingQuery:
    """Gate every micro-batch by itself; the verdicts lie below ``path`` + "-verdicts", one folder a batch."""

    def write(batch: DataFrame, number: int) -> None:
        verdict = gated_write(batch, path, rules, number, most)
        verdict.rows(batch.sparkSession, number).coalesce(1).write.mode("overwrite").parquet(f"{path}-verdicts/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
