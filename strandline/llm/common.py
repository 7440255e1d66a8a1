"""Helpers shared by the pipeline operators: column checks, free names, stored intermediate tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.session import scratch_path

#: White space of the word contracts: blank, tab, newline, vertical tab, form feed, return.
SPACE = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, each lengthened until no column of the frame has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """A column by its literal name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words_of(text: Column, space: str = SPACE) -> Column:
    """The non-empty pieces between runs of white space; none for NULL."""
    pieces = F.split(F.coalesce(text, F.lit("")), space + "+")
    return F.filter(pieces, lambda w: w != "")


def stored(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write a frame below the shared folder and read it again.

    The copy is readable by every executor, so the work behind it isn't repeated when
    an executor is lost, and its size is known to the planner. It stays until it is released.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    _stored.add(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


#: Folders written by stored() and not released yet.
_stored: set[str] = set()


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    _stored.discard(path)


def release(*frames: DataFrame) -> None:
    """Delete stored copies that no frame still to be worked out reads."""
    for frame in frames:
        _delete(frame.sparkSession, frame.stored_at)


def stored_paths() -> set[str]:
    """Folders of the copies that this process has stored and not released."""
    return set(_stored)


def release_paths(spark: SparkSession, paths: set[str]) -> None:
    for path in paths & _stored:
        _delete(spark, path)
