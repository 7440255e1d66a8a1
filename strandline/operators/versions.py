"""Two versions of a table compared by checksums of key ranges.

Both sides are summed up to (rows, checksum) for every leaf of a tree over the hashes of their keys:
a leaf is ``LEAF_BITS`` bits, an inner node fewer. The checksum of a node is the sum of its rows'
hashes, so it doesn't depend on their order and a parent's is the sum of its children's. Leaves that
agree on both sides are left alone; only rows of leaves that differ are shuffled and joined.

Stored sums (:func:`summed`) stand for a version that doesn't change any more, so comparing a new
version with it reads of the old one only the leaves that differ, when it is stored by leaves.
Two different leaves agree by chance with a probability of about 2**-64 each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from strandline.sources.writers import read_folders

LEAF_BITS = 12
LEVEL_BITS = 4


def leaf_of(keys: list[str], bits: int = LEAF_BITS) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*keys), 64 - bits).cast("int")


def row_hash(columns: list[str]) -> Column:
    """A number of a row's values; NULL differs from every value and moves between columns show."""
    return F.xxhash64(*[x for c in columns for x in (F.col(c), F.col(c).isNull())])


def summed(df: DataFrame, keys: list[str], columns: list[str] | None = None, bits: int = LEAF_BITS) -> DataFrame:
    """(leaf, rows, checksum) of the leaves that have rows; at most 2**bits rows, summed up before the shuffle."""
    values = columns or [c for c in df.columns if c not in keys]
    own = row_hash([*keys, *values]).cast("decimal(38,0)")
    return df.groupBy(leaf_of(keys, bits).alias("leaf")).agg(F.count(F.lit(1)).alias("rows"), F.sum(own).alias("checksum"))


def tree_levels(old: DataFrame, new: DataFrame, bits: int = LEAF_BITS, step: int = LEVEL_BITS) -> DataFrame:
    """(level, nodes, differing) from the root to the leaves, from the sums of both sides."""
    out = None
    for depth in range(0, bits + 1, step):
        def up(side: DataFrame, name: str) -> DataFrame:
            node = F.shiftright("leaf", bits - depth).alias("node")  # noqa: B023
            return side.groupBy(node).agg(F.sum("rows").alias(f"n_{name}"), F.sum("checksum").alias(f"c_{name}"))

        both = up(old, "a").join(up(new, "b"), "node", "full")
        same = F.col("n_a").eqNullSafe(F.col("n_b")) & F.col("c_a").eqNullSafe(F.col("c_b"))
        level = both.agg(F.count(F.lit(1)).alias("nodes"), F.count(F.when(~same, 1)).alias("differing")).select(F.lit(depth).alias("level"), "nodes", "differing")
        out = level if out is None else out.unionAll(level)
    return out


def differing_leaves(old: DataFrame, new: DataFrame) -> DataFrame:
    """(leaf) where the sums of both sides differ, or only one side has rows."""
    a = old.select("leaf", F.col("rows").alias("n_a"), F.col("checksum").alias("c_a"))
    b = new.select("leaf", F.col("rows").alias("n_b"), F.col("checksum").alias("c_b"))
    same = F.col("n_a").eqNullSafe(F.col("n_b")) & F.col("c_a").eqNullSafe(F.col("c_b"))
    return a.join(b, "leaf", "full").where(~same).select("leaf")


def compare_versions(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str] | None = None, bits: int = LEAF_BITS) -> DataFrame:
    """keys, ``change`` (added, removed, changed) and the names of the columns that differ, of every key that changed.

    Keys are unique on each side. Columns are those of both sides unless given. Rows of leaves that agree
    are dropped before the join, by a join with the list of differing leaves, which has 2**bits rows at most.
    """
    values = columns or [c for c in old.columns if c in new.columns and c not in keys]
    sums = [summed(side.select(*keys, *values), keys, values, bits) for side in (old, new)]
    leaves = F.broadcast(differing_leaves(*sums))

    def near(side: DataFrame, name: str) -> DataFrame:
        rows = side.select(*[F.col(k).alias(f"{name}{i}") for i, k in enumerate(keys)], F.struct(*values).alias(name), leaf_of(keys, bits).alias("leaf"))
        return rows.join(leaves, "leaf", "left_semi").drop("leaf")

    a, b = near(old, "_old"), near(new, "_new")
    on = reduce(Column.__and__, [F.col(f"_old{i}").eqNullSafe(F.col(f"_new{i}")) for i in range(len(keys))])
    both = a.join(b, on, "full")
    # a side without the row has no struct; its key may be NULL on the other
    both = both.select(*[F.when(F.col("_old").isNull(), F.col(f"_new{i}")).otherwise(F.col(f"_old{i}")).alias(k) for i, k in enumerate(keys)], "_old", "_new")
    differ = F.array_compact(F.array(*[F.when(~F.col("_old")[c].eqNullSafe(F.col("_new")[c]), F.lit(c)) for c in values]))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("changed")
    out = both.select(*keys, change.alias("change"), F.when(change == "changed", differ).otherwise(F.array().cast("array<string>")).alias("differing"))
    return out.where((F.col("change") != "changed") | (F.size("differing") > 0))


#: Bits of the leaf that name the folder of a stored version.
FOLDER_BITS = 8


def write_version(df: DataFrame, path: str, keys: list[str], bits: int = LEAF_BITS, folder_bits: int = FOLDER_BITS) -> None:
    """Store a version by folders of leaves, and its sums beside it below ``path`` + "-sums"."""
    placed = df.withColumn("node", F.shiftright(leaf_of(keys, bits), bits - folder_bits))
    placed.repartition("node").write.mode("overwrite").partitionBy("node").parquet(path)
    summed(df, keys, None, bits).coalesce(1).write.mode("overwrite").parquet(f"{path}-sums")


def compare_stored(old: str, new: str, schema: StructType, spark: SparkSession, keys: list[str], bits: int = LEAF_BITS, folder_bits: int = FOLDER_BITS) -> tuple[DataFrame, list[str]]:
    """:func:`compare_versions` of two stored versions, and the files it reads.

    The sums say which leaves differ; only their folders are listed and read, on both sides.
    """
    sums = [spark.read.schema("leaf int, rows bigint, checksum decimal(38,0)").parquet(f"{p}-sums") for p in (old, new)]
    nodes = [r["node"] for r in differing_leaves(*sums).select(F.shiftright("leaf", bits - folder_bits).alias("node")).distinct().collect()]
    whole = StructType([*schema.fields, StructField("node", IntegerType())])
    sides = [read_folders(spark, p, "node", nodes, whole) for p in (old, new)]
    files = [f for side in sides for f in side.inputFiles()]
    return compare_versions(*[side.drop("node") for side in sides], keys, [f.name for f in schema.fields if f.name not in keys], bits), files
