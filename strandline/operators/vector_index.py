"""Inverted vector index, and exact nearest neighbours under the triangle inequality.

Coarse centroids come from k-means over a bounded sample; every row is assigned to its nearest one.
Angles on the unit sphere obey the triangle inequality, so a cell with centroid c and covering angle r
holds no vector more similar to q than cos(max(0, angle(q, c) - r)). That bound tells which cells (or
pairs of cells) can still reach a k-th score.

Bounds: ``sample_rows`` rows are fitted, ``MOST_CELLS`` centroids at most travel to the tasks, and a cell of
more than ``block_rows`` rows is dealt into parts of about that size, as are the queries that meet it.

NULL vectors are not indexed and not searched. Vectors of length zero have similarity 0 to everything,
as in :func:`strandline.functions.vectors.cosine`; they lie in a cell of their own, ``NO_DIRECTION``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strandline.operators.ordered import top_k
from strandline.operators.similarity import _tile
from strandline.session import scratch_path
from strandline.sources.writers import read_folders

SAMPLE_ROWS = 20_000
MOST_CELLS = 1024
NO_DIRECTION = -1
#: Rows of a group that lie in one cell on average.
CELL_ROWS = 512
#: Above the rounding of angles in doubles.
SLACK = 1e-7


def units(lists: pa.ListArray | pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows of an Arrow column, and which rows have a direction; a wrong width is an error."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    if lists.null_count or (sizes != width).any():
        raise ValueError(f"vectors of one width, {width}, are expected")
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    length = np.sqrt((x * x).sum(axis=1))
    return np.divide(x, length[:, None], out=np.zeros_like(x), where=length[:, None] > 0), length > 0


def fitted(corpus: DataFrame, ident: str, vector: str, cells: int, sample_rows: int = SAMPLE_ROWS, rounds: int = 10) -> np.ndarray:
    """Unit centroids of a spherical k-means over the ``sample_rows`` rows whose hashed ids are lowest."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = corpus.where(F.col(vector).isNotNull()).select(F.xxhash64(ident).alias("_h"), F.col(vector).cast("array<double>").alias("_v"))
    rows = rows.withColumn("_n", F.sqrt(F.aggregate("_v", F.lit(0.0), lambda s, x: s + x * x)))
    sample = rows.where("_n > 0").orderBy("_h").limit(sample_rows)
    unit = sample.select(array_to_vector(F.transform("_v", lambda x: x / F.col("_n"))).alias("features"))
    unit = unit.persist()
    try:
        if not unit.limit(1).count():
            return np.empty((0, 0))
        model = KMeans(k=max(cells, 2), maxIter=rounds, seed=17, distanceMeasure="cosine", initSteps=2).fit(unit)
        found = np.array(model.clusterCenters())[: max(cells, 1)]
    finally:
        unit.unpersist()
    return found / np.sqrt((found * found).sum(axis=1))[:, None]


def assigned(corpus: DataFrame, ident: str, vector: str, centroids: np.ndarray, keep: list[str] | None = None) -> DataFrame:
    """The kept columns, id and vector of every row with its cell and its angle to the centroid."""
    keep = [c for c in (keep or []) if c not in (ident, vector)]
    frame = corpus.where(F.col(vector).isNotNull()).select(*keep, ident, F.col(vector).cast("array<double>").alias(vector))
    shipped = corpus.sparkSession.sparkContext.broadcast(centroids)
    names = frame.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shipped.value
        for batch in batches:
            if not centres.size:
                cell, angle = np.full(batch.num_rows, NO_DIRECTION, np.int32), np.zeros(batch.num_rows)
            else:
                x, directed = units(batch.column(len(names) - 1), centres.shape[1])
                cosines = x @ centres.T
                best = cosines.argmax(axis=1)
                cell = np.where(directed, best, NO_DIRECTION).astype(np.int32)
                angle = np.arccos(np.clip(cosines[np.arange(best.size), best], -1.0, 1.0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(angle)], names=[*names, "cell", "angle"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields)
    return frame.mapInArrow(run, f"{fields}, cell int, angle double")


@dataclass(frozen=True)
class VectorIndex:
    """An index on disk: folders ``cell=N`` below ``path``, and what the driver knows of the cells."""

    path: str
    ident: str
    id_type: str
    centroids: np.ndarray
    #: cell -> (rows, covering angle, parts)
    cells: dict[int, tuple[int, float, int]]
    probes: int

    def rows(self, spark: SparkSession, cells: list[int] | None = None) -> DataFrame:
        """(id, vec, part, cell); only the folders of the given cells are listed and read."""
        schema = StructType.fromDDL(f"id {self.id_type}, vec array<double>, part int, cell int")
        return read_folders(spark, self.path, "cell", sorted(self.cells) if cells is None else cells, schema)


def probes_for(sample: np.ndarray, centroids: np.ndarray, k: int, target: float, queries: int = 256) -> int:
    """The fewest cells to probe at which the sample's own neighbours are found with the recall wanted."""
    if len(sample) <= k or len(centroids) < 2:
        return max(len(centroids), 1)
    ask = sample[: min(queries, len(sample))]
    scores = ask @ sample.T
    scores[np.arange(len(ask)), np.arange(len(ask))] = -np.inf
    near = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    home = (sample @ centroids.T).argmax(axis=1)
    place = np.argsort(np.argsort(-(ask @ centroids.T), axis=1), axis=1)
    needed = np.sort(np.take_along_axis(place, home[near], axis=1).ravel()) + 1
    return int(needed[min(int(np.ceil(target * needed.size)), needed.size) - 1])


def build_index(
    corpus: DataFrame, ident: str, vector: str, *, path: str | None = None, cells: int | None = None,
    sample_rows: int = SAMPLE_ROWS, block_rows: int = 4096, k: int = 5, target: float = 0.95,
) -> VectorIndex:
    """Fit, assign and write all rows below ``path``, one folder a cell.

    Without ``cells`` there are about sqrt(rows), ``MOST_CELLS`` at most. The number of cells to probe is the
    fewest that reach ``target`` recall at ``k`` within the sample, so it follows the data.
    """
    spark = corpus.sparkSession
    plain = corpus.select(F.col(ident).alias("id"), F.col(vector).cast("array<double>").alias("vec"))
    total = plain.where("vec IS NOT NULL").count()
    cells = min(cells or max(1, round(total**0.5)), MOST_CELLS)
    centroids = fitted(plain, "id", "vec", cells, sample_rows)
    placed_at = scratch_path(spark, "assigned-vectors")
    assigned(plain, "id", "vec", centroids).write.parquet(placed_at)
    placed = spark.read.parquet(placed_at)
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("r")).collect()
    known = {r["cell"]: (r["n"], r["r"] + SLACK, max(1, -(-r["n"] // block_rows))) for r in sizes}
    path = path or scratch_path(spark, "vector-index")
    if known:
        parts = F.element_at(F.create_map(*[F.lit(v) for c, (_, _, p) in known.items() for v in (c, p)]), F.col("cell"))
        dealt = placed.withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int")).select("id", "vec", "part", "cell")
        dealt.repartition("cell", "part").sortWithinPartitions("cell", "part").write.partitionBy("cell").parquet(path)
    probes = 1
    if centroids.size:
        low = placed.where(F.col("cell") != NO_DIRECTION).orderBy(F.xxhash64("id")).limit(min(sample_rows, 4096)).select("vec")
        near = np.array([r["vec"] for r in low.collect()], np.float64)
        probes = probes_for(near / np.sqrt((near * near).sum(axis=1))[:, None], centroids, k, target)
    return VectorIndex(path, ident, dict(plain.dtypes)["id"], centroids, known, probes)


def _bounds(q: np.ndarray, index: VectorIndex) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Cells, the cosines to their centroids and the greatest scores they allow; 0 without a direction."""
    cells = sorted(index.cells)
    own = [c for c in cells if c != NO_DIRECTION]
    cosines = np.full((len(q), len(cells)), -np.inf)
    most = np.zeros((len(q), len(cells)))
    if own:
        at = [cells.index(c) for c in own]
        cosines[:, at] = q @ index.centroids[own].T
        radius = np.array([index.cells[c][1] for c in own])
        most[:, at] = np.cos(np.maximum(np.arccos(np.clip(cosines[:, at], -1, 1)) - radius, 0.0)) + SLACK
    return cells, cosines, most


def _visits(queries: DataFrame, index: VectorIndex, probes: int, further: bool) -> DataFrame:
    """(query, vec, kth, cell, part) of the cells to probe; ``further``: of the others that can still reach kth."""
    shipped = queries.sparkSession.sparkContext.broadcast(index)
    kind = dict(queries.dtypes)["query"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shipped.value
        for batch in batches:
            q, _ = units(batch.column(1), index.centroids.shape[1]) if index.centroids.size else (np.zeros((batch.num_rows, 1)), None)
            cells, cosines, most = _bounds(q, index)
            place = np.argsort(np.argsort(-cosines, axis=1, kind="stable"), axis=1)
            wanted = place < probes
            if further:
                kth = batch.column(2).to_numpy(zero_copy_only=False)
                wanted = ~wanted & (most >= kth[:, None])
            i, j = np.nonzero(wanted)
            out = batch.take(pa.array(i))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.array(cells, np.int32)[j])], names=["query", "vec", "kth", "cell"])

    visits = queries.mapInArrow(run, f"query {kind}, vec array<double>, kth double, cell int")
    parts = F.element_at(F.create_map(*[F.lit(v) for c, (_, _, p) in index.cells.items() for v in (c, p)]), F.col("cell"))
    return visits.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))


def _probed(visits: DataFrame, index: VectorIndex, crowds: int, k: int, min_score: float | None) -> DataFrame:
    """(query, match, score) of the best k a visited part."""
    spark = visits.sparkSession
    at = scratch_path(spark, "index-visits")
    visits.withColumn("crowd", F.pmod(F.xxhash64("query"), F.lit(crowds)).cast("int")).write.parquet(at)
    visits = spark.read.parquet(at)
    kinds = dict(visits.dtypes)
    compare, _, schema = _tile(index.id_type, "int", "cosine", k, False, min_score)
    schema = schema.replace("id_a " + index.id_type, "id_a " + kinds["query"])
    met = visits.select(F.col("cell").alias("c"), F.col("part").alias("p"), F.col("crowd").alias("w")).distinct()
    cells = [r["c"] for r in met.select("c").distinct().collect()]
    data = index.rows(spark, cells).join(met, (F.col("cell") == F.col("c")) & (F.col("part") == F.col("p")))
    data = data.select("c", "p", "w", F.lit(0).alias("g"), "id", "vec")
    ask = visits.select("cell", "part", "crowd", F.lit(0).alias("g"), F.col("query").alias("id"), "vec")

    def tile(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return compare(left, right)

    found = ask.groupBy("cell", "part", "crowd").cogroup(data.groupBy("c", "p", "w")).applyInPandas(tile, schema)
    return found.select(F.col("id_a").alias("query"), F.col("id_b").alias("match"), "score")


def knn_indexed(
    index: VectorIndex, queries: DataFrame, query_id: str, query_vector: str, *, k: int = 5,
    min_score: float | None = None, probes: int | None = None, exact: bool = False, crowd_rows: int = 4096,
) -> DataFrame:
    """query, match, score, rank of the k most similar rows among the probed cells.

    ``exact`` goes on to every cell whose bound reaches the query's k-th score, so the result equals
    :func:`strandline.operators.similarity.knn_search` whatever the number of probes.
    """
    spark = queries.sparkSession
    least = -2.0 if min_score is None else float(min_score)
    ask = queries.where(F.col(query_vector).isNotNull()).select(
        F.col(query_id).alias("query"), F.col(query_vector).cast("array<double>").alias("vec"), F.lit(least).alias("kth")
    )
    if not index.cells:
        return ask.select("query", F.lit(None).cast(index.id_type).alias("match"), F.lit(None).cast("double").alias("score"), F.lit(1).alias("rank")).where("false")
    crowds = max(1, -(-ask.count() // crowd_rows))
    probes = index.probes if probes is None else probes
    order = [F.col("score").desc(), F.col("match").asc()]
    best = top_k(_probed(_visits(ask, index, probes, False), index, crowds, k, min_score), ["query"], order, k)
    if not exact:
        return best
    at = scratch_path(spark, "index-finds")
    best.write.parquet(at)
    best = spark.read.parquet(at)
    kth = best.where(F.col("rank") == k).select("query", F.col("score").alias("_kth"))
    open_ = ask.join(kth, "query", "left").select("query", "vec", F.coalesce("_kth", "kth").alias("kth"))
    more = _probed(_visits(open_, index, probes, True), index, crowds, k, min_score)
    return top_k(best.select("query", "match", "score").unionAll(more), ["query"], order, k)


def index_recall(index: VectorIndex, found: DataFrame, exact: DataFrame) -> DataFrame:
    """Recall of the found rows, cells, cells probed a query and the share of all rows that a query meets on average."""
    total = sum(n for n, _, _ in index.cells.values()) or 1
    marked = exact.select("query", "match").join(found.select("query", "match", F.lit(1).alias("_hit")), ["query", "match"], "left")
    return marked.agg(F.avg(F.coalesce("_hit", F.lit(0))).alias("recall"), F.count(F.lit(1)).alias("wanted")).select(
        "recall", "wanted", F.lit(total).cast("bigint").alias("indexed"), F.lit(len(index.cells)).alias("cells"), F.lit(index.probes).alias("probes")
    )


# --- exact top k within groups -------------------------------------------------------------


def _blocks(df: DataFrame, ident: str, group: str, vector: str, cells: int, block_rows: int, sample_rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows (g, id, vec, block) stored by blocks, and the blocks (g, block, cell, radius)."""
    spark = df.sparkSession
    centroids = fitted(df, ident, vector, min(cells, MOST_CELLS), sample_rows)
    at = scratch_path(spark, "clustered-vectors")
    assigned(df, ident, vector, centroids, [group]).write.parquet(at)
    placed = spark.read.parquet(at).select(F.col(group).alias("g"), F.col(ident).alias("id"), F.col(vector).alias("vec"), "cell", "angle")
    sizes = placed.groupBy("g", "cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias("parts"), F.max("angle").alias("radius"))
    rows = placed.select("g", "cell", "id", "vec").join(sizes.select("g", "cell", "parts"), ["g", "cell"])
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    rows = rows.withColumn("block", F.xxhash64("cell", "part"))
    blocks = sizes.select("g", "cell", "radius", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).withColumn("block", F.xxhash64("cell", "part"))
    centre = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centroids]) if centroids.size else F.array(F.array(F.lit(0.0)))
    return rows.select("g", "id", "vec", "block"), blocks.withColumn("centre", F.get(centre, F.col("cell"))).select("g", "block", "cell", "radius", "centre")


def _cell_tiles(rows: DataFrame, tiles: DataFrame, compare, schema: str) -> DataFrame:
    """The directed tiles (g, block, other): rows of ``block`` against those of ``other``."""
    left = rows.join(tiles, ["g", "block"]).select("g", "block", "other", "id", "vec")
    right = rows.select(F.col("g").alias("h"), F.col("id").alias("id"), F.col("vec").alias("vec"), F.col("block").alias("o"))
    t = tiles.select(F.col("g").alias("h"), F.col("block").alias("b"), F.col("other").alias("o"))
    right = right.join(t, ["h", "o"]).select("h", "b", "o", F.col("h").alias("g"), "id", "vec")
    return left.groupBy("g", "block", "other").cogroup(right.groupBy("h", "b", "o")).applyInPandas(compare, schema)


def cosine_topk_pruned(
    df: DataFrame, ident: str, group: str, vector: str, k: int = 10, *, cells: int | None = None, block_rows: int = 2048, sample_rows: int = SAMPLE_ROWS
) -> tuple[DataFrame, DataFrame]:
    """(the k most similar other vectors of the same group, exact; tiles as (group, tiles, compared)).

    Blocks are the cells of a group. Each is first compared with itself; then only with blocks that, by the
    triangle inequality over both centroids and covering angles, can reach the lowest k-th score of its
    rows. Without ``cells`` the groups have about ``CELL_ROWS`` rows a cell on average. Rows without a
    group take no part.
    """
    spark, kinds = df.sparkSession, dict(df.dtypes)
    df = df.where(F.col(group).isNotNull() & F.col(vector).isNotNull())
    if cells is None:
        total, groups = df.agg(F.count(F.lit(1)), F.approx_count_distinct(group)).first()
        cells = max(1, round(total / max(groups, 1) / CELL_ROWS))
    rows, blocks = _blocks(df, ident, group, vector, cells, block_rows, sample_rows)
    compare, _, schema = _tile(kinds[ident], kinds[group], "cosine", k, True, None)
    order = [F.col("score").desc(), F.col("id_b").asc()]
    own = blocks.select("g", "block", F.col("block").alias("other"))
    at = scratch_path(spark, "home-tiles")
    top_k(_cell_tiles(rows, own, compare, schema), ["g", "id_a"], order, k).write.parquet(at)
    home = spark.read.parquet(at)
    kth = home.where(F.col("rank") == k).select(F.col("g"), F.col("id_a").alias("id"), "score")
    lowest = rows.select("g", "id", "block").join(kth, ["g", "id"], "left").groupBy("g", "block").agg(F.min(F.coalesce("score", F.lit(-2.0))).alias("least"))
    a = blocks.join(lowest, ["g", "block"])
    b = blocks.select("g", F.col("block").alias("other"), F.col("cell").alias("cell_b"), F.col("radius").alias("radius_b"), F.col("centre").alias("centre_b"))
    cosine = F.aggregate(F.zip_with("centre", "centre_b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    angle = F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0)))
    bound = F.cos(F.greatest(angle - F.col("radius") - F.col("radius_b") - 2 * SLACK, F.lit(0.0))) + SLACK
    bound = F.when((F.col("cell") == NO_DIRECTION) | (F.col("cell_b") == NO_DIRECTION), F.lit(0.0)).otherwise(bound)
    pairs = a.join(b, "g").select("g", "block", "other", (bound >= F.col("least")).alias("needed"))
    at = scratch_path(spark, "tile-bounds")
    pairs.where("block <> other").write.parquet(at)
    pairs = spark.read.parquet(at)
    further = _cell_tiles(rows, pairs.where("needed").select("g", "block", "other"), compare, schema)
    found = top_k(home.select("g", "id_a", "id_b", "score").unionAll(further), ["g", "id_a"], order, k)
    counts = own.select("g", F.lit(True).alias("needed")).unionAll(pairs.select("g", "needed"))
    tiles = counts.groupBy("g").agg(F.count(F.lit(1)).alias("tiles"), F.count(F.when(F.col("needed"), 1)).alias("compared"))
    return found.withColumnRenamed("g", group), tiles.withColumnRenamed("g", group)
