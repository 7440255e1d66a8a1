"""Vector search and comparison, exact and in blocks.

All-pairs work is cut into (block, block) tiles. A tile holds two bounded sets of
vectors, multiplies them once and passes on only the best k per vector, so no task
sees a whole group and no list of all pairs is ever shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import vectors as fv
from strandline.operators.ordered import top_k


#: Scores that a tile works out at once.
TILE_CELLS = 1 << 20


def _blocked(df: DataFrame, ident: str, group: str | None, vector: str, rows: int) -> DataFrame:
    """Vectors with their block number and the number of blocks of their group.

    Without a group all vectors are one, and its number of blocks is a scalar.
    """
    blocks = F.ceil(F.count(F.lit(1)) / F.lit(rows)).cast("int")
    if group is None:
        sized = df.withColumn("blocks", df.agg(F.greatest(blocks, F.lit(1))).scalar())
    else:
        sized = df.join(df.groupBy(group).agg(blocks.alias("blocks")), group)
    return sized.select(
        (F.lit(0) if group is None else F.col(group)).alias("g"),
        F.col(ident).alias("id"),
        F.col(vector).cast("array<double>").alias("vec"),
        "blocks",
        F.pmod(F.xxhash64(ident), F.col("blocks")).cast("int").alias("block"),
    )


def _tile(id_type: str, group_type: str, metric: str, k: int | None, skip_same: bool, min_score: float | None):
    schema = f"g {group_type}, id_a {id_type}, id_b {id_type}, score double"

    def mirrored(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """A tile above the diagonal stands for its mirror image too."""
        here = compare(left, right)
        return here if key[1] == key[2] else pd.concat([here, compare(right, left)], ignore_index=True)

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        empty = pd.DataFrame({"g": [], "id_a": [], "id_b": [], "score": []})
        if left.empty or right.empty:
            return empty
        right = right.sort_values("id", kind="stable")
        b, ids_b, group = np.vstack(right["vec"].to_numpy()), right["id"].to_numpy(), left["g"].iloc[0]
        # Scores of a few rows at a time, so a tile holds no matrix of both its sides.
        step = max(1, TILE_CELLS // len(b))
        found = [best(left.iloc[n : n + step], b, ids_b) for n in range(0, len(left), step)]
        id_a, id_b, score = (np.concatenate(x) for x in zip(*found))
        if not len(id_a):
            return empty
        return pd.DataFrame({"g": group, "id_a": id_a, "id_b": id_b, "score": score})

    def best(left: pd.DataFrame, b, ids_b) -> tuple:
        import numpy as np

        a, ids_a = np.vstack(left["vec"].to_numpy()), left["id"].to_numpy()
        if metric == "cosine":
            na, nb = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
            length = na[:, None] * nb[None, :]
            score = np.divide(a @ b.T, length, out=np.zeros((len(a), len(b))), where=length > 0)
        else:
            score = np.stack([np.sqrt(((row - b) ** 2).sum(axis=1)) for row in a])
        allowed = ids_a[:, None] != ids_b[None, :] if skip_same else np.ones(score.shape, dtype=bool)
        if min_score is not None:
            allowed &= score >= min_score
        if k is None:
            i, j = np.nonzero(allowed)
        else:
            ranked = np.where(allowed, score, -np.inf)
            order = np.argsort(-ranked, axis=1, kind="stable")[:, :k]
            i = np.repeat(np.arange(len(a)), order.shape[1])
            j = order.ravel()
            keep = allowed[i, j]
            i, j = i[keep], j[keep]
        return ids_a[i], ids_b[j], score[i, j]

    return compare, mirrored, schema


def _half_tiles(side: DataFrame, mirrored, schema: str) -> DataFrame:
    """All tiles of one table with itself, each pair of blocks once."""
    left = side.withColumn("other", F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)))
    right = side.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("block"))))
    return _matched(left, right, mirrored, schema)


def _tiles(left: DataFrame, right: DataFrame, compare, schema: str) -> DataFrame:
    a = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("right_blocks") - 1)))
    b = right.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("left_blocks") - 1)))
    return _matched(a, b, compare, schema)


def _matched(a: DataFrame, b: DataFrame, compare, schema: str) -> DataFrame:
    a = a.select("g", F.col("block").alias("bi"), F.col("other").alias("bj"), "id", "vec")
    # Fresh aliases: both sides may come from the same table.
    b = b.select(
        F.col("g").alias("g"), F.col("other").alias("bi"), F.col("block").alias("bj"),
        F.col("id").alias("id"), F.col("vec").alias("vec"),
    )
    return a.groupBy("g", "bi", "bj").cogroup(b.groupBy("g", "bi", "bj")).applyInPandas(compare, schema)


def cosine_topk(
    df: DataFrame, ident: str, group: str, vector: str, k: int = 10, block_rows: int = 2048
) -> DataFrame:
    """The k most similar other vectors of the same group, exact, ties by id."""
    kinds = dict(df.dtypes)
    _, mirrored, schema = _tile(kinds[ident], kinds[group], "cosine", k, True, None)
    found = _half_tiles(_blocked(df, ident, group, vector, block_rows), mirrored, schema)
    return top_k(found, ["g", "id_a"], [F.col("score").desc(), F.col("id_b").asc()], k).withColumnRenamed("g", group)


def distance_matrix(profiles: DataFrame, ident: str, vector: str, block_rows: int = 1024) -> DataFrame:
    """Euclidean distance and similarity of every two profiles, the diagonal included.

    The matrix itself is the result, so this is for profile tables (one row per
    entity); use :func:`cosine_topk` for long tables.
    """
    kinds = dict(profiles.dtypes)
    _, mirrored, schema = _tile(kinds[ident], "int", "euclidean", None, False, None)
    pairs = _half_tiles(_blocked(profiles, ident, None, vector, block_rows), mirrored, schema).select("id_a", "id_b", F.col("score").alias("distance"))
    largest = pairs.filter("id_a <> id_b").agg(F.coalesce(F.max("distance"), F.lit(0.0)).alias("m")).scalar()
    return (
        pairs.withColumn("_m", largest)
        .withColumn(
            "similarity",
            F.when(F.col("id_a") == F.col("id_b"), F.lit(1.0)).otherwise(fv.distance_to_similarity(F.col("distance"), F.col("_m"))),
        )
        .drop("_m")
    )


def normalized_vectors(df: DataFrame, keys: list[str], dims: list[str], exclude: list[str] | None = None, normalize: bool = True) -> DataFrame:
    """Mean vector per key as an array, some dimensions left out, scaled to sum 1."""
    used = [d for d in dims if d not in (exclude or [])]
    means = df.groupBy(*keys).agg(*[F.avg(d).alias(d) for d in used])
    vec = F.array(*[F.col(d) for d in used])
    return means.select(*keys, (fv.to_unit_sum(vec) if normalize else vec).alias("vector"))


def fingerprint(vectors: DataFrame, key: str, dims: list[str], n: int = 8) -> DataFrame:
    """The n dimensions with the largest total over all entities, times 100, per entity."""
    order = F.array(*[F.lit(d) for d in dims])
    long = vectors.select(key, F.posexplode("vector").alias("_i", "value")).withColumn("dimension", F.get(order, F.col("_i")))
    totals = long.groupBy("_i", "dimension").agg(F.sum("value").alias("_total"))
    best = totals.orderBy(F.col("_total").desc(), "_i").limit(n).select("_i")
    return long.join(best, "_i", "left_semi").select(key, "dimension", (F.col("value") * 100).alias("value"))


def knn_search(
    corpus: DataFrame,
    queries: DataFrame,
    ident: str,
    vector: str,
    query_id: str,
    query_vector: str,
    *,
    k: int = 5,
    min_score: float | None = 0.7,
    where: Column | None = None,
    block_rows: int = 4096,
) -> DataFrame:
    """The k corpus vectors most similar to every query vector, above a threshold.

    Exact for any number of queries and corpus vectors, by one plan: blocks of queries meet
    blocks of the corpus, and a tile passes on only k rows a query. Each corpus vector is
    copied once for every block of queries.
    """
    base = corpus.filter(where) if where is not None else corpus
    kinds, qkinds = dict(corpus.dtypes), dict(queries.dtypes)
    ask = _blocked(queries, query_id, None, query_vector, block_rows)
    data = _blocked(base, ident, None, vector, block_rows)
    size = lambda df: df.agg(F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int"), F.lit(1))).scalar()
    compare, _, schema = _tile(kinds[ident], "int", "cosine", k, False, min_score)
    schema = schema.replace("id_a " + kinds[ident], "id_a " + qkinds[query_id])
    found = _tiles(ask.withColumn("right_blocks", size(base)), data.withColumn("left_blocks", size(queries)), compare, schema)
    found = found.select(F.col("id_a").alias("query"), F.col("id_b").alias("match"), "score")
    return top_k(found, ["query"], [F.col("score").desc(), F.col("match").asc()], k)


def knn_approximate(
    corpus: DataFrame,
    queries: DataFrame,
    ident: str,
    vector: str,
    query_id: str,
    query_vector: str,
    *,
    width: int,
    k: int = 5,
    tables: int = 12,
    planes: int = 8,
    seed: int = 17,
) -> DataFrame:
    """The k most similar vectors among those that share a hash with the query in one of the tables.

    Random hyperplanes give each vector one bit a plane; ``planes`` bits are the key of a table.
    Candidates come from equality joins, so the corpus isn't compared as a whole; every vector is
    indexed. Set the result against :func:`knn_search` with :func:`recall` to choose the numbers.
    """
    import random

    draw = random.Random(seed)
    normals = [[[draw.gauss(0, 1) for _ in range(width)] for _ in range(planes)] for _ in range(tables)]

    def keys(column: str) -> Column:
        vec = F.col(column).cast("array<double>")
        bit = lambda n: F.when(fv.dot(vec, F.array(*[F.lit(x) for x in n])) > 0, "1").otherwise("0")
        return F.array(*[F.concat(F.lit(f"{t}:"), *[bit(n) for n in normals[t]]) for t in range(tables)])

    data = corpus.select(F.col(ident).alias("match"), F.col(vector).alias("_v"), F.explode(keys(vector)).alias("_key"))
    ask = queries.select(F.col(query_id).alias("query"), F.col(query_vector).alias("_q"), F.explode(keys(query_vector)).alias("_key"))
    near = data.join(ask, "_key").groupBy("query", "match").agg(F.first("_v").alias("_v"), F.first("_q").alias("_q"))
    found = near.select("query", "match", fv.cosine(F.col("_q").cast("array<double>"), F.col("_v").cast("array<double>")).alias("score"))
    return top_k(found, ["query"], [F.col("score").desc(), F.col("match").asc()], k)


def recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    """Share of the exact (query, match) rows that were found, over all queries."""
    marked = exact.select("query", "match").join(found.select("query", "match", F.lit(1).alias("_hit")), ["query", "match"], "left")
    return marked.agg(F.avg(F.coalesce("_hit", F.lit(0))).alias("recall"), F.count(F.lit(1)).alias("wanted"))


def validate_vectors(df: DataFrame, vector: str, width: int) -> DataFrame:
    """Rows, wrong widths, NULLs, NaN and infinite values of a vector column."""
    v = F.col(vector)
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count(F.when(v.isNull(), 1)).alias("null_vectors"),
        F.count(F.when(F.size(v) != width, 1)).alias("wrong_width"),
        F.count(F.when(fv.has_nan(v), 1)).alias("nan_vectors"),
        F.count(F.when(fv.has_inf(v), 1)).alias("inf_vectors"),
    ).withColumn(
        "valid", (F.col("null_vectors") + F.col("wrong_width") + F.col("nan_vectors") + F.col("inf_vectors")) == 0
    )


def embed(
    df: DataFrame, ident: str, text: str, fn: Callable[[list[str]], list[list[float]]],
    batch: int = 100, retries: int = 3, backoff: float = 1.0,
) -> DataFrame:
    """Vectors from a caller-supplied function, called with batches of texts.

    A failed call is repeated with growing pauses; the last failure is raised.
    """
    id_type = dict(df.dtypes)[ident]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                for attempt in range(retries):
                    try:
                        made = fn(part["text"].tolist())
                        break
                    except Exception:
                        if attempt == retries - 1:
                            raise
                        time.sleep(backoff * 2**attempt)
                yield pd.DataFrame({"id": part["id"].to_numpy(), "embedding": [list(map(float, v)) for v in made]})

    out = df.select(F.col(ident).alias("id"), F.col(text).alias("text")).mapInPandas(run, f"id {id_type}, embedding array<double>")
    return out.withColumnRenamed("id", ident)
