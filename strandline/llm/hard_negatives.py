"""Hard-negative mining with cover trees over norm-augmented candidates.

Vectors become whole numbers, and a score is an integer inner product. A candidate x gets one more
component, sqrt(M**2 - |x|**2) with M the greatest length, so all have length M and the inner product
with an anchor falls with the distance; a ball of radius r around a centre bounds the scores of all
it covers by score(centre) +- |anchor| * r.

* **Cells.** Centres from a sample of at most ``SAMPLE`` rows, taken farthest first, are the top level;
  every row belongs to its nearest centre, and the cell keeps its covering radius. A cell of more than
  ``BLOCK`` rows is dealt into several trees, so no group grows with the data.
* **Trees.** Within a tree each level's radius is half of the one above: centres farther apart than it
  cover the rest. Every node keeps its true covering radius. Where a level would need a centre for
  more than a quarter of the rows there is no structure left, and the node is a leaf.
* **Search.** An anchor visits its own cell first and takes its k-th score as threshold, then every other
  cell whose bound reaches it. Within a tree each query opens its most promising node first, skips nodes
  outside its window or below its threshold, and verifies leaves in integers.

A query is an anchor (its positives: the best rows of its label), then an anchor with one positive
(its negatives: the best rows of other labels in the window that the positive's score gives).

Rows with a NULL label, vector or component, or one that isn't finite, take no part; a shorter vector
counts as filled up with zeros. Rows that repeat another in id, label and vector count once; an anchor's
other rows are those of other ids. NULL as id is no anchor. Anchors without rows of their label have no
result. Ties go by the smaller id. An empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import col, stored

SAMPLE = 2048
MOST_CELLS = 512
BLOCK = 2048
#: Anchors searched together in one tree.
ANCHORS = 512
LEAF = 32
NONE = np.iinfo(np.int64).min
QUERY = "query bigint, anchor bigint, label int, qvec array<bigint>, same boolean, low bigint, high bigint, threshold bigint, home int"


def prepared(rows: DataFrame, label: Column | None = None, ident: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, label, vec) of the rows that take part; ``vec`` has whole numbers."""
    v, label = col(vector), col("label") if label is None else label
    whole = F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint"))
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(good & label.isNotNull()).select(col(ident).cast("bigint").alias("vec_id"), label.cast("int").alias("label"), whole.alias("vec"))


def matrix(vectors: list[np.ndarray], width: int = 0) -> np.ndarray:
    """Rows of int64, filled up with zeros to one width, the widest or the one given."""
    width = max(width, max((len(v) for v in vectors), default=0))
    out = np.zeros((len(vectors), width), np.int64)
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def dense(lists: pa.ListArray, width: int) -> np.ndarray:
    """The same from an Arrow column."""
    sizes, out = lists.value_lengths().to_numpy(), np.zeros((len(lists), width), np.int64)
    row = np.repeat(np.arange(len(lists)), sizes)
    out[row, np.arange(row.size) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy()
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows; in doubles where no sum can leave their exact range."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most >= 2**63:
        raise ValueError("inner products beyond 64 bits")
    return a @ b.T


def augmented(x: np.ndarray, most: float) -> np.ndarray:
    """Rows of one length: one more component makes up for what each lacks to the greatest length."""
    plain = x.astype(np.float64)
    return np.column_stack([plain, np.sqrt(np.maximum(most - (plain**2).sum(axis=1), 0.0))])


def distances(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - centre) ** 2).sum(axis=1))


def farthest_first(points: np.ndarray, most: int, radius: float = 0.0) -> tuple[list[int], np.ndarray]:
    """Centres, each the point farthest from those before, until all lie within ``radius``, and each point's centre."""
    squares = (points**2).sum(axis=1)
    away = lambda c: squares + squares[c] - 2 * (points @ points[c])
    centres, near, owner = [0], away(0), np.zeros(len(points), np.int64)
    while len(centres) < most:
        far = int(near.argmax())
        if near[far] <= max(radius**2, 1e-3):
            break
        d = away(far)
        closer = d < near
        near[closer], owner[closer] = d[closer], len(centres)
        centres.append(far)
    return centres, owner


class Tree:
    """Cover tree of one block: nodes with centre, true radius and children, or with rows."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, most: float):
        self.ids, self.labels, self.x = ids, labels, x
        points = augmented(x, most)
        self.centres: list[np.ndarray] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.rows: list[np.ndarray] = []
        work = [(self._node(points, np.arange(len(x)), 0), None)]
        while work:
            node, level = work.pop()
            own = self.rows[node]
            if len(own) <= LEAF or self.radius[node] < 0.5:
                continue  # whole numbers that differ lie farther apart
            level = self.radius[node] / 2 if level is None else min(level, self.radius[node]) / 2
            centres, owner = farthest_first(points[own], len(own) // 4 + 1, level)
            if len(centres) > len(own) // 4:
                continue
            for k, c in enumerate(centres):
                child = self._node(points, own[owner == k], int(own[c]))
                self.children[node].append(child)
                work.append((child, level))
            self.rows[node] = own[:0]

    def _node(self, points: np.ndarray, own: np.ndarray, centre: int) -> int:
        self.centres.append(points[centre])
        self.radius.append(float(distances(points[own], points[centre]).max(initial=0.0)) * (1 + 1e-9) + 1e-6)
        self.children.append([])
        self.rows.append(own)
        return len(self.rows) - 1


class Search:
    """Queries of one tree: anchors' vectors, labels, windows and thresholds, and their best rows."""

    def __init__(self, q: pd.DataFrame, k: int):
        self.k, self.query = k, q["query"].to_numpy(np.int64)
        self.anchor, self.label, self.same = (q[c].to_numpy() for c in ("anchor", "label", "same"))
        self.low, self.high, self.threshold = (q[c].to_numpy(np.int64).copy() for c in ("low", "high", "threshold"))
        self.vectors = list(q["qvec"])
        self.found = np.empty((0, 3), np.int64)

    def run(self, tree: Tree) -> None:
        width = max(tree.x.shape[1], max(map(len, self.vectors), default=0))
        a = matrix(self.vectors, width)
        x = np.pad(tree.x, ((0, 0), (0, width - tree.x.shape[1])))
        length = np.sqrt((a.astype(np.float64) ** 2).sum(axis=1))
        centres = np.zeros((len(tree.rows), width))
        for k, c in enumerate(tree.centres):
            centres[k, : len(c) - 1] = c[:-1]
        # rounding of the doubles is far below this slack
        middle = a.astype(np.float64) @ centres.T
        reach = length[:, None] * np.array(tree.radius)[None, :] * (1 + 1e-9) + 1e-6 * (1 + np.abs(middle))
        upper = np.minimum(middle + reach, self.high[:, None].astype(np.float64))
        outside = middle - reach > self.high[:, None]
        open_ = np.full(upper.shape, -np.inf)
        open_[:, 0] = np.where(outside[:, 0], -np.inf, upper[:, 0])
        every = np.arange(len(a))
        while True:
            best = open_.argmax(axis=1)
            value = open_[every, best]
            going = (value > -np.inf) & (value >= np.maximum(self.low, self.threshold))
            if not going.any():
                return
            for node in np.unique(best[going]).tolist():
                at = np.flatnonzero(going & (best == node))
                open_[at, node] = -np.inf
                kids = tree.children[node]
                if kids:
                    grid = np.ix_(at, kids)
                    open_[grid] = np.where(outside[grid], -np.inf, upper[grid])
                else:
                    self._verify(tree, x, a, at, tree.rows[node])

    def _verify(self, tree: Tree, x: np.ndarray, a: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
        scores = products(a[at], x[rows])
        ids, same = tree.ids[rows], tree.labels[rows][None, :] == self.label[at][:, None]
        least = np.maximum(self.low[at], self.threshold[at])[:, None]
        fits = (same == self.same[at][:, None]) & (scores >= least) & (scores <= self.high[at][:, None])
        fits &= ids[None, :] != self.anchor[at][:, None]
        if rows.size > self.k:
            masked = np.where(fits, scores, NONE)
            fits &= masked >= np.partition(masked, rows.size - self.k, axis=1)[:, rows.size - self.k, None]
        i, j = np.nonzero(fits)
        if not i.size:
            return
        self.found = np.concatenate([self.found, np.stack([at[i], scores[i, j], ids[j]], axis=1)])
        self.found = self.found[np.lexsort((self.found[:, 2], -self.found[:, 1], self.found[:, 0]))]
        first = np.searchsorted(self.found[:, 0], self.found[:, 0], "left")
        self.found = self.found[np.arange(len(self.found)) - first < self.k]
        n = np.bincount(self.found[:, 0], minlength=len(a))
        full = np.flatnonzero(n == self.k)
        last = np.cumsum(n)[full] - 1
        self.threshold[full] = np.maximum(self.threshold[full], self.found[last, 1])


class Index:
    """Cells (a bounded number, on the driver) and the stored trees (block, cell, tree)."""

    def __init__(self, candidates: DataFrame, sample: int = SAMPLE, most_cells: int = MOST_CELLS, block: int = BLOCK):
        spark = candidates.sparkSession
        square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
        self.n, self.most, self.width = candidates.agg(F.count(F.lit(1)), F.max(square), F.max(F.size("vec"))).first()
        if not self.n:
            return
        self.width, self.most = self.width or 0, (self.most or 0.0) * (1 + 1e-12)
        picked = candidates.select(F.xxhash64("vec_id", "vec").alias("h"), "vec").orderBy("h").limit(sample).collect()
        points = augmented(matrix([np.array(r["vec"], np.int64) for r in picked], self.width), self.most)
        cells = min(most_cells, max(1, self.n // block))
        pivots = points[farthest_first(points, cells)[0]]
        shipped = spark.sparkContext.broadcast((pivots, self.most, self.width))

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pivots, most, width = shipped.value
            for batch in batches:
                x = augmented(dense(batch.column(2), width), most)
                d = np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ pivots.T + (pivots**2).sum(axis=1)[None, :], 0.0)
                cell = d.argmin(axis=1)
                away = np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(away)], names=["vec_id", "label", "vec", "cell", "away"])

        placed = stored(candidates.mapInArrow(near, "vec_id bigint, label int, vec array<bigint>, cell int, away double"), "cell-rows")
        sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).collect()
        self.placed = placed
        self.cells = np.array([r["cell"] for r in sizes], np.int32)
        self.centres = pivots[self.cells]
        self.radius = np.array([r["radius"] for r in sizes]) * (1 + 1e-9) + 1e-6
        self.parts = {r["cell"]: -(-r["n"] // block) for r in sizes}
        parts = F.element_at(F.create_map(*[F.lit(v) for kv in self.parts.items() for v in kv]), F.col("cell"))
        rows = placed.select("vec_id", "label", "vec", F.struct("cell", F.pmod(F.xxhash64("vec_id", "vec"), parts).cast("int").alias("part")).alias("tree"))
        most, width = self.most, self.width

        def build(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("vec_id", kind="stable", na_position="first")
            ids = group["vec_id"].fillna(NONE).to_numpy(np.int64)
            tree = Tree(ids, group["label"].to_numpy(np.int64), matrix(list(group["vec"]), width), most)
            return pd.DataFrame({"cell": [key[0]], "part": [key[1]], "tree": [pickle.dumps(vars(tree))]})

        keyed = rows.select("vec_id", "label", "vec", "tree.cell", "tree.part")
        self.trees = stored(keyed.groupBy("cell", "part").applyInPandas(build, "cell int, part int, tree binary"), "cover-trees")

    def at_home(self, queries: DataFrame) -> DataFrame:
        """The queries with the cell whose centre scores highest: by the added component, not always the nearest."""
        shipped, width = queries.sparkSession.sparkContext.broadcast((self.cells, self.centres)), self.width

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells, centres = shipped.value
            for batch in batches:
                home = cells[(dense(batch.column(3), width) @ centres[:, :-1].T).argmax(axis=1)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home)], names=[*batch.schema.names, "home"])

        return queries.mapInArrow(choose, QUERY)

    def others(self, queries: DataFrame) -> DataFrame:
        """The queries, once for each cell but the home whose bound allows a score within window and threshold."""
        shipped, width = queries.sparkSession.sparkContext.broadcast((self.cells, self.centres, self.radius)), self.width

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells, centres, radius = shipped.value
            for batch in batches:
                a = dense(batch.column(3), width).astype(np.float64)
                middle = a @ centres[:, :-1].T
                reach = np.sqrt((a**2).sum(axis=1))[:, None] * radius[None, :] * (1 + 1e-9) + 1e-6 * (1 + np.abs(middle))
                low, high, threshold, home = (batch.column(k).to_numpy() for k in (5, 6, 7, 8))
                wanted = (np.minimum(middle + reach, high[:, None]) >= np.maximum(low, threshold)[:, None]) & (middle - reach <= high[:, None])
                i, j = np.nonzero(wanted & (cells[None, :] != home[:, None]))
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(i)).columns, pa.array(cells[j])], names=[*batch.schema.names, "cell"])

        return queries.mapInArrow(choose, f"{QUERY}, cell int")

    def _visit(self, visits: DataFrame, crowds: int, k: int) -> DataFrame:
        """(query, score, vec_id) of the best k a tree."""
        parts = F.element_at(F.create_map(*[F.lit(v) for kv in self.parts.items() for v in kv]), F.col("cell"))
        visits = visits.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).withColumn("crowd", F.pmod(F.xxhash64("query"), F.lit(crowds)).cast("int"))
        visits = stored(visits, "tree-visits")
        # fresh names: a cogroup's sides must not share columns
        met = visits.select(*[F.col(c).alias(f"{c}_") for c in ("cell", "part", "crowd")]).distinct()
        on = (F.col("cell") == F.col("cell_")) & (F.col("part") == F.col("part_"))
        trees = self.trees.join(met, on).select("cell_", "part_", "crowd_", "tree")

        def look(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if left.empty or right.empty:
                return pd.DataFrame({"query": [], "score": [], "vec_id": []})
            search = Search(left, k)
            tree = Tree.__new__(Tree)
            vars(tree).update(pickle.loads(right["tree"].iloc[0]))
            search.run(tree)
            ids = pd.Series(search.found[:, 2], dtype="Int64")
            return pd.DataFrame({"query": search.query[search.found[:, 0]], "score": search.found[:, 1], "vec_id": ids.mask(ids == NONE)})

        keys = ["cell", "part", "crowd"]
        return visits.groupBy(*keys).cogroup(trees.groupBy(*[f"{c}_" for c in keys])).applyInPandas(look, "query bigint, score bigint, vec_id bigint")

    def best(self, queries: DataFrame, k: int) -> DataFrame:
        """(query, rank, vec_id, score) of the best k rows of every query."""
        queries = stored(self.at_home(queries), "queries")
        crowds = max(1, -(-queries.count() // ANCHORS))
        first = stored(ranked(self._visit(queries.withColumn("cell", F.col("home")), crowds, k), k), "home-finds")
        kth = first.where(F.col("rank") == k).select("query", F.col("score").alias("kth"))
        further = queries.join(kth, "query", "left").withColumn("threshold", F.coalesce("kth", "threshold")).select(*queries.columns)
        found = first.select("query", "score", "vec_id").unionAll(self._visit(self.others(further), crowds, k))
        return stored(ranked(found, k), "finds")


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mined(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores, from prepared rows (vec_id, label, vec).

    ``anchors`` says which rows are anchors. A negative's score lies between ``low`` and ``high``
    hundredths of its positive's.
    """
    rows = stored(rows.select("vec_id", "label", "vec").dropDuplicates(), "vectors")
    index = Index(rows, block=block)
    if not index.n:
        kinds = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
        return rows.sparkSession.createDataFrame([], kinds)
    number = F.xxhash64("vec_id", "label", "vec").alias("query")
    asked = rows.where(anchors & F.col("vec_id").isNotNull()).select(
        number, F.col("vec_id").alias("anchor"), "label", F.col("vec").alias("qvec"), F.lit(True).alias("same"),
        F.lit(NONE + 1).alias("low"), F.lit(-(NONE + 1)).alias("high"), F.lit(NONE + 1).alias("threshold"),
    )
    asked = stored(asked, "anchors")
    found = index.best(asked, positives)
    pairs = found.select(F.col("query").alias("of"), F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    pairs = pairs.join(asked.select(F.col("query").alias("of"), "anchor", "label", "qvec"), "of")
    score = F.col("positive_score")
    windows = pairs.select(
        F.xxhash64("of", "place").alias("query"), "anchor", "label", "qvec", F.lit(False).alias("same"),
        F.ceil(F.expr(f"cast({low} as decimal(20,0)) * positive_score / 100")).cast("bigint").alias("low"),
        F.floor(F.expr(f"cast({high} as decimal(20,0)) * positive_score / 100")).cast("bigint").alias("high"),
        F.lit(NONE + 1).alias("threshold"), "positive_id", score,
    )
    windows = stored(windows, "windows")
    near = index.best(windows.where("low <= high").select("query", "anchor", "label", "qvec", "same", "low", "high", "threshold"), negatives)
    out = windows.select("query", F.col("anchor").alias("anchor_id"), "positive_id", "positive_score").join(near, "query")
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
