"""Ranked lexical search in norm buckets: Cauchy-Schwarz skips buckets, coordinate bounds filter inside.

The score of a document for an item is the inner product of two sparse vectors over terms: the
item's term weights, and the document's impacts, whole numbers from term count and length. Terms
are the runs of letters, digits and non-ASCII signs, A-Z lower-cased, of the whole text.

1. One pass counts the terms of the items in every document; document frequencies, the number of
   documents and of terms follow from it.
2. Documents are ordered by the length (Euclidean norm) of their impacts, dealt to tasks by
   ranges, and stored. A bucket is a run of ``BUCKET`` rows of that order.
3. The longest vectors are searched first and give each item a threshold, its k-th score so far.
   Vectors shorter than any threshold allows aren't read; a bucket whose longest vector can't
   reach an item's threshold is skipped for it.
4. Inside a bucket the item's heaviest terms are taken until the rest of the item can't reach the
   threshold by itself: only documents with one of these terms are candidates. What they have
   of these terms, and the lengths of both rests, bound the score; survivors are scored in integers.

Items are taken in blocks of about ``BLOCK_WORDS`` words, each a stated query set against all rows.
Bounds are compared with a slack of 1e-9, above the rounding of doubles, and ties are kept.

NULL and empty texts have no terms and are never returned; NULL items have no results. Repeated
documents are ranked each; items that repeat an item_id are answered each. Scores that tie go by
doc_id, NULL first. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import col, stored
from strandline.llm.decontaminate import words_of
from strandline.session import wide_enough

K = 10
BLOCK_WORDS = 200_000
BUCKET = 2048
#: Share of the documents, those of the longest vectors, that give the first thresholds.
HEAD = 0.02
SLACK = 1.0 + 1e-9
GROUP = 1024


def item_blocks(items: DataFrame, block_words: int = BLOCK_WORDS, item: str = "item_id", text: str = "text") -> Iterator[list[tuple[object, list[bytes]]]]:
    """Lists of (item id, its distinct terms), one block of items after the other."""
    plain = items.select(col(item).alias("item"), col(text).cast("string").alias("text"))
    total = plain.agg(F.sum(F.size(F.split("text", " ")))).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    for k in range(blocks):
        part = plain if blocks == 1 else plain.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        yield [(i, sorted(set(words_of(t)))) for i, t in part.collect()]


def term_counts(docs: DataFrame, vocabulary: dict[bytes, int], ident: str, text: str) -> DataFrame:
    """(doc_id, n, terms, tfs) of the documents with terms: number of terms, and counts of the known ones."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)
    size = max(len(vocabulary), 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = known.value.get
        for batch in batches:
            for part in (batch.slice(k, GROUP) for k in range(0, batch.num_rows, GROUP)):
                words = [words_of(t) for t in part.column(1).to_pylist()]
                n = np.array([len(w) for w in words], np.int64)
                found = [[t for t in map(get, w) if t is not None] for w in words]
                owner = np.repeat(np.arange(n.size), [len(f) for f in found])
                cells, tfs = np.unique(owner * size + np.array([t for f in found for t in f], np.int64), return_counts=True)
                ends = pa.array(np.append(0, np.cumsum(np.bincount(cells // size, minlength=n.size))).astype(np.int32))
                terms = pa.ListArray.from_arrays(ends, pa.array((cells % size).astype(np.int32)))
                out = pa.RecordBatch.from_arrays([part.column(0), pa.array(n), terms, pa.ListArray.from_arrays(ends, pa.array(tfs.astype(np.int64)))], names=["doc_id", "n", "terms", "tfs"])
                yield out.filter(pa.array(n > 0))

    plain = docs.select(col(ident).cast("bigint").alias("doc_id"), col(text).cast("string").alias("text"))
    return plain.mapInArrow(count, "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>")


def impacts(counted: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """(doc_id, norm, terms, impacts), longest vectors first over all partitions."""
    m = F.expr(f"10 + ((90 * n * {n_docs}L) div {n_terms}L)")
    scored = counted.where("size(terms) > 0").withColumn("m", m)
    scored = scored.select("doc_id", "terms", F.expr("transform(tfs, tf -> (1000000000 * tf) div (1000 * tf + 8 * m))").alias("impacts"))
    norm = F.sqrt(F.aggregate("impacts", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    scored = scored.withColumn("norm", norm).where("norm > 0")
    order = [F.col("norm").desc(), F.col("doc_id")]
    return scored.repartitionByRange(wide_enough(counted), *order).sortWithinPartitions(*order)


class Bucket:
    """Postings of a run of documents."""

    def __init__(self, terms: np.ndarray, sizes: np.ndarray, values: np.ndarray, norms: np.ndarray):
        owner = np.repeat(np.arange(sizes.size), sizes)
        order = np.argsort(terms, kind="stable")
        self.terms, self.owner, self.values = terms[order], owner[order], values[order]
        self.norms, self.longest = norms, float(norms.max(initial=0.0))

    def postings(self, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, impact and item weight of every posting of the terms."""
        low, high = np.searchsorted(self.terms, terms, "left"), np.searchsorted(self.terms, terms, "right")
        sizes = high - low
        at = np.repeat(low - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())
        return self.owner[at], self.values[at], np.repeat(weights, sizes)


class Query:
    """An item's terms, heaviest first, and its best documents so far."""

    def __init__(self, terms: np.ndarray, weights: np.ndarray, threshold: int, k: int):
        order = np.lexsort((terms, -weights))
        self.terms, self.weights, self.threshold, self.k = terms[order], weights[order], threshold, k
        squares = np.append(self.weights.astype(np.float64) ** 2, 0.0)
        #: Length of what is left of the item behind its first terms.
        self.rest = np.sqrt(np.cumsum(squares[::-1])[::-1])
        self.scores, self.ids = np.empty(0, np.int64), np.empty((0, 2), np.int64)

    def search(self, bucket: Bucket, ids: np.ndarray) -> None:
        if self.rest[0] * bucket.longest * SLACK < self.threshold or not self.terms.size:
            return
        taken = int(np.argmax(self.rest * bucket.longest * SLACK < max(self.threshold, 1)))
        rows, values, weights = bucket.postings(self.terms[:taken], self.weights[:taken])
        if not rows.size:
            return
        n = bucket.norms.size
        partial = np.bincount(rows, weights * values.astype(np.float64), n)
        used = np.bincount(rows, values.astype(np.float64) ** 2, n)
        left = np.sqrt(np.maximum(bucket.norms**2 * SLACK - used, 0.0))
        stay = (partial > 0) & ((partial + self.rest[taken] * left) * SLACK >= self.threshold)
        if not stay.any():
            return
        scores = np.zeros(n, np.int64)
        rows, values, weights = bucket.postings(self.terms, self.weights)
        own = stay[rows]
        np.add.at(scores, rows[own], weights[own] * values[own])
        at = np.flatnonzero(stay & (scores >= max(self.threshold, 1)))
        self.scores, self.ids = np.append(self.scores, scores[at]), np.concatenate([self.ids, ids[at]])
        best = np.lexsort((self.ids[:, 1], self.ids[:, 0], -self.scores))[: self.k]
        self.scores, self.ids = self.scores[best], self.ids[best]
        if best.size == self.k:
            self.threshold = max(self.threshold, int(self.scores[-1]))


def searched(vectors: DataFrame, block: list[tuple[np.ndarray, np.ndarray]], thresholds: list[int], k: int) -> DataFrame:
    """(item, doc_id, score): the best k documents a task for each item of the block, no worse than its threshold."""
    asked = vectors.sparkSession.sparkContext.broadcast((block, thresholds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = [Query(t, w, th, k) for (t, w), th in zip(*asked.value)]
        for batch in batches:
            for part in (batch.slice(at, BUCKET) for at in range(0, batch.num_rows, BUCKET)):
                doc, terms, values = part.column(0), part.column(2), part.column(3)
                ids = np.stack([doc.is_valid().to_numpy(zero_copy_only=False).astype(np.int64), doc.fill_null(0).to_numpy()], axis=1)
                bucket = Bucket(terms.flatten().to_numpy(), terms.value_lengths().to_numpy(), values.flatten().to_numpy(), part.column(1).to_numpy())
                for query in queries:
                    query.search(bucket, ids)
        items = np.repeat(np.arange(len(queries), dtype=np.int32), [q.scores.size for q in queries])
        ids = np.concatenate([np.empty((0, 2), np.int64), *[q.ids for q in queries]])
        scores = np.concatenate([np.empty(0, np.int64), *[q.scores for q in queries]])
        yield pa.RecordBatch.from_arrays([pa.array(items), pa.array(ids[:, 1], mask=ids[:, 0] == 0), pa.array(scores)], names=["item", "doc_id", "score"])

    return vectors.select("doc_id", "norm", "terms", "impacts").mapInArrow(run, "item int, doc_id bigint, score bigint")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranked(docs: DataFrame, items: DataFrame, k: int = K, ident: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS, head: float = HEAD) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of every item."""
    spark, kind = docs.sparkSession, items.select(col(item)).dtypes[0][1]
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    for block in item_blocks(items, block_words, item, item_text):
        vocabulary = {w: k for k, w in enumerate(sorted({w for _, words in block for w in words}))}
        counted = stored(term_counts(docs, vocabulary, ident, text), "term-counts")
        n_docs, n_terms = counted.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not n_docs or not vocabulary:
            continue
        held = counted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect()
        weights = np.zeros(len(vocabulary), np.int64)
        for t, df in held:
            weights[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        vectors = stored(impacts(counted, n_docs, n_terms), "norm-buckets")
        queries = []
        for _, words in block:
            terms = np.array([vocabulary[w] for w in words], np.int32)
            own = weights[terms] if terms.size else np.empty(0, np.int64)
            queries.append((terms[own > 0], own[own > 0]))
        cut = vectors.agg(F.percentile_approx("norm", F.lit(1 - head))).first()[0]
        if cut is None:
            continue
        first = stored(_best(searched(vectors.where(F.col("norm") >= cut), queries, [0] * len(queries), k), k), "first-ranks")
        known = {r["item"]: r["s"] for r in first.groupBy("item").agg(F.min(F.when(F.col("rank") == k, F.col("score"))).alias("s")).collect()}
        thresholds = [known.get(q) or 0 for q in range(len(queries))]
        reach = [th / (math.sqrt(float((w.astype(np.float64) ** 2).sum())) * SLACK) for (_, w), th in zip(queries, thresholds) if w.size]
        rest = vectors.where((F.col("norm") < cut) & (F.col("norm") >= min(reach, default=0.0)))
        found = first.select("item", "doc_id", "score").unionAll(searched(rest, queries, thresholds, k))
        names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(block)], f"item int, item_id {kind}")
        out = out.unionAll(_best(found, k).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return out
