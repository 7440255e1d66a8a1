"""Near-duplicate join on word n-grams with rare-first prefix filtering.

1. Counts of all n-grams in ``BUCKETS`` hashed counters give the order: rare first. Any order
   gives the same result; a counter shared by several n-grams only makes them look more frequent.
2. Documents of equal n-gram sets form a class, one of them stands for it.
3. Each class is indexed under the n-grams of its prefix. Keys held by one class are dropped;
   how many of its prefix each class loses by that bounds its overlap with any other.
4. The members of a key are first compared with its most typical member (a star), and the
   components of these links are taken. Then all pairs of a key that lie in different
   components are compared. So a group of thousands of near copies costs no pairs within what
   is linked already, and no link between components is lost.
   Links within a star's component are counted, where asked for, by tiles that hold blocks of its
   sets: each two sets meet in one tile, and what is passed on is a number for each set.
5. Pairs pass the length, positional and suffix filters and are verified once on their sets.

The counters are the only thing that the driver gathers; their number is fixed.

NULL texts and texts without words have an empty set and link with nothing. Rows of one doc_id
are one document; a row with NULL as its doc_id has itself as a document without number: it
links with nothing and its component is NULL. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import col, release, stored
from strandline.llm.components import components
from strandline.llm.prefix_join import cross_pairs, live_postings, members, star_pairs, verified
from strandline.llm.shingles import grams, mix

BUCKET_BITS = 18
BANDS = 64
GROUP = 256
#: Members of the sets that a block of a tile holds; a set counts for at least LEAST members.
TILE_MEMBERS = 1 << 18
LEAST = 128
#: Pairs that a tile expands at once.
TILE_PAIRS = 1 << 22


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, GROUP):
            yield batch.slice(k, GROUP)


def rarity(texts: DataFrame, size: int) -> np.ndarray:
    """Number of (document, n-gram) pairs by bucket of the n-gram's hash, over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for part in _parts(batches):
            found, _ = grams(part.column(0).to_pylist(), size)
            total += np.bincount((found >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=total.size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    counts = texts.select("text").mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << BUCKET_BITS, np.int64)
    out[counts["bucket"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    return out


def levels(counts: np.ndarray) -> np.ndarray:
    """Counts as 10-bit steps, eight to each doubling."""
    return np.minimum(np.floor(8 * np.log2(counts + 1.0)), 1023).astype(np.uint64)


def numbers(found: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A 64-bit number of each set, from all its members: equal sets have equal numbers.

    Two of 10**9 different sets share a number with a probability of about 0.03.
    """
    sums = np.append(np.uint64(0), np.cumsum(mix(found ^ np.uint64(0x5851F42D4C957F2D))))
    ends = np.cumsum(n)
    return mix(sums[ends] - sums[ends - n] + n.astype(np.uint64)).view(np.int64)


def signatures(texts: DataFrame, size: int, percent: int, counts: np.ndarray) -> DataFrame:
    """(doc_id, n, rep, prefix): size and number of each set, and its rarest n-grams in order."""
    level = texts.sparkSession.sparkContext.broadcast(levels(counts))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = level.value
        for part in _parts(batches):
            found, n = grams(part.column(1).to_pylist(), size)
            owner = np.repeat(np.arange(n.size), n)
            keys = steps[(found >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)] << np.uint64(53) | found >> np.uint64(11)
            ends = np.cumsum(n)
            keys = keys[np.lexsort((keys, owner))]
            length = n - -(-percent * n // 100) + 1
            place = np.arange(keys.size) - np.repeat(ends - n, n)
            first = place < length[owner]
            offsets = np.append(0, np.cumsum(np.where(n > 0, length, 0)))
            prefix = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(keys[first].view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n.astype(np.int32)), pa.array(numbers(found, n)), prefix], names=["doc_id", "n", "rep", "prefix"])

    return texts.select("doc_id", "text").mapInArrow(sign, "doc_id bigint, n int, rep bigint, prefix array<bigint>")


def whole_sets(texts: DataFrame, size: int) -> DataFrame:
    """(rep, bands, tokens): the set of each text, and its size in each of the bands of its hashes."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            found, n = grams(part.column(0).to_pylist(), size)
            owner = np.repeat(np.arange(n.size), n)
            band = (mix(found) >> np.uint64(58)).astype(np.int64)
            bands = np.minimum(np.bincount(owner * BANDS + band, minlength=n.size * BANDS), 32767).astype(np.int16)
            tokens = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(found.view(np.int64)))
            bands = pa.ListArray.from_arrays(pa.array(np.arange(n.size + 1, dtype=np.int32) * BANDS), pa.array(bands))
            yield pa.RecordBatch.from_arrays([pa.array(numbers(found, n)), bands, tokens], names=["rep", "bands", "tokens"])

    return texts.select("text").mapInArrow(sets, "rep bigint, bands array<smallint>, tokens array<bigint>")


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Number of common members of each set of ``a`` with each of ``b``.

    Members that many sets hold are counted by a product of matrices, the others pair by pair.
    """
    members, ids = np.unique(np.concatenate(a + b), return_inverse=True)
    ids, split = ids.astype(np.int64), sum(map(len, a))
    at_a, at_b = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])
    in_a, in_b = np.bincount(ids[:split], minlength=members.size), np.bincount(ids[split:], minlength=members.size)
    many = (in_a * 16 > len(a)) & (in_b * 16 > len(b))
    total = np.zeros((len(a), len(b)), np.float32)
    wide = np.flatnonzero(many)
    for k in range(0, wide.size, 4096):
        column = np.full(members.size, -1)
        column[wide[k : k + 4096]] = np.arange(min(4096, wide.size - k))
        sides = []
        for at, own, rows in ((at_a, ids[:split], len(a)), (at_b, ids[split:], len(b))):
            here = column[own] >= 0
            side = np.zeros((rows, min(4096, wide.size - k)), np.float32)
            side[at[here], column[own][here]] = 1
            sides.append(side)
        total += sides[0] @ sides[1].T
    total = total.astype(np.int64)
    order = np.argsort(ids[split:], kind="stable")
    held, first = at_b[order], np.append(0, np.cumsum(in_b))
    few = np.flatnonzero(~many[ids[:split]] & (in_b[ids[:split]] > 0))
    rows, own = at_a[few], ids[:split][few]
    pairs = np.append(0, np.cumsum(in_b[own]))
    done = 0
    while done < own.size:
        stop = max(done + 1, int(np.searchsorted(pairs, pairs[done] + TILE_PAIRS, "right")) - 1)
        n = in_b[own[done:stop]]
        other = held[np.repeat(first[own[done:stop]] - (pairs[done:stop] - pairs[done]), n) + np.arange(pairs[stop] - pairs[done])]
        np.add.at(total, (np.repeat(rows[done:stop], n), other), 1)
        done = stop
    return total


def links_within(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, n_links): how many sets of its component each set (node, component, n) links with.

    A component of two is one link. The sets of a larger one are dealt into blocks, and each two blocks meet in a tile.
    """
    of = groups.groupBy("component").agg(F.count(F.lit(1)).alias("held"), F.sum(F.greatest("n", F.lit(LEAST))).alias("members"))
    of = groups.join(of, "component")
    two = of.where("held = 2").select("node", F.lit(1).cast("bigint").alias("n_links"))
    blocks = F.ceil(F.col("members") / TILE_MEMBERS).cast("int")
    dealt = of.where("held > 2").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.join(sets.select(F.col("rep").alias("node"), "tokens").dropDuplicates(["node"]), "node")
    dealt = dealt.select("node", "component", "tokens", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    dealt = dealt.select("node", "component", "tokens", "block", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"))

    def tile(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sides = [rows[rows["block"] == k] for k in key[1:]]
        a, b = ([np.asarray(x) for x in side["tokens"]] for side in sides)
        if not a or not b:
            return pd.DataFrame({"node": np.empty(0, np.int64), "n_links": np.empty(0, np.int64)})
        sizes = np.array([x.size for x in a])[:, None] + np.array([x.size for x in b])[None, :]
        link = (100 + percent) * overlaps(a, b) >= percent * sizes
        if key[1] == key[2]:
            np.fill_diagonal(link, False)
            return pd.DataFrame({"node": sides[0]["node"].to_numpy(), "n_links": link.sum(1)})
        nodes = np.concatenate([side["node"].to_numpy() for side in sides])
        return pd.DataFrame({"node": nodes, "n_links": np.concatenate([link.sum(1), link.sum(0)])})

    tiles = dealt.groupBy("component", "low", "high").applyInPandas(tile, "node bigint, n_links bigint")
    return two.unionAll(tiles).groupBy("node").agg(F.sum("n_links").alias("n_links"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text", count_links: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id of every row, and n_links: the links of its class with other classes."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), col(text).cast("string").alias("text"))
    signs = stored(signatures(texts, size, percent, rarity(texts, size)), "signatures")
    filled = signs.where("n > 0 AND doc_id IS NOT NULL")
    classes = filled.groupBy("rep").agg(F.min("doc_id").alias("doc_id"), F.min_by(F.struct("n", "prefix"), "doc_id").alias("x"))
    # documents have far more n-grams than a parity has bits
    classes = stored(classes.select("rep", "doc_id", "x.n", "x.prefix", F.lit(None).cast("bigint").alias("parity")), "classes")
    live = live_postings(classes)

    def checked(pairs: DataFrame) -> DataFrame:
        """The links among the pairs; only the texts of their members are read again."""
        pairs = stored(pairs.select("a", "b", "na", "nb"), "pairs")
        wanted = stored(classes.join(members(pairs), "rep").select("doc_id").distinct(), "wanted")
        sets = stored(whole_sets(texts.join(wanted, "doc_id", "left_semi"), size), "sets")
        links = stored(verified(pairs, sets, percent), "links")
        release(pairs, wanted, sets)
        return links

    star = checked(star_pairs(live, percent))

    stars = components(star)
    parted = live.join(stars, F.col("rep") == F.col("node"), "left").select(*live.columns, F.coalesce("component", "rep").alias("component"))
    whole = parted = stored(parted, "parted")
    release(live)
    mixed = parted.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    parted = parted.join(mixed, "key", "left_semi")
    across = cross_pairs(parted, parted, lambda x, y: (x("component") != y("component")) & (x("rep") < y("rep")), percent)
    across = checked(across)
    links = star.unionAll(across)
    release(whole)

    ids = filled.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b")
    ids = filled.join(ids, "doc_id").select("a", F.col("rep").alias("b"))
    found = components(links.unionAll(ids))
    degree = across.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    if count_links:
        groups = stored(classes.join(stars, F.col("rep") == F.col("node")).select("node", "component", "n", "doc_id"), "star-groups")
        larger = groups.groupBy("component").agg(F.count(F.lit(1)).alias("held")).where("held > 2").select("component")
        wanted = stored(groups.join(larger, "component").select("doc_id").distinct(), "wanted")
        sets = stored(whole_sets(texts.join(wanted, "doc_id", "left_semi"), size), "sets")
        degree = degree.unionAll(links_within(groups, sets, percent)).groupBy("node").agg(F.sum("n_links").alias("n_links"))
        degree = stored(degree, "degrees")
        release(groups, wanted, sets)
    of_class = classes.select("rep", F.col("doc_id").alias("least")).join(found, F.col("rep") == F.col("node"), "left").drop("node")
    first = of_class.where("component IS NOT NULL").groupBy("component").agg(F.min("least").alias("first"))
    of_class = of_class.join(first, "component", "left").join(degree, F.col("rep") == F.col("node"), "left")
    of_class = of_class.select("rep", F.coalesce("first", "least").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = signs.select("doc_id", "n", F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("rep")).alias("rep")).join(of_class, "rep", "left")
    out = out.select(
        "doc_id", F.col("n").cast("bigint").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
    return out if count_links else out.drop("n_links")


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """The rows of the document with the smallest doc_id of each component, in their columns.

    Rows without a doc_id stay; so do all rows that repeat the doc_id kept.
    """
    gone = near_duplicates(docs, size, percent, text, count_links=False).where("component_id < doc_id").select("doc_id").distinct()
    gone = stored(gone, "near-duplicates")
    return docs.join(gone, docs["doc_id"] == gone["doc_id"], "left_anti")
