"""Subword lattice likelihood of documents, beside a smoothed word unigram.

The pieces of an existing vocabulary file weight every segmentation of a text. Pieces never cross
a word, so a document's marginal probability is the product of those of its words and of the end;
a word's is summed over all its segmentations by a forward recursion in log space. The weight of a
piece is its count in the training words, smoothed towards its place in the file's scores.
A character outside the vocabulary is spelled in the file's byte pieces.

Documents are read once, in chunks of at most ``CHUNK_TOKENS`` tokens (a longer document is a
chunk of its own); a chunk has its different words and, for each document, their counts. Words
are counted over all chunks, each different word is scored once, and scores go back to the chunks
as one row for each word of a chunk, so a frequent word is no hot key. A chunk is stored as rows of
one document or of ``SLICE`` words, as Spark reads and writes some thousand rows at a time, and only
the Python worker that adds up its documents holds it whole. The driver gathers two sums and the
counts of the vocabulary's pieces.

A NULL text is an empty one: its only token is the end. A NULL doc_id counts as training. Repeated
rows count each time. With no training rows every count is 0. Words are lower-cased for A-Z only.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from strandline.llm.common import col, stored

FOLDS, HELD = 5, 1
CHUNK_TOKENS = 2_000_000
SLICE = 256
SMOOTH = 0.5
MARK, END = "▁", "</s>"
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 32 or 9 <= b <= 13 else b for b in range(256))
_CHUNK = "chunk bigint, doc_id bigint, held boolean, places array<int>, counts array<int>, first int, words array<string>, train array<bigint>"
_OUT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def is_held(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD


def chunks(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row for each document with its counts of words, and rows of at most ``SLICE`` words of each chunk.

    ``places`` are the words of a document by their place in the chunk's words, ascending, as steps
    from the one before, so that they take little space. ``first`` is the place of a row's first word.
    """
    kinds = to_arrow_schema(StructType.fromDDL(_CHUNK))

    def lists(name: str, parts: list, sizes: list[int]) -> pa.Array:
        kind = kinds.field(name).type
        values = parts if name == "words" else np.concatenate(parts)
        return pa.ListArray.from_arrays(np.append(0, np.cumsum(sizes)).astype(np.int32), pa.array(values, kind.value_type), type=kind)

    def filled(n: int, **columns) -> pa.RecordBatch:
        cells = [columns.get(f.name, pa.nulls(n, f.type)) for f in kinds]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cells, kinds)], schema=kinds)

    def documents(number: int, rows: list) -> pa.RecordBatch:
        ids, held, places, counts = zip(*rows)
        sizes = [len(x) for x in places]
        return filled(
            len(rows), chunk=np.full(len(rows), number), doc_id=list(ids), held=list(held),
            places=lists("places", places, sizes), counts=lists("counts", counts, sizes),
        )

    def vocabulary(number: int, seen: dict, train: np.ndarray) -> pa.RecordBatch:
        first = np.arange(0, len(seen), SLICE)
        sizes = np.diff(np.append(first, len(seen)))
        names = [w.decode("utf-8", "surrogatepass") for w in seen]
        return filled(len(first), chunk=np.full(len(first), number), first=first, words=lists("words", names, sizes), train=lists("train", [train], sizes))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        seen, train, tokens = {}, np.zeros(1 << 16, np.int64), 0
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part, rows = batch.slice(start, 256), []
                for doc_id, whole in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    found = Counter(whole.encode("utf-8", "surrogatepass").translate(_FOLD).split()) if whole else {}
                    held = is_held(doc_id)
                    places = np.array([seen.setdefault(w, len(seen)) for w in found], np.int32)
                    order = np.argsort(places)
                    places, counts = places[order], np.array(list(found.values()), np.int32)[order]
                    while train.size < len(seen):
                        train = np.append(train, np.zeros_like(train))
                    if not held:
                        train[places] += counts
                    rows.append((doc_id, held, np.diff(places, prepend=np.int32(0)), counts))
                    tokens += int(counts.sum())
                    if tokens >= CHUNK_TOKENS:
                        yield documents(number, rows)
                        yield vocabulary(number, seen, train[: len(seen)])
                        number += 1
                        seen, train, rows, tokens = {}, np.zeros(1 << 16, np.int64), [], 0
                if rows:
                    yield documents(number, rows)
        if seen:
            yield vocabulary(number, seen, train[: len(seen)])

    return docs.select(F.col("doc_id").cast("bigint"), col(text).cast("string")).mapInArrow(cut, _CHUNK)


class Pieces:
    """The vocabulary file, and the log weights of its pieces once counted."""

    def __init__(self, proto: bytes):
        self.proto = proto
        self.log: dict[str, float] = {}

    @functools.cached_property
    def model(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self.proto)

    def __getstate__(self):
        return {"proto": self.proto, "log": self.log}

    def count(self, words: list[str], counts: list[int]) -> np.ndarray:
        """Pieces of the words in the file's own segmentation, weighted by the words' counts."""
        codes = self.model.encode(words, num_threads=1)
        at = np.fromiter((c for cs in codes for c in cs), np.int64)
        weight = np.repeat(np.array(counts, np.float64), [len(c) for c in codes])
        return np.bincount(at, weight, minlength=self.model.vocab_size())

    def weigh(self, counts: np.ndarray) -> None:
        """Log weights: counts plus half a count a piece, dealt out by the rank of the file's scores."""
        m = self.model
        size = m.vocab_size()
        usable = np.array([not (m.is_unknown(i) or m.is_unused(i) or (m.is_control(i) and m.id_to_piece(i) != END)) for i in range(size)])
        rank = np.empty(size)
        rank[np.argsort([-m.get_score(i) for i in range(size)], kind="stable")] = np.arange(1, size + 1)
        prior = usable / rank
        total = np.where(usable, counts, 0) + SMOOTH * usable.sum() * prior / prior.sum()
        logs = np.log(total[usable] / total.sum())
        self.log = dict(zip([m.id_to_piece(int(i)) for i in np.flatnonzero(usable)], logs.tolist()))

    @functools.cached_property
    def longest(self) -> int:
        return max(map(len, self.log))

    def spelled(self, char: str) -> float:
        """Log weight of a character in byte pieces."""
        return sum(self.log[f"<0x{b:02X}>"] for b in char.encode("utf-8", "surrogatepass"))

    def marginal(self, word: str) -> float:
        """Log of the summed weight of all segmentations of a word."""
        s, get, longest = MARK + word, self.log.get, self.longest
        n = len(s)
        alpha = [-math.inf] * (n + 1)
        alpha[0] = 0.0
        exp, log1p = math.exp, math.log1p
        for i in range(n):
            here = alpha[i]
            for j in range(i + 1, min(n, i + longest) + 1):
                step = get(s[i:j])
                if step is None:
                    if j > i + 1:
                        continue
                    step = self.spelled(s[i])
                new, old = here + step, alpha[j]
                if new > old:
                    new, old = old, new
                alpha[j] = old + log1p(exp(new - old))
        return alpha[n]


def piece_counts(words: DataFrame, pieces) -> DataFrame:
    """(piece, n) over (word, c)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(pieces.value.model.vocab_size())
        for batch in batches:
            total += pieces.value.count(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["piece", "n"])

    return words.where("c > 0").select("word", "c").mapInArrow(count, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n"))


def scored_words(words: DataFrame, pieces) -> DataFrame:
    """(word, c, log_weight) over (word, c): each different word is scored once."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logs = [pieces.value.marginal(w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(logs, pa.float64())], names=["word", "c", "log_weight"])

    return words.select("word", "c").mapInArrow(score, "word string, c bigint, log_weight double")


def scores(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    sc = docs.sparkSession.sparkContext
    parts = stored(chunks(docs, text), "chunks", "zstd")
    listed = parts.where("words IS NOT NULL")
    pairs = listed.select(F.explode(F.arrays_zip("words", "train")).alias("x")).select(F.col("x.words").alias("word"), F.col("x.train").alias("c"))
    words = stored(pairs.groupBy("word").agg(F.sum("c").alias("c")), "word-counts")
    ends = parts.agg(F.count(F.when(~F.col("held"), 1))).first()[0]
    tokens, kinds = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    tokens, kinds = tokens + ends, kinds + (ends > 0)

    with open(path, "rb") as f:
        pieces = Pieces(f.read())
    counted = piece_counts(words, sc.broadcast(pieces)).toPandas()
    counts = np.zeros(pieces.model.vocab_size())
    counts[counted["piece"].to_numpy(np.int64)] = counted["n"]
    counts[pieces.model.piece_to_id(END)] += ends
    pieces.weigh(counts)
    marks = stored(scored_words(words, sc.broadcast(pieces)), "word-scores")

    own = listed.select("chunk", "first", F.posexplode("words").alias("at", "word")).join(marks, "word")
    own = own.select(F.col("chunk").alias("of"), (F.col("first") + F.col("at")).alias("place"), "c", "log_weight")
    told = parts.where("places IS NOT NULL").select("chunk", "doc_id", "held", "places", "counts")
    whole = tokens + SMOOTH * (kinds + 1)
    end_base, end_log = math.log10((ends + SMOOTH) / whole), pieces.log[END]
    out = to_arrow_schema(StructType.fromDDL(_OUT))

    def total(docs: pa.Table, words: pa.Table) -> pa.Table:
        sizes = pc.list_value_length(docs["places"]).to_numpy().astype(np.int64)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        flat = lambda name: pc.list_flatten(docs[name]).to_numpy().astype(np.int64)
        along, n = np.append(0, np.cumsum(flat("places"))), flat("counts")
        places = along[1:] - np.repeat(along[np.cumsum(sizes) - sizes], sizes)
        order = np.argsort(words["place"].to_numpy())
        c, w = (words[name].to_numpy()[order][places] for name in ("c", "log_weight"))
        add = lambda x: np.bincount(owner, x, minlength=len(sizes))
        columns = [
            docs["doc_id"],
            docs["held"],
            pa.array(add(n).astype(np.int64) + 1),
            pa.array(add(n * (c > 0)).astype(np.int64) + (ends > 0)),
            pa.array(np.full(len(sizes), tokens, np.int64)),
            pa.array(add(n * np.log10((c + SMOOTH) / whole)) + end_base),
            pa.array((add(n * w) + end_log) / math.log(10)),
        ]
        return pa.Table.from_arrays([x.cast(f.type) for x, f in zip(columns, out)], schema=out)

    return told.groupBy("chunk").cogroup(own.groupBy("of")).applyInArrow(total, _OUT)
