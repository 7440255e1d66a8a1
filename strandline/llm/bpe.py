"""BPE encoding and decoding in batched numpy merge rounds.

The symbols of many words lie in one flat array. Each round looks up all adjacent pairs by
binary search over the sorted keys of the merge table, finds the lowest rank of each word by a
segmented minimum, and merges its leftmost pair of that rank. Words beyond ``LONG`` symbols,
for which a round for each merge would cost the square of their length, are merged with a heap
in the same order.

A text is cut into words at white space first: no pre-token crosses it. A worker keeps the
codes of up to ``KEPT`` words; a full store is emptied, so its memory is bounded.

NULL and empty texts have no tokens. The vocabulary file is named by path and read by the
driver; its tables (50,000 entries at most ``MOST_MERGES``) travel to the workers once.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from strandline.llm.common import col, free_names

LONG = 64
GROUP = 256
KEPT = 250_000
MOST_MERGES = 1_000_000
CODE = "n_tokens bigint, ids binary, decoded string"


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [""] * 256, 0
    for b in range(256):
        if b in printable:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + spare)
            spare += 1
    return out


class Bpe:
    """Encoder of a tokenizer file with a byte-level BPE whose words end in a suffix."""

    def __init__(self, spec: dict):
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix: str = model["end_of_word_suffix"] or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        if len(merges) > MOST_MERGES:
            raise ValueError(f"a merge table of {len(merges)} entries is too large to send to every task")
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        self.table: dict[int, tuple[int, int]] = {}
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + suffix] for s in symbols], np.int64)
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.tokens = [""] * (1 + max(max(vocab.values()), *self.added.values(), 0))
        for t, i in [*vocab.items(), *self.added.items()]:
            self.tokens[i] = t
        steps = spec["pre_tokenizer"]["pretokenizers"]
        self.pattern = regex.compile(steps[0]["pattern"]["Regex"])
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.forget()

    @classmethod
    def load(cls, path: str) -> Bpe:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    def __getstate__(self):
        return self.__dict__ | {"ids": {}, "decoded": {}, "blank": set(), "table": {}}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.forget()

    def merge_batch(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The codes of all words in one array, and where each word's begin (one more than words)."""
        sizes = np.array([len(w) for w in words], np.int64)
        small = (sizes > 0) & (sizes <= LONG)
        numbers = np.flatnonzero(small)
        done = [(np.full(len(codes), k), codes) for k in np.flatnonzero(sizes > LONG).tolist() for codes in [self.merge_long(words[k])]]
        data = np.frombuffer(b"".join([w for w in words if 0 < len(w) <= LONG]), np.uint8)
        ends = np.cumsum(sizes[small])
        symbols = self.inner[data]
        symbols[ends - 1] = self.last[data[ends - 1]]
        owner = np.repeat(numbers, sizes[small])
        unknown = np.iinfo(np.int64).max
        while symbols.size:
            keys = symbols[:-1] << 32 | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, keys), self.keys.size - 1)
            known = (self.keys[at] == keys) & (owner[:-1] == owner[1:])
            ranks = np.append(np.where(known, self.ranks[at], unknown), unknown)
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lowest = np.minimum.reduceat(ranks, starts)
            lengths = np.diff(np.append(starts, symbols.size))
            going = np.repeat(lowest < unknown, lengths)
            done.append((owner[~going], symbols[~going]))
            hit = np.flatnonzero((ranks == np.repeat(lowest, lengths)) & going)
            hit = hit[np.append(True, owner[hit][1:] != owner[hit][:-1])] if hit.size else hit
            symbols[hit] = self.made[at[hit]]
            going[hit + 1] = False
            symbols, owner = symbols[going], owner[going]
        owners = np.concatenate([np.empty(0, np.int64), *[d[0] for d in done]])
        codes = np.concatenate([np.empty(0, np.int64), *[d[1] for d in done]])
        begins = np.append(0, np.cumsum(np.bincount(owners, minlength=len(words))))
        return codes[np.argsort(owners, kind="stable")], begins

    def merge_long(self, word: bytes) -> np.ndarray:
        """One long word: a heap of (rank, place) over a linked list."""
        self.table = self.table or dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.made.tolist())))
        symbols = self.inner[np.frombuffer(word, np.uint8)].tolist()
        symbols[-1] = int(self.last[word[-1]])
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (found := self.table.get(symbols[i] << 32 | symbols[j])):
                heapq.heappush(heap, (found[0], i, symbols[i], symbols[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j < 0 or symbols[j] != b:
                continue
            symbols[i], symbols[j] = self.table[a << 32 | b][1], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return np.array([s for s in symbols if s >= 0], np.int64)

    def learn(self, words: set[str]) -> None:
        """Put the codes of words into the store, which is emptied first if it would grow too large."""
        if len(self.ids) + len(words) > KEPT:
            self.forget()
        cut = {w: self.pattern.findall(w) for w in words}
        parts = list({p for ps in cut.values() for p in ps})
        codes, begins = self.merge_batch([p.encode("utf-8", "surrogatepass") for p in parts])
        raw, names, at = codes.astype("<u4").tobytes(), [self.tokens[i] for i in codes.tolist()], begins.tolist()
        made = {p: (raw[4 * at[k] : 4 * at[k + 1]], " ".join(names[at[k] : at[k + 1]])) for k, p in enumerate(parts)}
        for w, ps in cut.items():
            if len(ps) == 1:
                self.ids[w], self.decoded[w] = made[ps[0]]
            else:
                self.ids[w], self.decoded[w] = b"".join([made[p][0] for p in ps]), " ".join([made[p][1] for p in ps])
        self.blank |= {w for w, ps in cut.items() if not ps}

    def forget(self) -> None:
        """Only added tokens stay; their keys begin with a blank, as no word does."""
        self.ids = {f" {t}": i.to_bytes(4, "little") for t, i in self.added.items()}
        self.decoded = {f" {t}": t for t in self.added}
        self.blank: set[str] = set()

    def split(self, text: str) -> list[str]:
        """Words of a text, and the keys of added tokens where they stand."""
        if not self.cut or not any(a in text for a in self.added):
            return self.words(text)
        return [w for part in self.cut.split(text) for w in ([f" {part}"] if part in self.added else self.words(part))]

    def words(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        # str.split() also cuts at these four, which the pattern takes as symbols
        return self.pattern.findall(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()

    def encode(self, texts: list[str | None], decode: bool = True) -> Iterator[tuple[bytes, str]]:
        """(codes as little-endian 32-bit numbers, decoded text) of each text."""
        for k in range(0, len(texts), GROUP):
            cut = [self.split(t) if t else [] for t in texts[k : k + GROUP]]
            new = {w for w in set().union(*cut) if w not in self.ids}
            if new:
                self.learn(new)
            for words in cut:
                try:
                    yield self._codes(words, decode)
                except KeyError:
                    self.forget()
                    self.learn(set(words) - self.ids.keys())
                    yield self._codes(words, decode)

    def _codes(self, words: list[str], decode: bool) -> tuple[bytes, str]:
        if self.blank:
            words = [w for w in words if w not in self.blank]
        return b"".join(map(self.ids.__getitem__, words)), " ".join(map(self.decoded.__getitem__, words)) if decode else ""


@functools.lru_cache(maxsize=2)
def coder(path: str) -> Bpe:
    return Bpe.load(path)


def encoded(docs: DataFrame, path: str, text: str = "text", make=None, schema: str = CODE, keep: list[str] | None = None, decode: bool = True) -> DataFrame:
    """The kept columns of every row and what ``make`` gives of its codes.

    ``make(codes, decoded)`` returns the values of ``schema``; without it they are the number
    of tokens, the codes as bytes and the decoded text. A new column whose name a kept one has already
    gets it with underscores before it. Rows are never dropped or merged.
    """
    keep = docs.columns if keep is None else keep
    [own] = free_names(docs.select([col(c) for c in keep]), "_whole_text")
    frame = docs.select(*[col(c) for c in keep], col(text).cast("string").alias(own))
    added = StructType.fromDDL(schema)
    names = free_names(frame.drop(own), *added.names)
    out = StructType([*[f for f in frame.schema.fields if f.name != own], *[StructField(n, f.dataType) for n, f in zip(names, added.fields)]])
    model = docs.sparkSession.sparkContext.broadcast(coder(path))
    make = make or (lambda codes, decoded: (len(codes) // 4, codes, decoded))
    n_kept = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model.value
        kinds = [f.type for f in to_arrow_schema(added)]
        for batch in batches:
            for part in (batch.slice(k, GROUP) for k in range(0, batch.num_rows, GROUP)):
                rows = [make(*c) for c in bpe.encode(part.column(n_kept).to_pylist(), decode)]
                made = [pa.array(list(v), k) for v, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns[:n_kept], *made], names=[*keep, *names])

    return frame.mapInArrow(run, out)


def digest(codes: bytes, decoded: str) -> tuple[int, str, str]:
    return len(codes) // 4, hashlib.sha256(codes).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest()


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """Number of tokens, digest of the codes and digest of the decoded text of every document."""
    return encoded(docs, path, make=digest, schema="n_tokens bigint, ids_sha256 string, decoded_sha256 string", keep=["doc_id"])
