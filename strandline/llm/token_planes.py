"""Token ids in files of compressed bit or byte planes, as a Spark data source.

A file holds the ids of many documents in one sequence, cut into blocks of a fixed number of ids.
Each block is transposed: plane k has bit (or byte) k of every id. Planes above the highest one in
use aren't written; each other plane is compressed by itself with zstandard. Behind the blocks
stand the table of documents and the chunk index (place, sizes and CRC of every block), so any
range of ids is read from its own blocks alone. ``_manifest.json`` names the files of a finished
write, in order, with their first id and document: files of failed attempts are never read.

Order: ascending doc_id, NULL first, then the hash of the text. Documents are dealt to files by
ranges of that, so the whole order never meets in one task. A document runs on over blocks, never
over files. NULL and empty texts have the end id only; repeated rows are documents of their own,
rows of one doc_id by the hash of their texts; an empty table gives a manifest without ids.

Texts are encoded by the tokenizers library. Its pre-tokens, which recur, are given to its model once and
kept in a store of bounded size, emptied when full. A text with an added token, or with a sign of which it
isn't sure what kind of pre-token it is in, is given to the library as a whole.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from strandline.llm.bpe import byte_symbols
from strandline.llm.common import col
from strandline.session import plan_bytes

MAGIC = b"IDPLANE1"
BLOCK = 65_536
END_ID = 2
KEPT = 500_000
GROUP = 512
FILE_BYTES = 256 << 20
SCHEMA = "doc_id bigint, start bigint, n_tokens bigint, ids binary"
#: Fields of one block in the chunk index, before the sizes of its planes.
BLOCK_FIELDS = ("at", "first", "n_ids", "crc", "n_planes")

#: Ranges of signs whose kind (letter, number, neither) hasn't changed between versions of Unicode.
SETTLED = ((0x20, 0x52F), (0x2010, 0x2027), (0x2030, 0x205E), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))
BLANK = r" \t\n\r\x0b\x0c"


def _signs(kinds: str) -> str:
    """The settled signs whose general category starts with one of the letters, as ranges of a character class."""
    found = [c for low, high in SETTLED for c in range(low, high + 1) if unicodedata.category(chr(c))[0] in kinds]
    starts = [c for c, before in zip(found, [-2, *found]) if c != before + 1]
    ends = [c for c, after in zip(found, [*found[1:], -2]) if c + 1 != after]
    return "".join(f"\\u{a:04x}-\\u{z:04x}" for a, z in zip(starts, ends))


def pre_tokens() -> re.Pattern:
    """The pattern of byte-level pre-tokens over settled signs and white space; other signs are never matched."""
    endings = "'(?:s|t|re|ve|m|ll|d)"
    runs = "| ".join(f"?[{_signs(kinds)}]+" for kinds in ("L", "N", "PSM"))
    return re.compile(f"{endings}| {runs}|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+")


class WordStore(dict):
    """Ids of texts as bytes, from the tokenizers library by way of a store of pre-tokens: itself, filled as it is asked."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        step = spec["pre_tokenizer"] or {}
        #: Only of this one pattern, without a normaliser, is it known what the pre-tokens are.
        self.parted = spec["normalizer"] is None and step.get("type") == "ByteLevel" and not step["add_prefix_space"] and step["use_regex"] and spec["post_processor"] is None
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.model, self.pattern = self.tokenizer.model, pre_tokens()
        self.symbols = dict(enumerate(byte_symbols()))
        self.codes = [k.to_bytes(4, "little") for k in range(self.tokenizer.get_vocab_size())]

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _cut(self, text: str) -> list[str] | None:
        """The pre-tokens of a text; None where the pattern leaves out a sign, or an added token stands."""
        parts = self.pattern.findall(text)
        sure = sum(map(len, parts)) == len(text) and not any(a in text for a in self.added)
        return parts if sure else None

    def __missing__(self, part: str) -> bytes:
        if part.isascii() and part.isprintable():
            symbols = part.replace(" ", self.symbols[32])
        else:
            symbols = part.encode().decode("latin-1").translate(self.symbols)
        ids = self[part] = b"".join([self.codes[t.id] for t in self.model.tokenize(symbols)])
        return ids

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if not self.parted:
            return self.whole([t or "" for t in texts])
        out: list[bytes] = []
        odd: list[int] = []
        for text in texts:
            parts = self._cut(text) if text else []
            if parts is None:
                odd.append(len(out))
                parts = []
            if len(self) > KEPT:
                self.clear()
            out.append(b"".join(map(self.__getitem__, parts)))
        for k, ids in zip(odd, self.whole([texts[k] for k in odd]) if odd else []):
            out[k] = ids
        return out


@functools.lru_cache(maxsize=2)
def word_store(path: str) -> WordStore:
    return WordStore(path)


def token_ids(docs: DataFrame, path: str, ident: str = "doc_id", text: str = "text", end_id: int | None = END_ID, files: int | None = None) -> DataFrame:
    """(doc_id, ids) of every row in ascending order, dealt to ``files`` partitions by ranges.

    ``ids`` are little-endian unsigned 32-bit numbers with the end id behind them. ``path`` names a
    tokenizer file that every worker can read.
    """
    plain = docs.select(col(ident).cast("bigint").alias("doc_id"), col(text).cast("string").alias("text"))
    session = docs.sparkSession
    files = files or max(int(session.conf.get("spark.sql.shuffle.partitions")), -(-plan_bytes(docs) // FILE_BYTES))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = plain.repartitionByRange(files, *order).sortWithinPartitions(*order)
    end = b"" if end_id is None else end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        store = word_store(path)
        for batch in batches:
            for part in (batch.slice(k, GROUP) for k in range(0, batch.num_rows, GROUP)):
                ids = pa.array([i + end for i in store.encode(part.column(1).to_pylist())], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["doc_id", "ids"])

    return ranged.mapInArrow(run, "doc_id bigint, ids binary")


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The planes of a block, lowest first, without those above the highest one in use."""
    top = int(ids.max()).bit_length() if ids.size else 0
    if bits:
        return [np.packbits((ids >> np.uint32(k)).astype(np.uint8) & 1).tobytes() for k in range(top)]
    raw = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return [raw[k].tobytes() for k in range(-(-top // 8))]


def from_planes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    out = np.zeros(n, np.uint32)
    for k, plane in enumerate(planes):
        own = np.frombuffer(plane, np.uint8)
        own = np.unpackbits(own, count=n) if bits else own
        out |= own.astype(np.uint32) << np.uint32(k if bits else 8 * k)
    return out


class FileWriter:
    """Writes one file; holds one block of ids at most, besides the document at hand."""

    def __init__(self, sink, bits: bool, block: int):
        self.sink, self.bits, self.block = sink, bits, block
        self.packer = zstandard.ZstdCompressor(level=3)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        self.blocks: list[tuple[int, ...]] = []
        self.sizes: list[int] = []
        self.docs: list[tuple[int, int, int]] = []
        self.at = self.sink.write(MAGIC) or len(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        numbers = np.frombuffer(ids, "<u4")
        self.docs.append((doc_id or 0, doc_id is None, numbers.size))
        while numbers.size:
            part = numbers[: self.block - self.n_held]
            self.held.append(part)
            self.n_held += part.size
            numbers = numbers[part.size :]
            if self.n_held == self.block:
                self._flush()

    def _flush(self) -> None:
        if not self.n_held:
            return
        ids = np.concatenate(self.held)
        planes = [self.packer.compress(p) for p in to_planes(ids, self.bits)]
        self.blocks.append((self.at, self.n_ids, ids.size, zlib.crc32(ids.astype("<u4").tobytes()), len(planes)))
        for plane in planes:
            self.sink.write(plane)
            self.sizes.append(len(plane))
            self.at += len(plane)
        self.n_ids += ids.size
        self.held, self.n_held = [], 0

    def close(self) -> None:
        """The last block, the documents, the chunk index and where both begin."""
        self._flush()
        parts = [np.array(self.docs, "<i8"), np.array(self.blocks, "<i8"), np.array(self.sizes, "<i8")]
        packed = [self.packer.compress(p.tobytes()) for p in parts]
        head = {"docs": len(self.docs), "blocks": len(self.blocks), "sizes": [len(p) for p in packed], "bits": self.bits, "ids": self.n_ids}
        tail = b"".join([*packed, json.dumps(head).encode()])
        self.sink.write(tail)
        self.sink.write(struct.pack("<QQ8s", self.at, len(tail) - sum(head["sizes"]), MAGIC))


class FileReader:
    """Reads one file by its chunk index."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - 24)
        at, head_size, magic = struct.unpack("<QQ8s", source.read(24))
        if magic != MAGIC:
            raise ValueError("not a file of id planes, or cut short")
        source.seek(at)
        tail = source.read(size - 24 - at)
        self.head = json.loads(tail[len(tail) - head_size :])
        unpack, parts, begin = zstandard.ZstdDecompressor(), [], 0
        for n in self.head["sizes"]:
            parts.append(np.frombuffer(unpack.decompress(tail[begin : begin + n]) if n else b"", "<i8"))
            begin += n
        self.docs, self.blocks, sizes = parts[0].reshape(-1, 3), parts[1].reshape(-1, len(BLOCK_FIELDS)), parts[2]
        self.plane_sizes = np.split(sizes, np.cumsum(self.blocks[:, 4])[:-1]) if len(self.blocks) else []

    def block(self, k: int) -> np.ndarray:
        at, _, n, crc, _ = self.blocks[k].tolist()
        sizes = self.plane_sizes[k].tolist()
        self.source.seek(at)
        raw, unpack, planes, begin = self.source.read(sum(sizes)), zstandard.ZstdDecompressor(), [], 0
        for size in sizes:
            planes.append(unpack.decompress(raw[begin : begin + size]))
            begin += size
        ids = from_planes(planes, n, self.head["bits"])
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError(f"block {k} is damaged")
        return ids

    def between(self, first: int, last: int) -> np.ndarray:
        """The ids from ``first`` up to ``last`` of this file; only their blocks are read."""
        first, last = max(first, 0), min(last, self.head["ids"])
        if first >= last:
            return np.empty(0, np.uint32)
        starts = self.blocks[:, 1]
        low, high = np.searchsorted(starts, first, "right") - 1, np.searchsorted(starts, last, "left")
        ids = np.concatenate([self.block(k) for k in range(low, high)])
        return ids[first - starts[low] : last - starts[low]]

    def documents(self) -> Iterator[tuple[int | None, int, bytes]]:
        """(doc_id, first id of the document in this file, its ids), block by block."""
        buffer, begin, k, at = np.empty(0, np.uint32), 0, 0, 0
        for doc_id, unknown, n in self.docs.tolist():
            parts = [buffer[at - begin : at - begin + n]]
            have = parts[0].size
            while have < n:
                buffer, begin = self.block(k), int(self.blocks[k][1])
                k += 1
                parts.append(buffer[: n - have])
                have += parts[-1].size
            yield None if unknown else doc_id, at, np.concatenate(parts).astype("<u4").tobytes()
            at += n


def _folder(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _Written(WriterCommitMessage):
    def __init__(self, part: int, name: str, n_docs: int, n_ids: int):
        self.part, self.name, self.n_docs, self.n_ids = part, name, n_docs, n_ids


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, bits: bool, block: int):
        self.path, self.bits, self.block = path, bits, block

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        part = TaskContext.get().partitionId()
        disk, folder = _folder(self.path)
        disk.create_dir(folder, recursive=True)
        name = f"part-{part:06d}-{uuid.uuid4().hex}.idp"
        with disk.open_output_stream(f"{folder}/{name}") as sink:
            out = FileWriter(sink, self.bits, self.block)
            for batch in iterator:
                for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    out.add(doc_id, ids)
            out.close()
        return _Written(part, name, len(out.docs), out.n_ids)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, docs, ids = [], 0, 0
        for m in sorted((m for m in messages if m is not None), key=lambda m: m.part):
            if m.n_docs:
                files.append({"name": m.name, "first_doc": docs, "first_id": ids, "n_docs": m.n_docs, "n_ids": m.n_ids})
                docs, ids = docs + m.n_docs, ids + m.n_ids
        disk, folder = _folder(self.path)
        disk.create_dir(folder, recursive=True)
        with disk.open_output_stream(f"{folder}/_manifest.json") as sink:
            sink.write(json.dumps({"block": self.block, "bits": self.bits, "n_docs": docs, "n_ids": ids, "files": files}).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        disk, folder = _folder(self.path)
        for m in messages:
            if m is not None:
                disk.delete_file(f"{folder}/{m.name}")


class _Part(InputPartition):
    def __init__(self, name: str, first_id: int):
        self.name, self.first_id = name, first_id


def manifest(path: str) -> dict:
    disk, folder = _folder(path)
    with disk.open_input_file(f"{folder}/_manifest.json") as source:
        return json.loads(source.read())


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [_Part(f["name"], f["first_id"]) for f in manifest(self.path)["files"]] or [_Part("", 0)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())]
        if not partition.name:
            return
        disk, folder = _folder(self.path)
        place = f"{folder}/{partition.name}"
        with disk.open_input_file(place) as source:
            rows = []
            for doc_id, at, ids in FileReader(source, disk.get_file_info(place).size).documents():
                rows.append((doc_id, partition.first_id + at, len(ids) // 4, ids))
                if len(rows) == GROUP:
                    yield pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, (_, k) in zip(zip(*rows), kinds)], schema=pa.schema(kinds))
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, (_, k) in zip(zip(*rows), kinds)], schema=pa.schema(kinds))


class IdPlanes(DataSource):
    """Format ``idplanes``: path, and for writing ``planes`` (byte or bit) and ``block`` (ids of a block)."""

    @classmethod
    def name(cls) -> str:
        return "idplanes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        kind = self.options.get("planes", "byte")
        if kind not in ("byte", "bit"):
            raise ValueError(f"planes are of bytes or bits, not {kind}")
        return _Writer(self.options["path"], kind == "bit", int(self.options.get("block", BLOCK)))


def write_planes(ids: DataFrame, path: str, planes: str = "byte", block: int = BLOCK) -> None:
    """Write (doc_id, ids) in the order of its partitions and of the rows in them; ``path`` is a fresh folder."""
    ids.sparkSession.dataSource.register(IdPlanes)
    ids.select("doc_id", "ids").write.format("idplanes").option("planes", planes).option("block", block).mode("append").save(path)


def read_planes(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids of every document; a task for each file."""
    spark.dataSource.register(IdPlanes)
    return spark.read.format("idplanes").load(path)


def ids_between(path: str, first: int, last: int) -> np.ndarray:
    """The ids from ``first`` up to ``last`` of the whole sequence, by the chunk indexes of their files."""
    disk, folder = _folder(path)
    out = [np.empty(0, np.uint32)]
    for f in manifest(path)["files"]:
        if f["first_id"] < last and f["first_id"] + f["n_ids"] > first:
            place = f"{folder}/{f['name']}"
            with disk.open_input_file(place) as source:
                out.append(FileReader(source, disk.get_file_info(place).size).between(first - f["first_id"], last - f["first_id"]))
    return np.concatenate(out)


def round_trip(docs: DataFrame, tokenizer: str, path: str, planes: str = "byte") -> DataFrame:
    """Encode, write and read again: doc_id, start, n_tokens and the CRC of the ids of every document."""
    write_planes(token_ids(docs, tokenizer), path, planes)
    return read_planes(docs.sparkSession, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
