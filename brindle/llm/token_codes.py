"""Token ids in files of directly addressable codes.

Ids are ranked by frequency within a segment, and each rank is cut into 8-bit
chunks. Level k holds the k-th chunk of every id that has one, a bitmap telling
which ids go on to level k + 1, and a rank directory (ones before every 512th
bit) that gives an id's place there. Any token is found by one look at each
level, no block is decoded.

File: segments, then a footer of their offsets. Segment, little-endian:
``BDAC``, u32 levels, u64 ids, u64 documents, u32 size of the alphabet; the
alphabet (u32, by falling frequency); document ids (i64), null flags (u8) and
ends (u64, in ids of the segment); for each level u64 chunks, the chunks (u8),
the bitmap (u8, lowest bit first) and the directory (u64). Footer: u64 offset
of each segment, u64 ids before each segment, u32 segments, ``BDAF``.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import open_fs
from .tokens import GROUP_CHARS, encoder
from .words import parted

SEGMENT_IDS = 2 << 20
RANK_BITS = 512
TABLE_IDS = 1 << 20
MANIFEST = "file string, part long, ids long, documents long"
HEAD = struct.Struct("<4sIQQI")


class Level:
    """Chunks, continuation bitmap and rank directory of one level."""

    def __init__(self, chunks: np.ndarray, bitmap: np.ndarray, directory: np.ndarray):
        self.chunks, self.bitmap, self.directory = chunks, bitmap, directory

    @classmethod
    def of(cls, chunks: np.ndarray, more: np.ndarray) -> Level:
        bits = np.zeros(-(-len(more) // RANK_BITS) * RANK_BITS, bool)
        bits[: len(more)] = more
        ones = bits.reshape(-1, RANK_BITS).sum(axis=1)
        return cls(chunks.astype(np.uint8), np.packbits(bits, bitorder="little"), (np.cumsum(ones) - ones).astype("<u8"))

    def rank(self, i: int) -> int:
        """Ones before bit ``i``."""
        block = i // RANK_BITS
        if block >= len(self.directory):
            block = len(self.directory) - 1
        ones = np.unpackbits(self.bitmap[block * (RANK_BITS // 8) : -(-i // 8)], bitorder="little")
        return int(self.directory[block]) + int(ones[: i - block * RANK_BITS].sum())

    def bits(self, a: int, b: int) -> np.ndarray:
        return np.unpackbits(self.bitmap[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a].astype(bool)


class Segment:
    """Ids of some documents, each token addressable."""

    def __init__(self, alphabet: np.ndarray, levels: list[Level], doc_ids: np.ndarray, nulls: np.ndarray, ends: np.ndarray):
        self.alphabet, self.levels, self.doc_ids, self.nulls, self.ends = alphabet, levels, doc_ids, nulls, ends

    @classmethod
    def of(cls, ids: np.ndarray, doc_ids: list[int | None], lengths: list[int]) -> Segment:
        times = np.bincount(ids) if len(ids) and ids.max() < TABLE_IDS else None
        if times is None:
            known, at, times = np.unique(ids, return_inverse=True, return_counts=True)
        else:
            known, at = np.flatnonzero(times), ids
            times = times[known]
        order = np.argsort(-times, kind="stable")
        place = np.zeros(len(known) if at is not ids else int(known[-1]) + 1, np.uint32)
        place[order if at is not ids else known[order]] = np.arange(len(known), dtype=np.uint32)
        rest, levels = place[at], []
        while len(rest):
            more = rest > 255
            levels.append(Level.of(rest & 255, more))
            rest = rest[more] >> 8
        nulls = np.array([d is None for d in doc_ids], np.uint8)
        return cls(known[order].astype("<u4"), levels, np.array([d or 0 for d in doc_ids], "<i8"), nulls, np.cumsum(lengths).astype("<u8"))

    def __len__(self) -> int:
        return len(self.levels[0].chunks) if self.levels else 0

    def __getitem__(self, i: int) -> int:
        """The id at place ``i``: one look at each level it reaches."""
        value = shift = 0
        for level in self.levels:
            value |= int(level.chunks[i]) << shift
            if not level.bits(i, i + 1)[0]:
                break
            i, shift = level.rank(i), shift + 8
        return int(self.alphabet[value])

    def ids(self, a: int, b: int) -> np.ndarray:
        """The ids from place ``a`` up to ``b``; only their own chunks are touched."""
        out = np.zeros(b - a, np.uint32)
        where: np.ndarray | slice = slice(None)
        places = np.arange(b - a)
        for shift, level in enumerate(self.levels):
            if b <= a:
                break
            out[where] |= level.chunks[a:b].astype(np.uint32) << np.uint32(8 * shift)
            more = level.bits(a, b)
            places = places[more]
            where = places
            a = level.rank(a) if len(places) else 0
            b = a + len(places)
        return self.alphabet[out]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Document id, place of its first id, its ids."""
        begin = 0
        for doc, null, end in zip(self.doc_ids.tolist(), self.nulls.tolist(), self.ends.tolist()):
            yield None if null else doc, begin, self.ids(begin, end)
            begin = end

    def dump(self) -> bytes:
        parts = [HEAD.pack(b"BDAC", len(self.levels), len(self), len(self.doc_ids), len(self.alphabet)), self.alphabet, self.doc_ids, self.nulls, self.ends]
        for x in self.levels:
            parts += [struct.pack("<Q", len(x.chunks)), x.chunks, x.bitmap, x.directory]
        return b"".join(x if isinstance(x, bytes) else x.tobytes() for x in parts)

    @classmethod
    def load(cls, data: bytes) -> Segment:
        magic, levels, _, docs, letters = HEAD.unpack_from(data)
        if magic != b"BDAC":
            raise ValueError("no segment of token ids")
        at = HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        head = take("<u4", letters), take("<i8", docs), take("u1", docs), take("<u8", docs)
        found = []
        for _ in range(levels):
            n = int(take("<u8", 1)[0])
            blocks = -(-n // RANK_BITS)
            found.append(Level(take("u1", n), take("u1", blocks * RANK_BITS // 8), take("<u8", blocks)))
        return cls(head[0], found, *head[1:])


class SegmentView:
    """Tokens of a segment in a file: each is found by small reads, one set for each level it reaches."""

    def __init__(self, stream, offset: int):
        self.stream = stream
        magic, levels, self.size, docs, letters = HEAD.unpack(stream.read_at(HEAD.size, offset))
        if magic != b"BDAC":
            raise ValueError("no segment of token ids")
        self.alphabet = at = offset + HEAD.size
        at += 4 * letters + 17 * docs
        #: Of each level where its chunks, bitmap and directory lie.
        self.levels: list[tuple[int, int, int]] = []
        for _ in range(levels):
            (n,) = struct.unpack("<Q", stream.read_at(8, at))
            blocks = -(-n // RANK_BITS)
            self.levels.append((at + 8, at + 8 + n, at + 8 + n + blocks * RANK_BITS // 8))
            at = self.levels[-1][2] + 8 * blocks

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.size:
            raise IndexError(i)
        value = shift = 0
        for chunks, bitmap, directory in self.levels:
            value |= self.stream.read_at(1, chunks + i)[0] << shift
            block = i // RANK_BITS
            # The bits of the block up to this one's byte.
            first = block * (RANK_BITS // 8)
            bits = np.unpackbits(np.frombuffer(self.stream.read_at(i // 8 - first + 1, bitmap + first), np.uint8), bitorder="little")
            if not bits[i - block * RANK_BITS]:
                break
            (before,) = struct.unpack("<Q", self.stream.read_at(8, directory + 8 * block))
            i, shift = before + int(bits[: i - block * RANK_BITS].sum()), shift + 8
        return struct.unpack("<I", self.stream.read_at(4, self.alphabet + 4 * value))[0]


class FileWriter:
    """Appends documents to one file, a segment at a time."""

    def __init__(self, stream, segment_ids: int = SEGMENT_IDS):
        self.stream, self.segment_ids = stream, segment_ids
        self.offsets: list[int] = []
        self.before: list[int] = []
        self.at = self.total = self.docs = 0
        self._clear()

    def _clear(self) -> None:
        self.ids: list[np.ndarray] = []
        self.doc_ids: list[int | None] = []
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(ids)
        self.doc_ids.append(doc_id)
        self.held += len(ids)
        if self.held >= self.segment_ids:
            self._flush()

    def _flush(self) -> None:
        data = Segment.of(np.concatenate(self.ids), self.doc_ids, [len(x) for x in self.ids]).dump()
        self.offsets.append(self.at)
        self.before.append(self.total)
        self.stream.write(data)
        self.at, self.total, self.docs = self.at + len(data), self.total + self.held, self.docs + len(self.doc_ids)
        self._clear()

    def close(self) -> None:
        if self.doc_ids:
            self._flush()
        self.stream.write(np.array(self.offsets + self.before, "<u8").tobytes() + struct.pack("<I4s", len(self.offsets), b"BDAF"))
        self.stream.close()


class TokenFile:
    """A file of segments: one token by a few small reads, documents by whole segments, one held at a time."""

    def __init__(self, fs, path: str):
        self.stream = fs.open_input_file(path)
        size = self.stream.size()
        n, magic = struct.unpack("<I4s", self.stream.read_at(8, size - 8))
        if magic != b"BDAF":
            raise ValueError("no file of token ids")
        table = np.frombuffer(self.stream.read_at(16 * n, size - 8 - 16 * n), "<u8")
        self.offsets, self.before, self.end = table[:n].tolist(), table[n:], size - 8 - 16 * n
        self.total = sum(len(SegmentView(self.stream, x)) for x in self.offsets[-1:]) + (int(self.before[-1]) if n else 0)
        self.loaded: tuple[int, Segment] | None = None
        self.views: dict[int, SegmentView] = {}

    def segment(self, k: int) -> Segment:
        if self.loaded is None or self.loaded[0] != k:
            end = self.offsets[k + 1] if k + 1 < len(self.offsets) else self.end
            self.loaded = k, Segment.load(self.stream.read_at(end - self.offsets[k], self.offsets[k]))
        return self.loaded[1]

    def __len__(self) -> int:
        return self.total

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.total:
            raise IndexError(i)
        k = int(np.searchsorted(self.before, i, "right")) - 1
        if k not in self.views:
            self.views[k] = SegmentView(self.stream, self.offsets[k])
        return self.views[k][i - int(self.before[k])]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        for k in range(len(self.offsets)):
            base = int(self.before[k])
            for doc, begin, ids in self.segment(k).documents():
                yield doc, base + begin, ids


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Encode every text, append ``end_id``, write files in ascending order of ids; returns the manifest.

    A null text is empty; null ids come first; of rows with equal ids the order
    is by hash of their text, and equal rows stay repeated. Rows are dealt by
    ranges of (id, hash), so even an id that many rows share is spread. An
    empty table makes no files. Other columns are not read.
    """
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    keys = F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()
    d = d.repartitionByRange(*keys).sortWithinPartitions(*keys)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, (fs, base), out, name = encoder(tokenizer), open_fs(folder), None, f"{uuid.uuid4().hex}.bdac"
        for batch in batches:
            for rows, texts in parted(batch, 1, GROUP_CHARS):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = FileWriter(fs.open_output_stream(f"{base}/{name}"), segment_ids)
                for doc, ids in zip(rows.column(0).to_pylist(), encode.encode(texts)):
                    out.add(doc, np.append(ids, np.uint32(end_id)))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "part": [TaskContext.get().partitionId()], "ids": [out.total], "documents": [out.docs]})

    d.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return d.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32, file)`` of each document, from the files.

    ``start`` counts the ids of all documents before it: those of earlier files
    come from the manifest, one row a file.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = max(1, manifest.count())
    manifest = manifest.select("file", before.alias("before")).repartition(files)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        for batch in batches:
            for file, first in zip(*[c.to_pylist() for c in batch.columns]):
                rows: list[tuple] = []
                for doc, start, ids in TokenFile(fs, f"{base}/{file}").documents():
                    rows.append((doc, first + start, len(ids), crc(ids), file))
                    if len(rows) >= 10_000:
                        yield _rows(rows)
                        rows = []
                if rows:
                    yield _rows(rows)

    return manifest.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, file string")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "start", "n_tokens", "ids_crc32", "file"])
