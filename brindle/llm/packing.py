"""Mixture-controlled packing by deficit round-robin.

Every source has a queue of tokens: those of its documents, one after the other.
Each window of ``size`` tokens is filled in turns: a source's deficit grows by
its share of the window, and it gives as many tokens as its deficit covers. What
it could not give, or gave beyond its share, stays in its deficit from window to
window. The queues are cut into partitions that are packed at the same time: a
partition holds of each queue what round-robin gives between two points of the
whole output, so it starts with the deficits that the partition before it ends
with, whichever files and in whatever order the documents lie.

Two passes. The first encodes texts; each task writes one file, in blocks whose
documents stand by source. The second packs partitions; it reads just the
ranges of the files that are its own, a block of each queue at a time. Neither
texts nor ids are shuffled. The manifest has one row for each file and source.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import open_fs, shared_dir
from .tokens import GROUP_CHARS, encoder
from .words import parted

SIZE = 2048
BLOCK_IDS = 2 << 20
PARTITION_IDS = 2 << 20
MANIFEST = "file string, part long, source string, tokens long"
PIECES = "doc_id long, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"


def _key(source: str | None) -> str:
    """A source as a key that is never null."""
    return "-" if source is None else f"+{source}"


def _unkey(key: str) -> str | None:
    return None if key == "-" else key[1:]


class _Writer:
    """A file of blocks; its footer says where each source's documents and ids lie in each block."""

    def __init__(self, stream, block_ids: int):
        self.stream, self.block_ids = stream, block_ids
        self.at, self.blocks, self.tokens = 0, [], {}
        self._clear()

    def _clear(self) -> None:
        self.held: dict[str, list[tuple[int | None, np.ndarray]]] = {}
        self.size = 0

    def add(self, doc_id: int | None, source: str, ids: np.ndarray) -> None:
        self.held.setdefault(source, []).append((doc_id, ids))
        self.size += len(ids)
        if self.size >= self.block_ids:
            self._flush()

    def _flush(self) -> None:
        block = {}
        for source, docs in self.held.items():
            lengths = np.array([len(ids) for _, ids in docs], "<i8")
            ids = np.concatenate([ids for _, ids in docs])
            # Ids below 65,536 take two bytes.
            width = 2 if ids.max() < 1 << 16 else 4
            parts = np.array([d or 0 for d, _ in docs], "<i8").tobytes(), np.array([d is None for d, _ in docs], "u1").tobytes(), lengths.tobytes(), ids.astype(f"<u{width}").tobytes()
            n = int(lengths.sum())
            block[source] = self.at, len(docs), n, width
            self.tokens[source] = self.tokens.get(source, 0) + n
            for p in parts:
                self.stream.write(p)
                self.at += len(p)
        self.blocks.append(block)
        self._clear()

    def close(self) -> None:
        if self.held:
            self._flush()
        footer = json.dumps(self.blocks).encode()
        self.stream.write(footer + struct.pack("<Q", len(footer)))
        self.stream.close()


class _Reader:
    """Ranges of a source's tokens in a file."""

    def __init__(self, fs, path: str):
        self.stream = fs.open_input_file(path)
        end = self.stream.size() - 8
        (n,) = struct.unpack("<Q", self.stream.read_at(8, end))
        self.blocks = json.loads(self.stream.read_at(n, end - n))

    def documents(self, source: str, low: int, high: int) -> Iterator[tuple[int | None, int, int, memoryview]]:
        """Document id, its tokens, and begin and ids of the part of it that lies in the range, a block at a time."""
        for block in self.blocks:
            if source not in block:
                continue
            at, docs, n, width = block[source]
            a, b = max(0, low), min(n, high)
            if a < b:
                ids, nulls, lengths = (np.frombuffer(self.stream.read_at(w * docs, at + o * docs), k) for k, w, o in (("<i8", 8, 0), ("u1", 1, 8), ("<i8", 8, 9)))
                end = np.cumsum(lengths)
                held = np.frombuffer(self.stream.read_at(width * (b - a), at + 17 * docs + width * a), f"<u{width}")
                data = memoryview(held.astype("<u4")).cast("B")
                for i in range(int(np.searchsorted(end, a, "right")), int(np.searchsorted(end, b - 1, "right")) + 1):
                    first = int(end[i] - lengths[i])
                    x, y = max(first, a), min(int(end[i]), b)
                    yield (None if nulls[i] else int(ids[i])), int(lengths[i]), x - first, data[4 * (x - a) : 4 * (y - a)]
            low, high = low - n, high - n
            if high <= 0:
                break


def write_blocks(docs: DataFrame, folder: str, tokenizer: str, end_id: int, block_ids: int = BLOCK_IDS) -> DataFrame:
    """First pass, over ``(doc_id, source, text)``; returns the manifest."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, (fs, base), out, name = encoder(tokenizer), open_fs(folder), None, f"{uuid.uuid4().hex}.ids"
        for batch in batches:
            for rows, texts in parted(batch, 2, GROUP_CHARS):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = _Writer(fs.open_output_stream(f"{base}/{name}"), block_ids)
                for doc, source, ids in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), encode.encode(texts)):
                    out.add(doc, _key(source), np.append(ids, np.uint32(end_id)))
        if out is not None:
            out.close()
            n = len(out.tokens)
            yield pa.RecordBatch.from_pydict({"file": [name] * n, "part": [TaskContext.get().partitionId()] * n, "source": list(out.tokens), "tokens": list(out.tokens.values())})

    docs.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def _phases(totals: dict[str, int], weights: Mapping[str, float]) -> list[tuple[float, float, dict[str, tuple[float, float]]]]:
    """Stretches of the output in which the same weighted sources still have tokens: begin, end, and of each its tokens before and its rate."""
    left, given, at, out = {s: float(n) for s, n in totals.items() if n and weights.get(s, 0) > 0}, dict.fromkeys(totals, 0.0), 0.0, []
    while left:
        weight = sum(weights[s] for s in left)
        rate = {s: weights[s] / weight for s in left}
        length = min(left[s] / rate[s] for s in left)
        out.append((at, at + length, {s: (given[s], rate[s]) for s in left}))
        for s in rate:
            given[s] += length * rate[s]
            left[s] -= length * rate[s]
        left = {s: n for s, n in left.items() if n > 0.5}
        at += length
    return out


def _between(x: Column, pieces: list[tuple[float, float, float, float]], last: Column) -> Column:
    """Piecewise linear: (from, to, value at from, slope) in order; ``last`` beyond."""
    out = None
    for low, high, value, slope in pieces:
        y = F.lit(value) + (x - F.lit(low)) * F.lit(slope)
        out = F.when(x < high, y) if out is None else out.when(x < high, y)
    return last if out is None else out.otherwise(last)


def plan(manifest: DataFrame, size: int, targets: Mapping[str | None, float] | None, partition_ids: int = PARTITION_IDS) -> tuple[DataFrame, int]:
    """``(partition, tokens, first_sequence, queues)`` and the number of partitions; a queue is (source, share, deficit, parts), a part (part, file, low, high)."""
    total = manifest.agg(F.sum("tokens")).first()[0] or 0
    n = max(1, -(-total // partition_ids))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = manifest.groupBy("source").agg(F.sum("tokens").alias("whole"))
    m = manifest.withColumn("begin", F.coalesce(F.sum("tokens").over(before), F.lit(0))).join(whole, "source")
    m = m.withColumn("end", F.col("begin") + F.col("tokens"))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    if targets is None:
        # All queues end together: a partition holds the same part of each.
        share = F.col("whole") / F.lit(float(total or 1))
        bound = lambda j: F.expr(f"cast((cast(whole as decimal(19,0)) * cast({j} as decimal(18,0))) div {n} as bigint)")
        guess = lambda c: F.floor(F.col(c) * F.lit(float(n)) / F.col("whole"))
        position = lambda j: F.col(j) * F.lit(total / n)
    else:
        weights = {_key(k): float(v) for k, v in targets.items()}
        if any(w < 0 for w in weights.values()):
            raise ValueError("targets must not be negative")
        totals = {r["source"]: r["whole"] for r in whole.where(F.col("source").isin([s for s, w in weights.items() if w > 0])).collect()}
        phases = _phases(totals, weights)
        weight = sum(weights.values()) or 1.0
        ends = phases[-1][1] if phases else 0.0
        rest = float(total - sum(totals.values())) or 1.0
        share, forward, back = F.lit(0.0), None, None
        position = lambda j: F.col(j) * F.lit(total / n)
        for s, w in totals.items():
            mine = [(a, b, *at[s]) for a, b, at in phases if s in at]
            share = F.when(F.col("source") == s, weights[s] / weight).otherwise(share)
            served = lambda x, mine=mine: F.least(F.col("whole"), F.floor(_between(x, mine, F.col("whole").cast("double"))))
            where = lambda c, mine=mine: _between(c, [(y, y + (b - a) * r, a, 1 / r) for a, b, y, r in mine], F.lit(mine[-1][1]))
            forward = (lambda f, s=s, served=served: lambda x: F.when(F.col("source") == s, served(x)).otherwise(f(x)))(forward or (lambda x: F.floor(F.greatest(x - F.lit(ends), F.lit(0.0)) * F.col("whole") / F.lit(rest))))
            back = (lambda f, s=s, where=where: lambda c: F.when(F.col("source") == s, where(c)).otherwise(f(c)))(back or (lambda c: F.lit(ends) + c * F.lit(rest) / F.col("whole")))
        forward = forward or (lambda x: F.floor(x * F.col("whole") / F.lit(rest)))
        back = back or (lambda c: c * F.lit(rest) / F.col("whole"))
        bound = lambda j: F.when(F.expr(f"({j}) >= {n}"), F.col("whole")).otherwise(F.least(F.col("whole"), forward(F.expr(j) * F.lit(total / n)))).cast("long")
        guess = lambda c: F.floor(back(F.col(c).cast("double")) * F.lit(n / (total or 1)))
    low, high = F.greatest(guess("begin") - 1, F.lit(0)), F.least(guess("end") + 1, F.lit(n - 1))
    cut = m.withColumn("partition", F.explode(F.sequence(low.cast("long"), F.greatest(low, high).cast("long"))))
    cut = cut.withColumn("first", bound("partition")).withColumn("last", bound("partition + 1"))
    cut = cut.withColumn("low", F.greatest("first", "begin")).withColumn("high", F.least("last", "end")).where("low < high")
    part = F.struct("part", "file", (F.col("low") - F.col("begin")).alias("low"), (F.col("high") - F.col("begin")).alias("high"))
    queues = cut.groupBy("partition", "source").agg(F.collect_list(part).alias("parts"), F.sum(F.col("high") - F.col("low")).alias("tokens"), F.first(share).alias("share"), F.first(share * position("partition") - F.col("first")).alias("deficit"))
    rows = queues.groupBy("partition").agg(F.sum("tokens").alias("tokens"), F.collect_list(F.struct("source", "share", "deficit", "parts")).alias("queues"))
    sequences = F.expr(f"tokens div {size} + bit_count(tokens % {size})")
    first = F.coalesce(F.sum(sequences).over(Window.orderBy("partition").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.select("partition", "tokens", first.alias("first_sequence"), "queues"), n


class Packer:
    """Deficit round-robin over the queues of one partition."""

    def __init__(self, size: int, left: Mapping[str, int], share: Mapping[str, float], deficit: Mapping[str, float]):
        self.size, self.left, self.share, self.deficit = size, dict(left), dict(share), dict(deficit)
        rest = sum(left.values()) % size
        self.lengths = [size] * (sum(left.values()) // size) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]

    def windows(self) -> Iterator[tuple[int, list[tuple[str, int]]]]:
        """Number of each sequence, and what each source gives to it, in turn."""
        for number, length in enumerate(self.lengths):
            yield number, self._fill(number, length)

    def _fill(self, number: int, room: int) -> list[tuple[str, int]]:
        names = [s for s in self.share if self.left[s]]
        names = names[number % len(names) :] + names[: number % len(names)]
        for s in names:
            self.deficit[s] += self.share[s] * room
        given: dict[str, int] = {}
        need = room
        for s in names:
            # A debt is paid over several windows: at most twice the share in one.
            n = min(int(self.deficit[s]), self.left[s], need, int(2 * self.share[s] * room) + 1)
            if n > 0:
                given[s] = n
                need -= n
        while need:
            # Fractions and dry queues leave room; the others fill it by their shares and go into debt.
            able = [s for s in names if self.left[s] > given.get(s, 0)]
            weight, asked = sum(self.share[s] for s in able), need
            for s in sorted(able, key=lambda s: -self.deficit[s] + given.get(s, 0)):
                n = min(self.left[s] - given.get(s, 0), need, max(1, int(asked * (self.share[s] / weight if weight else 1 / len(able)))))
                given[s] = given.get(s, 0) + n
                need -= n
                if not need:
                    break
        for s, n in given.items():
            self.deficit[s] -= n
            self.left[s] -= n
        return list(given.items())


def _ranges(open_reader: Callable[[str], _Reader], source: str, parts: list[tuple[int, str, int, int]]) -> Iterator[tuple[int | None, int, int, memoryview]]:
    for _, file, low, high in parts:
        yield from open_reader(file).documents(source, low, high)


def _taken(documents: Iterator[tuple[int | None, int, int, memoryview]]) -> Iterator[tuple[int | None, int, int, memoryview]]:
    """Pieces of a queue; is sent how many tokens the next may have at most."""
    most = yield None, 0, 0, memoryview(b"")
    for doc, tokens, begin, data in documents:
        while len(data):
            n = min(most, len(data) // 4)
            piece, data = data[: 4 * n], data[4 * n :]
            most = yield doc, tokens, begin, piece
            begin += n


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = SIZE, targets: Mapping[str | None, float] | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", folder: str | None = None, block_ids: int = BLOCK_IDS, partition_ids: int = PARTITION_IDS) -> DataFrame:
    """Pieces as ``PIECES``: every id of every document lies in exactly one.

    A document is the ids of its whole text (null: none), then ``end_id``.
    Sequences have ``size`` tokens (a power of two); the last ones of each
    partition have falling powers of two, so nothing is padded. ``targets``
    weighs the sources in a window while they last (unnamed ones come after
    these); without it each source's share of all tokens is its target. Null is
    a source like any other, null and repeated ids are kept, an empty table has
    no pieces. Other columns are not read.
    """
    if size < 1 or size & (size - 1):
        raise ValueError("size must be a power of two")
    folder = folder or shared_dir(docs.sparkSession, "packing")
    columns = [F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), F.col(f"`{text_col}`").cast("string").alias("text")]
    manifest = write_blocks(docs.select(*columns), folder, tokenizer, end_id, block_ids)
    queued, partitions = plan(manifest, size, targets, partition_ids)
    kinds = {"long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in PIECES.split(", "))])

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        for batch in batches:
            for row in batch.to_pylist():
                rows: list[tuple] = []
                queues = sorted(row["queues"], key=lambda q: q["source"])
                takers, readers = {}, {}

                def open_reader(file: str, readers: dict = readers) -> _Reader:
                    if file not in readers:
                        readers[file] = _Reader(fs, f"{base}/{file}")
                    return readers[file]

                for q in queues:
                    parts = sorted((p["part"], p["file"], p["low"], p["high"]) for p in q["parts"])
                    takers[q["source"]] = _taken(_ranges(open_reader, q["source"], parts))
                    next(takers[q["source"]])
                packer = Packer(size, {q["source"]: sum(p["high"] - p["low"] for p in q["parts"]) for q in queues}, {q["source"]: q["share"] for q in queues}, {q["source"]: q["deficit"] for q in queues})
                for number, given in packer.windows():
                    offset = 0
                    for source, n in given:
                        while n:
                            doc, tokens, begin, data = takers[source].send(n)
                            k = len(data) // 4
                            rows.append((doc, _unkey(source), begin, k, zlib.crc32(data), tokens, row["first_sequence"] + number, offset, packer.lengths[number]))
                            offset, n = offset + k, n - k
                    if len(rows) >= 20_000:
                        yield made(rows)
                        rows = []
                if rows:
                    yield made(rows)

    return queued.repartition(partitions).mapInArrow(run, PIECES)
