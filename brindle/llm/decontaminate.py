"""Benchmark passages in documents, by q-gram lemma filtering and banded alignment.

Within ``e`` edits a passage of ``m`` characters keeps at least
``m + 1 - q - q * e`` of its q-grams, all on diagonals (place in the document
minus place in the passage) that differ by ``e`` at most. So q-grams shared
with a passage are counted in bands of diagonals, of width ``2 (e + 1)`` and
overlapping by half; only bands that reach the bound can hold a match, and a
banded alignment decides about those.

A passage has grams of ``q`` characters, or of as many as let its bound be
positive; so short ones, down to a single letter, are found as well, the
shortest by equality.

Texts are compared lower-cased with every run of characters other than letters
and digits as one space. The benchmark is a set of queries against all documents:
tasks write it into the shared folder as indexes of about ``block_chars``
characters, and each task of one scan of the documents holds some of its texts
and one index at a time. Neither the driver nor a broadcast holds passages, and
documents are never shuffled.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import loaded, open_fs, shared_dir, with_string
from .words import parts

Q = 12
EDIT_RATE = 0.05
BLOCK_CHARS = 8 << 20
WINDOW_CHARS = 4 << 20
#: Texts a task holds while it goes through several indexes, in bytes; postings counted at once.
HELD_BYTES = 64 << 20
POSTINGS = 4 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)
SPACE = 32


@lru_cache(maxsize=1)
def _fold() -> np.ndarray:
    """Code point to its lower case, 32 for whatever is neither letter nor digit."""
    out = np.full(0x110000, SPACE, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalnum():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def windows(text: str, overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Characters compared (uint32, a space at both ends of the text) and the place of each in the text.

    A text of over ``WINDOW_CHARS`` comes in windows that share at least
    ``overlap`` of the characters compared.
    """
    codes, places, blank = [np.full(1, SPACE, np.uint32)], [np.zeros(1, np.int64)], True
    held = 1
    for a in range(0, max(1, len(text)), WINDOW_CHARS):
        here = _fold()[np.frombuffer(text[a : a + WINDOW_CHARS].encode("utf-32-le", "surrogatepass"), "<u4")]
        space = here == SPACE
        keep = ~space | ~np.concatenate([[blank], space[:-1]]) if len(here) else space
        blank = bool(space[-1]) if len(here) else blank
        codes.append(here[keep])
        places.append(np.flatnonzero(keep) + a)
        held += len(codes[-1])
        last = a + WINDOW_CHARS >= len(text)
        if last and not blank:
            codes.append(np.full(1, SPACE, np.uint32))
            places.append(np.full(1, max(0, len(text) - 1), np.int64))
        if last or held > WINDOW_CHARS + overlap:
            window = np.concatenate(codes), np.concatenate(places)
            yield window
            codes, places = ([x[max(0, len(x) - overlap) :]] for x in window)
            held = len(codes[0])


def normalised(text: str) -> tuple[np.ndarray, np.ndarray]:
    """All characters compared, and their places."""
    found = list(windows(text, 0))
    return np.concatenate([c for c, _ in found]), np.concatenate([p for _, p in found])


def grams(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q-gram at each place."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    # Doubling: h2k[i] = hk[i] * base^k + hk[i + k]
    part, size, out, done = codes.astype(np.uint64) + np.uint64(1), 1, None, 0
    power = {1: _BASE}
    left = q
    with np.errstate(over="ignore"):
        while left:
            if left & 1:
                out = part[: n] if out is None else out[:n] * power[size] + part[done : done + n]
                done += size
            left >>= 1
            if left:
                part = part[: len(part) - size] * power[size] + part[size:]
                power[2 * size] = power[size] * power[size]
                size *= 2
        out = out[:n] * _MIX
        return (out ^ (out >> np.uint64(29))) * _MIX


class Index:
    """The q-grams of some passages, by hash, with their budgets."""

    def __init__(self, q: int, of: list[int], codes: list[np.ndarray], edits: np.ndarray):
        self.q, self.of, self.edits = q, np.array(of, np.int64), edits
        self.sizes = np.array([len(c) for c in codes], np.int64)
        self.bound = self.sizes + 1 - q - q * edits
        found = [grams(c, q) for c in codes]
        hashes = np.concatenate(found)
        item = np.repeat(np.arange(len(found)), [len(x) for x in found])
        place = np.concatenate([np.arange(len(x)) for x in found])
        order = np.argsort(hashes, kind="stable")
        hashes, self.item, self.place = hashes[order], item[order], place[order]
        self.keys, self.first, self.times = np.unique(hashes, return_index=True, return_counts=True)
        self.bits = max(16, min(26, int(len(self.keys) * 16).bit_length()))
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[(self.keys >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def shared(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Place in ``codes``, passage and place in it, of each q-gram that both have; about ``POSTINGS`` at once."""
        h = grams(codes, self.q)
        at = np.flatnonzero(self.seen[(h >> np.uint64(64 - self.bits)).astype(np.int64)])
        key = np.searchsorted(self.keys, h[at])
        same = key < len(self.keys)
        same[same] = self.keys[key[same]] == h[at[same]]
        at, key = at[same], key[same]
        total = np.cumsum(self.times[key])
        if not len(at) or total[-1] < self.bound.min():
            return
        cuts = np.searchsorted(total, np.arange(POSTINGS, int(total[-1]), POSTINGS))
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)]):
            some, times = key[low:high], self.times[key[low:high]]
            posting = np.repeat(self.first[some] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
            yield np.repeat(at[low:high], times), self.item[posting], self.place[posting]

    def bands(self, codes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Passage, and the least and largest diagonal, of each band that reaches the bound."""
        longest = int(self.sizes.max())
        counted: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
        for at, item, place in self.shared(codes):
            step = self.edits[item] + 1
            for half in (0, 1):
                band = (at - place + longest + half * step) // (2 * step)
                counted[half].append(np.unique(item * np.int64(1 << 40) + band, return_counts=True))
        for half, some in enumerate(counted):
            if not some:
                continue
            keys, inverse = np.unique(np.concatenate([k for k, _ in some]), return_inverse=True)
            times = np.bincount(inverse, np.concatenate([t for _, t in some])).astype(np.int64)
            which = keys >> 40
            enough = times >= self.bound[which]
            for k, i in zip(keys[enough].tolist(), which[enough].tolist()):
                s = int(self.edits[i]) + 1
                low = (k & ((1 << 40) - 1)) * 2 * s - half * s - longest
                yield int(self.of[i]), low, low + 2 * s - 1


class Passages:
    """A block of passages: name, characters and edit budget of each, and an index for each length of grams."""

    def __init__(self, items: Sequence[tuple[int | None, str | None]], q: int = Q, edit_rate: float = EDIT_RATE):
        self.names, self.codes = [], []
        for name, text in items:
            codes = normalised(text or "")[0]
            if len(codes) > 1:
                self.names.append(name)
                self.codes.append(codes)
        self.sizes = np.array([len(c) for c in self.codes], np.int64)
        self.edits = (self.sizes * edit_rate).astype(np.int64)
        # The bound must stay positive for the filter to lose nothing.
        lengths = np.minimum(q, self.sizes // (self.edits + 1))
        self.indexes = []
        for n in np.unique(lengths).tolist():
            of = np.flatnonzero(lengths == n).tolist()
            self.indexes.append(Index(n, of, [self.codes[i] for i in of], self.edits[of]))

    def bands(self, codes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        for index in self.indexes:
            yield from index.bands(codes)


def _exact(passage: np.ndarray, text: np.ndarray) -> int | None:
    want, data, at = passage.tobytes(), text.tobytes(), -1
    while (at := data.find(want, at + 1)) >= 0:
        if at % 4 == 0:
            return at // 4
    return None


def aligned(passage: np.ndarray, text: np.ndarray, low: int, high: int, edits: int) -> tuple[int, int, int] | None:
    """Least edits, begin and end in ``text`` of the passage aligned on diagonals from ``low`` to ``high``, ``edits`` more on both sides; None beyond ``edits``."""
    low, high = low - edits, high + edits
    width, n = high - low + 1, len(text)
    at = _exact(passage, text)
    if at is not None and low <= at <= high:
        return 0, at, at + len(passage)
    steps = np.arange(width)
    far = np.int64(1 << 60)
    # Cell d of row i: passage[:i] against text up to i + low + d; the low bits carry the begin.
    columns = low + steps
    inside = (columns >= 0) & (columns <= n)
    scale = np.int64(1) << 32
    row = np.where(inside, columns, far)
    for i in range(1, len(passage) + 1):
        columns = columns + 1
        inside = (columns >= 0) & (columns <= n)
        char = text[np.clip(columns - 1, 0, n - 1)]
        cross = row + np.where((char == passage[i - 1]) & (columns >= 1), 0, scale)
        down = np.append(row[1:], far) + scale
        row = np.where(inside, np.minimum(cross, down), far)
        row = np.minimum.accumulate(row - steps * scale) + steps * scale
        if (row.min() >> 32) > edits:
            return None
    best = int(row.argmin())
    cost, begin = int(row[best] >> 32), int(row[best] & (scale - 1))
    return (cost, begin, int(columns[best])) if cost <= edits else None


def find(text: str, passages: Passages) -> list[tuple[int, int, int, int]]:
    """``(passage, edits, start, end)`` of the best match of each passage in a text, places in the text."""
    best: dict[int, tuple[int, int, int]] = {}
    for codes, places in windows(text, int((passages.sizes + 2 * passages.edits).max(initial=0)) * 2):
        for i, low, high in passages.bands(codes):
            passage, e = passages.codes[i], int(passages.edits[i])
            begin, end = max(0, low - e), min(len(codes), high + e + len(passage))
            found = aligned(passage, codes[begin:end], low - begin, high - begin, e)
            if found:
                # Without the spaces at both ends.
                first, last = places[min(begin + found[1] + 1, len(places) - 1)], places[max(0, begin + found[2] - 2)]
                match = found[0], int(first), int(last) + 1
                best[i] = min(best.get(i, match), match)
    return [(i, *m) for i, m in sorted(best.items())]


def write_blocks(benchmark: DataFrame, item_col: str, item_text_col: str, q: int, edit_rate: float, block_chars: int) -> list[str]:
    """Index the passages in files of about ``block_chars`` characters in the shared folder; returns the files, of which the result has one name each."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("item_id"), F.col(f"`{item_text_col}`").cast("string").alias("text")).where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    folder = shared_dir(spark, "passages")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, str]] = []

        def saved() -> pa.RecordBatch:
            fs, base = open_fs(folder)
            fs.create_dir(base, recursive=True)
            name = f"{uuid.uuid4().hex}.passages"
            with fs.open_output_stream(f"{base}/{name}") as out:
                pickle.dump(Passages(held, q, edit_rate), out, protocol=5)
            return pa.RecordBatch.from_pydict({"file": [name]})

        chars = 0
        for batch in batches:
            for rows in parts(batch, 1):
                for item in zip(*[c.to_pylist() for c in rows.columns]):
                    held.append(item)
                    chars += len(item[1])
                    if chars >= block_chars:
                        yield saved()
                        held, chars = [], 0
        if held:
            yield saved()

    # Dealt in turns: passages that repeat don't meet in one task.
    found = items.repartition(max(1, -(-size // block_chars))).mapInArrow(write, "file string")
    return sorted(f"{folder}/{r['file']}" for r in found.collect())


def _searcher(files: list[str], at: int, done: Callable[[pa.RecordBatch, list[list[tuple]]], pa.RecordBatch | None]):
    """A function for ``mapInArrow``: ``done`` gets rows and, for each, the names and matches of the passages in column ``at``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = loaded(files[0]) if len(files) == 1 else None
        held: list[pa.RecordBatch] = []
        size = 0

        def searched() -> Iterator[pa.RecordBatch]:
            found: list[list[list[tuple]]] = [[[] for _ in range(rows.num_rows)] for rows in held]
            for file in files:
                passages = only or loaded(file)
                for rows, hits in zip(held, found):
                    for text, mine in zip(rows.column(at).to_pylist(), hits):
                        if text:
                            mine += [(passages.names[i], *m) for i, *m in find(text, passages)]
            for rows, hits in zip(held, found):
                if (out := done(rows, hits)) is not None:
                    yield out

        for batch in batches:
            for rows in parts(batch, at):
                held.append(rows)
                size += rows.column(at).nbytes
                if only is not None or size >= HELD_BYTES:
                    yield from searched()
                    held, size = [], 0
        if held:
            yield from searched()

    return run


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", q: int = Q, edit_rate: float = EDIT_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(doc_id, item_id, edits, start, end)``: the best match of each benchmark passage in each document that has it.

    ``edits`` is at most ``edit_rate`` of the passage's characters, rounded
    down; places count code points of the document's text. Of matches with equal
    edits the first counts. Null and empty texts match nothing, nor do passages
    without a letter or digit. Null ids stay null, repeated documents and items
    give repeated rows, an empty table gives none. Other columns are not read.
    """
    files = write_blocks(benchmark, item_col, item_text_col, q, edit_rate, block_chars)
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def listed(rows: pa.RecordBatch, hits: list[list[tuple]]) -> pa.RecordBatch | None:
        found = [(doc, *m) for doc, mine in zip(rows.column(0).to_pylist(), hits) for m in mine]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["doc_id", "item_id", "edits", "start", "end"]) if found else None

    return d.mapInArrow(_searcher(files, 1, listed), "doc_id long, item_id long, edits long, start long, end long")


def without(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", q: int = Q, edit_rate: float = EDIT_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` in which no passage of ``benchmark`` matches, with all columns; nothing is shuffled.

    Null and empty texts stay, and so does all with an empty benchmark. Each row
    is judged by its text alone, so repeated rows share their fate; null ids
    don't matter, and columns may have any names. An empty table stays empty.
    """
    files = write_blocks(benchmark, item_col, item_text_col, q, edit_rate, block_chars)
    d, name = with_string(docs, text_col)
    kept = d.mapInArrow(_searcher(files, d.columns.index(name), lambda rows, hits: rows.filter(pa.array([not h for h in hits], pa.bool_()))), d.schema)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
