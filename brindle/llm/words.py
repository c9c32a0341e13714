"""Hashes of words and of word shingles, a group of texts at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.random.default_rng(20_240_229).integers(1, 1 << 63, 256, np.uint64)
_PLACE = np.random.default_rng(20_240_301).integers(1, 1 << 63, 64, np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return x ^ (x >> np.uint64(33))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, CHUNK_BYTES + 4096), base, np.uint64)
            steps[0] = 1
            with np.errstate(over="ignore"):
                _powers[k] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def prefix_hashes(codes: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function from begins and ends within ``codes`` (bytes) to 64-bit hashes of what lies between, the same wherever it stands."""
    up, down = _power(len(codes) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTER[codes] * up[:-1])])

    def hashed(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((total[end] - total[begin]) * down[begin])

    return hashed


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each run of bytes other than ASCII white space, and where it begins. Equal words have equal hashes wherever they stand."""
    hashes, begins, a = [], [], 0
    while a < len(data):
        b = min(len(data), a + CHUNK_BYTES)
        while b < len(data) and data[b] not in b" \t\n\r\x0b\x0c":
            b += 1
        codes = np.frombuffer(data, np.uint8, b - a, a)
        space = _SPACE[codes]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).view(np.int8)))
        first, last = edge[::2], edge[1::2]
        hashes.append(prefix_hashes(codes)(first, last))
        begins.append(first + a)
        a = b
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(begins)


def grouped(sizes: Sequence[int], limit: int = CHUNK_BYTES) -> Iterator[slice]:
    """Slices of consecutive items of about ``limit`` together."""
    a = held = 0
    for i, n in enumerate(sizes):
        held += n
        if held >= limit:
            yield slice(a, i + 1)
            a, held = i + 1, 0
    if a < len(sizes):
        yield slice(a, len(sizes))


def parts(batch: pa.RecordBatch, text: int, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``limit`` bytes of its column ``text``."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    for part in grouped(sizes, limit):
        yield batch.slice(part.start, part.stop - part.start)


def parted(batch: pa.RecordBatch, text: int, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """The ``parts`` of a batch, with the texts of each; so few texts are Python objects at once."""
    for rows in parts(batch, text, limit):
        yield rows, rows.column(text).to_pylist()


def shingles(texts: Sequence[str | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts, one text after the other, and how many each has.

    Words are lower-cased runs of other than ASCII white space; a text of fewer
    than ``size`` words is one shingle, one without words has none.
    """
    data = [(t or "").lower().encode() for t in texts]
    hashes, begins = word_hashes(b"\n".join(data))
    ends = np.cumsum([len(d) + 1 for d in data])
    words = np.diff(np.searchsorted(begins, ends), prepend=0)
    doc = np.repeat(np.arange(len(data)), words)
    last = np.cumsum(words)
    with np.errstate(over="ignore"):
        n = max(0, len(hashes) - size + 1)
        rolled = np.zeros(n, np.uint64)
        for k in range(size):
            rolled += hashes[k : k + n] * _PLACE[k]
        whole = doc[:n] == doc[size - 1 : size - 1 + n]
        values, owner = mixed(rolled[whole]), doc[:n][whole]
        short = np.flatnonzero((words > 0) & (words < size))
        if len(short):
            extra = np.array([(hashes[last[i] - words[i] : last[i]] * _PLACE[: words[i]]).sum() + np.uint64(words[i]) for i in short], np.uint64)
            values, owner = np.concatenate([values, mixed(extra)]), np.concatenate([owner, short])
            order = np.argsort(owner, kind="stable")
            values, owner = values[order], owner[order]
    return values, np.bincount(owner, minlength=len(data))
