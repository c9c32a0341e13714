"""Byte-level BPE by the ``tokenizers`` library, with the ids of recurring words kept.

Such a tokenizer cuts a text before every space that stands before a word, and
around a line break between words, whatever the rest of the text is. So the ids
of a word depend on the word alone, and the library need see each word once.
Words are found by a 64-bit hash of their bytes, in array operations on many
texts together, and their bytes are compared with those kept. Texts for which that does not hold (runs of white space,
white space other than space and line feed, very long words) are encoded by the
library whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np

from .words import prefix_hashes

GROUP_CHARS = 1 << 19
MAX_WORDS = 600_000
LONG_WORD = 200
WORDS_A_CALL = 256
_CUT = re.compile(r" (?=\S)")


class Encoder:
    """``add_special_tokens=False``; strings of special tokens are ordinary text.

    Holds the ids of about ``max_words`` words; beyond that it forgets those
    that have not come again.
    """

    def __init__(self, path: str, max_words: int = MAX_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.feed = self._whole(["\n"])[0].tolist()
        self.marks = {c: int(ids[0]) for c, ids in zip(",.", self._whole(",.")) if len(ids) == 1}
        self.by_words = len(self.feed) == 1 and self._cuts_as_expected(path)
        self.max_words = max_words
        self._clear()

    def _cuts_as_expected(self, path: str) -> bool:
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        cut = said.get("pre_tokenizer") or {}
        return said.get("normalizer") is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")

    def _whole(self, texts: Sequence[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.library.encode_batch_fast(list(texts), add_special_tokens=False)]

    def _clear(self) -> None:
        # Record 0 is for words whose text is to be encoded whole.
        self.keys, self.record = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.start, self.count, self.uses = (np.zeros(1 << 12, np.int32) for _ in range(3))
        self.flat, self.used, self.words = np.zeros(1 << 14, np.uint32), 0, 1
        # The bytes of each record's word.
        self.raw, self.raw_used = np.zeros(1 << 16, np.uint8), 0
        self.raw_start, self.raw_size = (np.zeros(1 << 12, np.int32) for _ in range(2))

    def _forget(self) -> None:
        again = (self.record > 0) & (self.uses[self.record] > 1)
        keys, old, start, count, uses, flat = self.keys[again], self.record[again], self.start, self.count, self.uses, self.flat
        raw, raw_start, size = self.raw, self.raw_start[old], self.raw_size[old]
        self._clear()
        count, end = count[old], np.cumsum(count[old])
        raw = raw[np.repeat(raw_start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        self._add(end - count, count, flat[np.repeat(start[old] - (end - count), count) + np.arange(int(count.sum()))], raw, size)
        self.keys, self.record = keys, np.arange(1, len(old) + 1)
        self.uses[1 : len(old) + 1] = uses[old] // 2

    def _add(self, start: np.ndarray, count: np.ndarray, ids: np.ndarray, raw: np.ndarray, size: np.ndarray) -> None:
        """New records, their ids at ``start`` within ``ids``, their words one after the other in ``raw``."""
        while self.words + len(start) > len(self.start):
            self.start, self.count, self.uses, self.raw_start, self.raw_size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.count, self.uses, self.raw_start, self.raw_size))
        while self.raw_used + len(raw) >= len(self.raw):
            self.raw = np.concatenate([self.raw, np.zeros_like(self.raw)])
        while self.used + len(ids) >= len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        where = slice(self.words, self.words + len(start))
        self.start[where], self.count[where] = start + self.used, count
        self.raw_start[where], self.raw_size[where] = np.cumsum(size) - size + self.raw_used, size
        self.raw[self.raw_used : self.raw_used + len(raw)] = raw
        self.raw_used += len(raw)
        self.flat[self.used : self.used + len(ids)] = ids
        self.words, self.used = self.words + len(start), self.used + len(ids)

    def encode(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """The ids (uint32) of each text; null counts as empty."""
        if not self.by_words:
            return self._whole([t or "" for t in texts])
        out: list[list[np.ndarray]] = [[] for _ in texts]
        group: list[tuple[int, str]] = []
        held = 0
        for i, text in enumerate(texts):
            for piece in _pieces(text or ""):
                group.append((i, piece))
                held += len(piece)
                if held >= GROUP_CHARS:
                    self._group(group, out)
                    group, held = [], 0
        if group:
            self._group(group, out)
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in out]

    def _group(self, group: list[tuple[int, str]], out: list[list[np.ndarray]]) -> None:
        # A text's first word is keyed as after a line break; that break's id is dropped. Later pieces begin with a space.
        follows = np.array([bool(out[i]) or (k > 0 and group[k - 1][0] == i) for k, (i, _) in enumerate(group)])
        parts = [(p if f else "\n" + p).encode() for (_, p), f in zip(group, follows.tolist())]
        data = b"".join(parts)
        codes = np.frombuffer(data, np.uint8)
        begin = np.flatnonzero((codes == 32) | (codes == 10))
        end = np.append(begin[1:], len(data))
        hashes = prefix_hashes(codes)
        keys, inverse = np.unique(hashes(begin, end), return_inverse=True)
        record = self._records(keys)
        missing = np.flatnonzero(record < 0)
        if len(missing):
            first = np.empty(len(keys), np.int64)
            first[inverse[::-1]] = np.arange(len(inverse) - 1, -1, -1)
            first = first[missing]
            self._learn(keys[missing], data, begin[first], end[first], hashes)
            record = self._records(keys)
        at = record[inverse]
        at[self._differ(at, codes, begin, end)] = 0
        self.uses[record] += np.bincount(inverse)
        sizes = np.diff(np.searchsorted(begin, np.cumsum([len(p) for p in parts])), prepend=0)
        first = np.cumsum(sizes) - sizes
        odd = np.logical_or.reduceat(at == 0, first)
        count = self.count[at]
        ids = self.flat[np.repeat(self.start[at] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]
        total = np.add.reduceat(count, first)
        last = np.cumsum(total)
        for (i, piece), o, b, e in zip(group, odd.tolist(), (last - total + ~follows).tolist(), last.tolist()):
            out[i].append(self._whole([piece])[0] if o else ids[b:e].copy())
        if self.words > self.max_words:
            self._forget()

    def _differ(self, at: np.ndarray, codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether a word, of those that ``codes`` consists of, has the hash but not the bytes of its record's."""
        size = end - begin
        kept = np.take(self.raw, np.repeat(self.raw_start[at] - begin, size) + np.arange(len(codes)), mode="clip")
        return (at > 0) & ((self.raw_size[at] != size) | np.logical_or.reduceat(kept != codes, begin))

    def _records(self, keys: np.ndarray) -> np.ndarray:
        """The record of each (sorted) key, -1 for those not known."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.record[at], -1)

    def _name(self, keys: np.ndarray, record: np.ndarray) -> None:
        """Let keys (new ones, in any order) stand for records."""
        order = np.argsort(keys)
        keys, record = keys[order], record[order]
        at = np.searchsorted(self.keys, keys)
        self.keys, self.record = np.insert(self.keys, at, keys), np.insert(self.record, at, record)

    def _learn(self, keys: np.ndarray, data: bytes, begin: np.ndarray, end: np.ndarray, hashes) -> None:
        words = [data[b:e].decode() for b, e in zip(begin.tolist(), end.tolist())]
        seen = set("".join(words))
        spaces = any(c.isspace() for c in seen - {"\n", " "})
        odd = np.array([len(w) == 1 or len(w) > LONG_WORD or (spaces and any(c.isspace() for c in w[1:])) for w in words])
        # A mark after a letter is a token of its own: such a word has the ids of what stands before, and the mark's.
        marked = np.array([w[-1] in self.marks and w[-2].isalpha() if len(w) > 2 else False for w in words]) & ~odd
        plain = np.flatnonzero(~odd & ~marked)
        self._name(keys[odd], np.zeros(int(odd.sum()), np.int64))
        self._ask(keys[plain], [words[i] for i in plain])
        which = np.flatnonzero(marked)
        if not len(which):
            return
        base = hashes(begin[which], end[which] - 1)
        unique, first, inverse = np.unique(base, return_index=True, return_inverse=True)
        unknown = np.flatnonzero(self._records(unique) < 0)
        self._ask(unique[unknown], [words[which[first[i]]][:-1] for i in unknown])
        record = self._records(unique)[inverse]
        same = np.array([r > 0 and self.raw[self.raw_start[r] : self.raw_start[r] + self.raw_size[r]].tobytes() == words[i][:-1].encode() for r, i in zip(record.tolist(), which.tolist())])
        self._name(keys[which[~same]], np.zeros(int((~same).sum()), np.int64))
        which, record = which[same], record[same]
        if not len(which):
            return
        count = self.count[record] + 1
        last = np.cumsum(count)
        ids = self.flat[np.repeat(self.start[record] - (last - count), count) + np.arange(int(last[-1]))]
        ids[last - 1] = [self.marks[words[i][-1]] for i in which]
        self._name(keys[which], np.arange(self.words, self.words + len(which)))
        self._add(last - count, count, ids, *_bytes([words[i] for i in which]))

    def _ask(self, keys: np.ndarray, words: list[str]) -> None:
        """Have the library encode words, parted by line breaks; a word that begins with one has a second."""
        self._name(keys, np.arange(self.words, self.words + len(words)))
        calls = [words[i : i + WORDS_A_CALL] for i in range(0, len(words), WORDS_A_CALL)]
        for call, ids in zip(calls, self._whole(["".join("\n" + w for w in call) for call in calls])):
            breaks = np.flatnonzero(ids == self.feed[0])
            own = np.array([w[0] == "\n" for w in call])
            begin = breaks[np.arange(len(call)) + np.cumsum(own) - own] + 1
            self._add(begin, np.append(begin[1:] - 1, len(ids)) - begin, ids, *_bytes(call))


def _bytes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of words one after the other, and the size of each."""
    data = [w.encode() for w in words]
    return np.frombuffer(b"".join(data), np.uint8), np.array([len(x) for x in data], np.int64)


def _pieces(text: str) -> Iterator[str]:
    """A text in pieces of about ``GROUP_CHARS``, cut before spaces that stand before a word."""
    a = 0
    while len(text) - a > 2 * GROUP_CHARS and (cut := _CUT.search(text, a + GROUP_CHARS)):
        yield text[a : cut.start()]
        a = cut.start()
    yield text[a:]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One for each file and Python process."""
    return Encoder(path)
