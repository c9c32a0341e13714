"""Language identification by interpolated Kneser-Ney character models.

One model of order ``ORDER`` for each language, however many there are. The
n-grams of up to ``BLOCK_LANGUAGES`` languages lie together in sorted arrays of 64-bit hashes, one array for each order, each
entry with the n-gram's log probability in every language (back-off already
worked in) and the weight by which every language backs off after it. A
character costs one look at the longest order where that finds it. The language
with the lowest cross-entropy per character is predicted, of equal ones the first
by name. The score is its posterior against the others, at the temperature that
makes the labels of held-back pieces of that length most likely, times an
acceptance that falls where the cross-entropy exceeds what documents held back
from training showed: pieces of
them of each length of ``LENGTHS`` give each language's median and spread, and
the limit of deviations at that length: the quantile ``QUANTILE`` of all pieces,
carried on to the share ``ACCEPT`` as for normal deviations, because junk and
wrongly labelled texts among those held back own the quantiles beyond.

Letters are lower-cased; every run of other characters is one space.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, loaded, stored, with_string
from .words import grouped, mixed, parted

ORDER = 5
MAX_TRAIN_ROWS = 4000
#: With many languages the bound is so many rows for each of them; so many languages lie in one set of arrays.
EACH_ROWS = 50
BLOCK_LANGUAGES = 8
FOLDS, HELD_OUT_FOLD = 3, 1
HELD_BACK = 5
#: Characters of the pieces; of each text and length so many; fewer than ``MIN_PIECES`` don't give a language's own spread.
LENGTHS = (5, 10, 20, 40, 80, 160, 320, 640, 1280, 2560)
PIECES, MIN_PIECES = 2, 5
QUANTILE, ACCEPT = 0.95, 0.999
LEAST_SPREAD = 0.02
#: Temperatures tried.
TEMPERATURES = np.geomspace(1.0, 256.0, 49)
MIN_SCORE = 0.5
START, SPACE = 1, 32
_STEP = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _fold() -> np.ndarray:
    """Code point to its lower case if it is a letter, else to a space."""
    out = np.full(0x110000, SPACE, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def characters(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of all texts, each after ``ORDER - 1`` starts and a space; where each text begins; whether it has a letter."""
    lead = "\x01" * (ORDER - 1) + " "
    joined = "".join(lead + (t or "") + " " for t in texts)
    raw = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    sizes = np.array([len(t or "") + ORDER + 1 for t in texts])
    begin = np.cumsum(sizes) - sizes
    codes = _fold()[raw]
    starts = (begin[:, None] + np.arange(ORDER - 1)).ravel()
    codes[starts] = START
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != SPACE) | (codes[:-1] != SPACE)
    letters = np.add.reduceat(((codes != SPACE) & (codes != START)).astype(np.int64), begin) if len(texts) else np.zeros(0, np.int64)
    at = np.cumsum(keep) - 1
    return codes[keep], at[begin], letters > 0


def hashes(codes: np.ndarray) -> list[np.ndarray]:
    """By order, from 0: the hash of the n-gram that ends at each place."""
    out = [np.zeros(len(codes), np.uint64)]
    with np.errstate(over="ignore"):
        own = mixed(codes.astype(np.uint64) + np.uint64(7))
        power = np.uint64(1)
        for n in range(1, ORDER + 1):
            h = out[-1].copy() if n > 1 else np.zeros(len(codes), np.uint64)
            h[n - 1 :] = out[-1][n - 1 :] + own[: len(codes) - n + 1] * power
            h[: n - 1] = 0
            out.append(h)
            power = power * _STEP
    return out


class Table:
    """Sorted hashes with a directory over their first bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.bits = max(4, len(keys).bit_length() + 1)
        self.first = np.searchsorted(keys, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)).astype(np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash, or -1."""
        at = self.first[(h >> np.uint64(64 - self.bits)).astype(np.int64)]
        open_ = np.flatnonzero(self.keys[at] < h)
        while len(open_):
            at[open_] += 1
            open_ = open_[self.keys[at[open_]] < h[open_]]
        return np.where(self.keys[at] == h, at, -1)


def _counted(texts: list[str]) -> list[dict[str, np.ndarray]]:
    """By order, from 1: the n-grams of some texts (sorted hashes), how often they count, their suffixes and contexts.

    Texts are gone through a part at a time, so the memory held is that of the distinct n-grams.
    """
    parts: list[list[tuple]] = [[] for _ in range(ORDER)]

    def merge(n: int) -> None:
        keys, times, suffix, context = (np.concatenate(x) for x in zip(*parts[n]))
        keys, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        parts[n] = [(keys, np.bincount(inverse, times).astype(np.int64), suffix[first], context[first])]

    for part in grouped([len(t) for t in texts], 1 << 17):
        codes, _, _ = characters(texts[part])
        places = np.flatnonzero(codes != START)
        h = [mixed(x) for x in hashes(codes)]
        for n in range(ORDER):
            keys, where, times = np.unique(h[n + 1][places], return_index=True, return_counts=True)
            where = places[where]
            parts[n].append((keys, times, h[n][where], h[n][where - 1]))
            if len(parts[n]) > 4:
                merge(n)
    for n in range(ORDER):
        merge(n)
    out = [dict(zip(("keys", "times", "suffix", "context"), p[0])) for p in parts]
    for n in range(ORDER - 1):
        # Below the longest order an n-gram counts as often as it has different characters before it.
        out[n]["times"] = np.unique(out[n + 1]["suffix"], return_counts=True)[1]
    return out


def pieces(texts: Sequence[str], length: int) -> list[str]:
    """``PIECES`` parts of ``length`` characters of each text that is as long, from the begin of a word if one is near."""
    out = []
    for t in texts:
        room = len(t) - length
        if room >= 0:
            for at in sorted({room * (2 * k + 1) // (2 * PIECES) for k in range(PIECES)}):
                word = t.rfind(" ", max(0, at - 20), at) + 1
                out.append(t[word or at :][:length])
    return out


class Block:
    """Models of some languages together."""

    def __init__(self, size: int, tables: list[Table], log_p: list[np.ndarray], log_back: list[tuple[Table, np.ndarray]], unknown: np.ndarray):
        self.size, self.tables, self.log_p, self.log_back, self.unknown = size, tables, log_p, log_back, unknown

    @classmethod
    def train(cls, texts: Sequence[list[str]], alphabet: int) -> Block:
        counted = [_counted(some) for some in texts]
        grams = [[f["keys"] for f in found] for found in counted]
        size = len(texts)
        tables, log_p, log_back = [], [], []
        flat = np.full(size, 1.0 / alphabet)
        for n in range(1, ORDER + 1):
            keys = np.unique(np.concatenate([g[n - 1] for g in grams]))
            table, suffix, context = Table(keys), np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.uint64)
            for found in counted:
                at = np.searchsorted(keys, found[n - 1]["keys"])
                suffix[at], context[at] = found[n - 1]["suffix"], found[n - 1]["context"]
            lower = np.tile(flat, (len(keys), 1)) if n == 1 else np.exp(log_p[-1][tables[-1].find(suffix)])
            p = np.zeros((len(keys), size))
            contexts = np.unique(context)
            back = np.ones((len(contexts), size))
            for k, found in enumerate(counted):
                own = found[n - 1]
                ones, twos = (own["times"] == 1).sum(), (own["times"] == 2).sum()
                discount = ones / (ones + 2 * twos) if ones and twos else 0.5
                at = np.searchsorted(contexts, own["context"])
                total = np.bincount(at, own["times"], len(contexts))
                kinds = np.bincount(at, minlength=len(contexts))
                seen = total > 0
                back[seen, k] = discount * kinds[seen] / total[seen]
                p[np.searchsorted(keys, own["keys"]), k] = (own["times"] - discount) / total[at]
            p += back[np.searchsorted(contexts, context)] * lower
            tables.append(table)
            log_p.append(np.log(p).astype(np.float32))
            # The weights after a context lie with the context, an n-gram one shorter.
            log_back.append((Table(contexts), np.log(back).astype(np.float32)))
        unknown = log_back[0][1][0] + np.log(flat).astype(np.float32)
        return cls(size, tables, log_p, log_back, unknown)

    def _log_p(self, h: list[np.ndarray], before: list[np.ndarray]) -> np.ndarray:
        rows = np.zeros((len(h[0]), self.size), np.float32)
        left = np.arange(len(h[0]))
        for n in range(ORDER, 0, -1):
            at = self.tables[n - 1].find(h[n][left])
            hit = at >= 0
            rows[left[hit]] += self.log_p[n - 1][at[hit]]
            left = left[~hit]
            if not len(left):
                return rows
            contexts, weights = self.log_back[n - 1]
            if n > 1:
                at = contexts.find(before[n - 1][left])
                known = at >= 0
                rows[left[known]] += weights[at[known]]
        rows[left] += self.unknown
        return rows


class Model:
    """Models of all languages, in blocks."""

    def __init__(self, languages: list[str], blocks: list[Block], flat: float):
        self.languages, self.blocks = languages, blocks
        # Without calibration a text must be coded better than by equal chances.
        self.lengths, self.middle, self.spread, self.limit, self.log_heat = np.ones(1), np.full((len(languages), 1), flat), np.ones((len(languages), 1)), np.zeros(1), np.zeros(1)

    @classmethod
    def train(cls, texts: dict[str, list[str]]) -> Model:
        languages = sorted(texts)
        alphabet = len({c for k in languages for part in grouped([len(t) for t in texts[k]], 1 << 17) for c in np.unique(characters(texts[k][part])[0]).tolist()} - {START}) + 1
        blocks = [Block.train([texts[k] for k in languages[a : a + BLOCK_LANGUAGES]], alphabet) for a in range(0, len(languages), BLOCK_LANGUAGES)]
        return cls(languages, blocks, math.log(alphabet))

    def cross_entropy(self, texts: Sequence[str | None], only: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nats per character of each text in each language (or those of block ``only``); characters; whether a letter is there."""
        blocks = self.blocks if only is None else [self.blocks[only]]
        out, sizes, some = np.zeros((len(texts), sum(b.size for b in blocks))), np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
        for part in grouped([len(t or "") for t in texts], 1 << 18):
            codes, begin, letters = characters(texts[part])
            scored = codes != START
            h = [mixed(x[scored]) for x in hashes(codes)]
            # The context of a character ends before it.
            before = [mixed(np.concatenate([np.zeros(1, np.uint64), x[:-1]])[scored]) for x in hashes(codes)]
            counts = np.add.reduceat(scored.astype(np.int64), begin)
            first = np.cumsum(counts) - counts
            at = 0
            for b in blocks:
                out[part, at : at + b.size] = -np.add.reduceat(b._log_p(h, before).astype(np.float64), first) / counts[:, None]
                at += b.size
            sizes[part], some[part] = counts, letters
        return out, sizes, some

    def calibrate(self, texts: dict[str, list[str]]) -> None:
        """By length of text: each language's median cross-entropy and spread, the limit of deviations, and the posterior's temperature.

        A language with fewer than ``MIN_PIECES`` pieces of a length has the
        spread of all pieces, and the larger of its own median and that of all.
        """
        found = []
        for length in LENGTHS:
            of, ces, sizes, leads = [], [], [], []
            for k, language in enumerate(self.languages):
                cut = pieces(texts.get(language) or [], length)
                if cut:
                    ce, size, some = self.cross_entropy(cut, k // BLOCK_LANGUAGES)
                    of.append(np.full(some.sum(), k))
                    ces.append(ce[some, k % BLOCK_LANGUAGES])
                    # Against the other languages of the block.
                    lead = (np.delete(ce[some], k % BLOCK_LANGUAGES, axis=1) - ces[-1][:, None]) * size[some, None]
                    leads.append(np.concatenate([lead, np.full((len(lead), BLOCK_LANGUAGES - 1 - lead.shape[1]), np.inf)], axis=1))
                    sizes.append(size[some])
            if not sum(map(len, of)):
                continue
            of, ces, sizes = np.concatenate(of), np.concatenate(ces), np.concatenate(sizes)
            middle, spread = np.full(len(self.languages), np.median(ces)), np.full(len(self.languages), _spread(ces))
            for k in np.unique(of):
                own = ces[of == k]
                if len(own) >= MIN_PIECES:
                    middle[k], spread[k] = np.median(own), _spread(own)
                else:
                    middle[k] = max(middle[k], np.median(own))
            # Few pieces show few large deviations: no less than if these were normal.
            inner, outer = NormalDist().inv_cdf(QUANTILE), NormalDist().inv_cdf(ACCEPT)
            limit = max(1.0, np.quantile((ces - middle[of]) / spread[of], QUANTILE, method="higher") / inner) * outer
            found.append((np.median(sizes), middle, spread, limit, math.log(_temperature(np.concatenate(leads)))))
        if found:
            lengths, middle, spread, limit, log_heat = zip(*found)
            self.lengths, self.middle, self.spread, self.limit, self.log_heat = np.array(lengths), np.stack(middle, 1), np.stack(spread, 1), np.array(limit), np.array(log_heat)

    def predict(self, texts: Sequence[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score; ``und`` and 0 without a letter."""
        ce, size, some = self.cross_entropy(texts)
        every = np.arange(len(texts))
        best = ce.argmin(axis=1)
        lead = (ce - ce[every, best][:, None]) * size[:, None]
        # Between two lengths in proportion to the logarithm.
        at = np.interp(np.log(np.maximum(size, 1)), np.log(self.lengths), np.arange(len(self.lengths)))
        low = at.astype(np.int64)
        high, part = np.minimum(low + 1, len(self.lengths) - 1), at - low
        middle, spread = (x[best, low] * (1 - part) + x[best, high] * part for x in (self.middle, self.spread))
        limit, log_heat = (x[low] * (1 - part) + x[high] * part for x in (self.limit, self.log_heat))
        posterior = 1 / np.exp(-np.minimum(lead / np.exp(log_heat)[:, None], 700)).sum(axis=1)
        sigmas = (ce[every, best] - middle) / spread
        accepted = 1 / (1 + np.exp(np.clip(sigmas - limit, -50, 50)))
        score = np.where(some, posterior * accepted, 0.0)
        return [self.languages[b] if s else "und" for b, s in zip(best.tolist(), some.tolist())], score


def _spread(x: np.ndarray) -> float:
    return max(LEAST_SPREAD, float(np.median(np.abs(x - np.median(x)))) * 1.4826)


def _temperature(lead: np.ndarray) -> float:
    """The one at which pieces are most likely in their own language; ``lead`` is by how many nats they are coded better in it than in each other one."""
    with np.errstate(over="ignore"):
        costs = [np.log1p(np.exp(np.clip(-lead / t, -700, 700)).sum(axis=1)).sum() for t in TEMPERATURES]
    return float(TEMPERATURES[int(np.argmin(costs))])


def _fold_of(id_: Column) -> Column:
    return F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(FOLDS))


def fit(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", max_rows: int = MAX_TRAIN_ROWS) -> Model | None:
    """Train on at most ``max_rows`` labelled rows outside the held-out fold, or ``EACH_ROWS`` for each language if that is more, as many for each.

    Rows are taken by a hash of the id, whole texts each; every fifth is kept
    for calibration, from the second on. None where no row can teach.
    """
    d = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    # A null id has no fold and doesn't teach.
    d = d.where((_fold_of(F.col("id")) != HELD_OUT_FOLD) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = d.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    if not sizes:
        return None
    each = max(EACH_ROWS, max_rows // len(sizes))
    # Some more than needed, for a hash doesn't deal out exact numbers.
    some = 1.1 * each + 4 * math.sqrt(each)
    share = F.broadcast(docs.sparkSession.createDataFrame([(r["lang"], int((1 << 30) * min(1.0, some / r["n"]))) for r in sizes], "lang string, share long"))
    rows = d.withColumn("draw", F.pmod(F.xxhash64("id"), F.lit(1 << 30))).join(share, "lang").where(F.col("draw") < F.col("share")).select("lang", "draw", "id", "text").collect()
    train: dict[str, list[str]] = {}
    held: dict[str, list[str]] = {}
    taken: dict[str, int] = {}
    for r in sorted(rows, key=lambda r: (r["draw"], str(r["id"]), r["text"])):
        k = taken.get(r["lang"], 0)
        if k < each:
            taken[r["lang"]] = k + 1
            (held if k % HELD_BACK == 1 else train).setdefault(r["lang"], []).append(r["text"])
    del rows
    if not any(_has_letter(t) for texts in train.values() for t in texts):
        return None
    model = Model.train(train)
    del train
    model.calibrate(held)
    return model


def _has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def with_language(docs: DataFrame, model: Model, text_col: str, lang_out: str, score_out: str) -> DataFrame:
    """``docs`` with two more columns: language and score of each text."""
    held = stored(docs.sparkSession, model, "language-models")
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Arrays of many characters pay for the look-ups of each order.
            for rows, texts in parted(batch, at, 1 << 20):
                lang, score = loaded(held).predict(texts)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=schema.fieldNames())

    return docs.mapInArrow(run, schema)


def predictions(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``, one row for each row of ``docs``.

    Null texts and texts without a letter are ``und`` with score 0; so is all
    where no labelled row with a letter is outside the held-out fold. Rows with
    a null id aren't held out. Repeated rows stay repeated; an empty table gives
    no rows; other columns are not read.
    """
    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    model = fit(docs, id_col, lang_col, text_col, max_rows)
    if model is None:
        out = d.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    else:
        out = with_language(d, model, "text", "lang_pred", "score")
    return out.select("doc_id", F.coalesce(_fold_of(F.col("doc_id")) == HELD_OUT_FOLD, F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", min_score: float = MIN_SCORE, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs`` whose text is in a known language (score at least ``min_score``), with all columns.

    Null texts and texts without a letter go. Where no row teaches a language
    nothing can be judged, and all rows stay. Null labels don't teach, nor do
    null ids; repeated rows share their fate. An empty table stays empty;
    columns may have any names.
    """
    model = fit(docs, id_col, lang_col, text_col, max_rows)
    if model is None:
        return docs
    d, name = with_string(docs, text_col)
    lang = fresh(d, "lang")
    score = fresh(d.withColumn(lang, F.lit("")), "score")
    out = with_language(d, model, name, lang, score)
    return out.where((F.col(lang) != "und") & (F.col(score) >= min_score)).select(*[F.col(f"`{c}`") for c in docs.columns])
