"""The word cache, token files, packing."""

import io
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from brindle.llm import packing, token_codes, tokens
from brindle.llm.common import shared_dir, ship

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, source string, tokens string"


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: np.array(t.encode(text or "", add_special_tokens=False).ids, np.uint32)


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(PATH, max_words=50)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(" \n\t\r\x1c\x85\xa0aé'sß1.,", max_size=40), st.none()), max_size=8))
def test_words_are_encoded_as_whole_texts_are(library, encoder, texts):
    for got, text in zip(encoder.encode(texts), texts, strict=True):
        assert np.array_equal(got, library(text))


def test_long_texts_in_pieces(library, encoder, monkeypatch):
    monkeypatch.setattr(tokens, "GROUP_CHARS", 40)
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(["ab", "c ", "d, ", "E.", "\n", " ", "éa", "1 ", "<|endoftext|>"]) for _ in range(200)) for _ in range(30)] + ["x" * 5000]
    for got, text in zip(encoder.encode(texts), texts, strict=True):
        assert np.array_equal(got, library(text))


def test_words_whose_hashes_collide(library, monkeypatch):
    real = tokens.prefix_hashes
    monkeypatch.setattr(tokens, "prefix_hashes", lambda codes: lambda begin, end, h=real(codes): h(begin, end) & np.uint64(31))
    rnd = random.Random(3)
    weak = tokens.Encoder(PATH, max_words=20)
    for _ in range(5):
        texts = [" ".join("".join(rnd.choices("abcde", k=rnd.randrange(1, 6))) + rnd.choice(["", ",", "."]) for _ in range(rnd.randrange(12))) for _ in range(40)]
        for got, text in zip(weak.encode(texts), texts, strict=True):
            assert np.array_equal(got, library(text))


class Counting:
    """A file in memory that counts what is read of it."""

    def __init__(self, data):
        self.data, self.bytes = data, 0

    def open_input_file(self, path):
        return self

    def size(self):
        return len(self.data)

    def read_at(self, n, at):
        self.bytes += n
        return self.data[at : at + n]


def test_a_token_is_found_by_small_reads():
    rng = np.random.default_rng(0)
    ids = (rng.pareto(0.4, 300_000) * 3).clip(0, 90_000).astype(np.uint32)
    out = io.BytesIO()
    out.close, writer = lambda: None, token_codes.FileWriter(out, 100_000)
    for k in range(0, len(ids), 1000):
        writer.add(k, ids[k : k + 1000])
    writer.close()
    file = token_codes.TokenFile(held := Counting(out.getvalue()), "")
    assert len(file) == len(ids)
    some = rng.integers(0, len(ids), 300).tolist() + [0, 511, 512, len(ids) - 1]
    assert [file[i] for i in some] == ids[some].tolist()
    assert held.bytes < 300 * len(some)
    for bad in (-1, len(ids)):
        with pytest.raises(IndexError):
            file[bad]


@pytest.mark.parametrize(("n", "high"), [(0, 1), (1, 1), (512, 2), (1024, 70_000), (3000, 3_000_000)])
def test_segments_give_any_token(n, high):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, high, n).astype(np.uint32)
    lengths = [n] if n < 3 else [2, 0, n - 2]
    s = token_codes.Segment.load(token_codes.Segment.of(ids, [None, *range(len(lengths) - 1)], lengths).dump())
    assert len(s) == n and np.array_equal(s.ids(0, n), ids)
    assert all(s[i] == ids[i] for i in range(n))
    for a, b in np.sort(rng.integers(0, n + 1, (40, 2))):
        assert np.array_equal(s.ids(a, b), ids[a:b])
    assert [(d, b) for d, b, _ in s.documents()][0] == (None, 0)


ROWS = [(5, "Some words here.", "a", "x"), (3, None, "b", "x"), (9, "", None, "x"), (3, "Three again", "b", "x"), (3, "Three again", "b", "x"), (None, "no id", "a", None), (7, "long " * 3000, "a", None), (1, "é   \t tab", "c", None)]


def test_token_files(spark, library, tmp_path):
    ship(spark)
    folder = shared_dir(spark, "codes")
    docs = spark.createDataFrame(ROWS, DOCS).repartition(3)
    manifest = token_codes.write_token_files(docs, folder, PATH, segment_ids=100)
    out = sorted((tuple(r) for r in token_codes.read_token_files(spark, folder).drop("file").collect()), key=lambda r: r[1])
    assert [r[0] for r in out] == [None, 1, 3, 3, 3, 5, 7, 9]
    at = 0
    left = Counter((r[0], np.append(library(r[1]), 0).astype("<u4").tobytes()) for r in ROWS)
    whole = []
    for doc, start, n, crc in out:
        found = next(k for k in left if k[0] == doc and len(k[1]) == 4 * n and zlib.crc32(k[1]) == crc)
        left[found] -= 1
        left += Counter()
        whole.append(np.frombuffer(found[1], "<u4"))
        assert start == at
        at += n
    assert not left
    # Any token of the corpus, by its place.
    whole, fs = np.concatenate(whole), token_codes.open_fs(folder)
    before = 0
    for r in manifest.orderBy("part").collect():
        file = token_codes.TokenFile(fs[0], f"{fs[1]}/{r['file']}")
        for i in range(0, r["ids"], 37):
            assert file[i] == whole[before + i]
        before += r["ids"]
    empty = shared_dir(spark, "codes")
    token_codes.write_token_files(docs.limit(0), empty, PATH)
    assert token_codes.read_token_files(spark, empty).count() == 0


def check_pieces(out, docs, library, size, end_id=1):
    """Every id in one piece, sequences without a gap, of ``size`` or a power of two."""
    texts = Counter((d, np.append(library(t), end_id).astype("<u4").tobytes()) for d, t, *_ in docs)
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append(r)
    assert sorted(sequences) == list(range(len(sequences)))
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at == pieces[0].sequence_length and (at == size or (at < size and at & (at - 1) == 0))
    for (doc, data), n in texts.items():
        mine = Counter((r.start, r.length, r.ids_crc32) for r in out if r.doc_id == doc and r.doc_tokens == len(data) // 4 and zlib.crc32(data[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32)
        covered = sum(length * k for (_, length, _), k in mine.items())
        assert covered >= n * len(data) // 4
    assert sum(r.length for r in out) == sum(n * len(data) // 4 for (_, data), n in texts.items())


@pytest.mark.parametrize("targets", [None, {"a": 1.0, "b": 3.0}])
def test_packing_is_exact(spark, library, targets):
    ship(spark)
    docs = spark.createDataFrame(ROWS, DOCS).repartition(3)
    out = packing.pack(docs, PATH, size=64, targets=targets, block_ids=500, partition_ids=700).collect()
    check_pieces(out, ROWS, library, 64)
    assert packing.pack(docs.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, PATH, size=100)


def test_windows_hold_the_target_mixture(spark):
    ship(spark)
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice(["one", "two", "three"]) for _ in range(rnd.randrange(5, 300))), "big" if i >= 100 else "small", "") for i in range(300)]
    out = packing.pack(spark.createDataFrame(rows, DOCS).coalesce(2), PATH, size=256, block_ids=4000, partition_ids=6000).toPandas()
    share = out.groupby("source").length.sum() / out.length.sum()
    full = out[out.sequence_length == 256]
    off = [abs(g.groupby("source").length.sum().get("small", 0) / 256 - share["small"]) for _, g in full.groupby("sequence_id")]
    # The table is sorted by source; every window has the mixture all the same.
    assert max(off) < 0.02


def test_deficits_are_paid_back():
    p = packing.Packer(100, {"a": 1000, "b": 1000}, {"a": 0.5, "b": 0.5}, {"a": 60.0, "b": -60.0})
    given = [dict(g) for _, g in p.windows()]
    assert len(given) == 20 and all(sum(g.values()) == 100 for g in given)
    assert given[0]["a"] > 60 and sum(g["a"] for g in given[:4]) == pytest.approx(260, abs=3)
    assert packing.Packer(64, {"a": 75}, {"a": 1.0}, {"a": 0.0}).lengths == [64, 8, 2, 1]


def test_targets_hold_while_sources_last(spark):
    ship(spark)
    rows = [(i, "one two three four " * 20, "abc"[i % 3], "") for i in range(300)]
    out = packing.pack(spark.createDataFrame(rows, DOCS).repartition(3), PATH, size=256, targets={"a": 3.0, "b": 1.0}, block_ids=900, partition_ids=3000).toPandas()
    by = out[out.sequence_length == 256].groupby(["sequence_id", "source"]).length.sum().unstack(fill_value=0) / 256
    early = by.iloc[: int(0.4 * len(by))]
    assert (early.a - 0.75).abs().mean() < 0.03 and (early.b - 0.25).abs().mean() < 0.03 and early.c.max() < 0.1
    assert by.iloc[int(0.7 * len(by)) :].c.mean() > 0.95
