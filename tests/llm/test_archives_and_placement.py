"""WARC archives, sharding, URL rules."""

import base64
import gzip
import hashlib
import io
import random
from collections import Counter

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brindle.llm import sharding, urlfilter, warc
from brindle.llm.common import shared_dir

PAGES = "page_id long, url string, html string, Payload string"


def records(spark, rows, **options):
    folder = shared_dir(spark, "warc")
    warc.write_archives(warc.mark_revisits(spark.createDataFrame(rows, PAGES), **options), folder)
    out = warc.read_archives(spark, folder).select("page_id", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri").collect()
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, repr(r)))


def test_round_trip_revisits_and_ties(spark):
    rows = [(1, "http://a/\r\nx y", "same", "clash"), (2, "http://b", "same", None), (5, None, "same", None), (5, "u", "same", None), (3, "c", None, None), (4, "d", "", None), (6, "e", "é\r\n\r\nWARC/1.1", None)]
    out = {(r[0], r[6]): r for r in records(spark, rows)}
    assert len(out) == 7
    assert out[1, "http://a/%0D%0Ax%20y"][4:6] == ("revisit", 5)
    assert out[2, "http://b"][2:6] == (4, base64.b32encode(hashlib.sha1(b"same").digest()).decode(), "revisit", 5)
    assert out[5, None][4] == out[5, "u"][4] == "response"
    assert out[3, "c"][1] is None and out[3, "c"][2:] == (0, "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ", "revisit", 4, "c")
    assert bytes(out[6, "e"][1]) == "é\r\n\r\nWARC/1.1".encode()


def test_small_payloads_are_all_responses(spark):
    out = records(spark, [(1, "a", "xy", None), (2, "b", "xy", None), (3, "c", "long enough", None), (4, "d", "long enough", None)], min_bytes=5)
    assert [(r[0], r[4], r[5]) for r in out] == [(1, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None)]


def test_null_ids_and_empty_table(spark):
    out = records(spark, [(None, "a", "x", None), (None, "b", "x", None), (None, "c", "y", None), (7, "d", "y", None)])
    assert Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in out) == {(None, "response", None): 2, (None, "revisit", 7): 1, (7, "response", None): 1}
    assert records(spark, []) == []


def test_rolls_files_and_reads_plain_gzip(spark):
    folder = shared_dir(spark, "warc")
    manifest = warc.write_archives(warc.mark_revisits(spark.createDataFrame([(i, "u", f"page {i}", None) for i in range(20)], PAGES)), folder, file_bytes=1)
    assert manifest.count() == 20
    fs, base = warc.open_fs(folder)
    name = manifest.first()["file"]
    assert gzip.decompress(fs.open_input_stream(f"{base}/{name}").read()).startswith(b"WARC/1.1\r\nWARC-Type: response")


@settings(max_examples=30, deadline=None)
@given(st.lists(st.binary(max_size=300), min_size=1, max_size=5), st.integers(1, 50))
def test_members_in_any_blocks(payloads, block):
    data = b"".join(gzip.compress(warc.record("response", i, "u", p, warc.sha1_base32(p), len(p))) for i, p in enumerate(payloads))
    member, found = warc.Member(io.BytesIO(data), block), []
    while member.begin():
        found.append(b"".join(iter(lambda: member.read(7), b"")))
    assert found == [gzip.decompress(gzip.compress(x)) for x in found] and len(found) == len(payloads) and all(p in m for p, m in zip(payloads, found))
    assert [r[2] for r in warc.read_records(io.BytesIO(data), read_bytes=block)] == payloads
    assert [r[2:5] for r in warc.read_records(io.BytesIO(data), "", False, block)] == [(None, len(p), warc.sha1_base32(p)) for p in payloads]


@pytest.mark.parametrize("harm", [lambda d: d[:-3], lambda d: gzip.compress(gzip.decompress(d).replace(b"hello", b"jello")), lambda d: gzip.compress(gzip.decompress(d)[:-1]), lambda d: gzip.compress(b"nothing")])
def test_damage_is_found(harm):
    good = gzip.compress(warc.record("response", 1, "u", b"hello", warc.sha1_base32(b"hello"), 5))
    assert len(list(warc.read_records(io.BytesIO(good)))) == 1
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(harm(good))))


def plain_record(kind, block, **fields):
    head = {"WARC-Type": kind, "WARC-Record-ID": "<urn:uuid:1>", "Content-Length": str(len(block)), **{k.replace("_", "-"): v for k, v in fields.items()}}
    return gzip.compress(b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n")


def test_archives_of_others_are_read():
    http = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nContent-Length: 99\r\n\r\nbody"
    kind = {"Content_Type": "application/http; msgtype=response"}
    data = plain_record("warcinfo", b"software: x\r\n", Content_Type="application/warc-fields")
    data += plain_record("response", http, **kind)
    data += plain_record("response", http, WARC_Block_Digest="sha256:" + hashlib.sha256(http).hexdigest(), WARC_Payload_Digest="md5:" + hashlib.md5(b"body").hexdigest(), **kind)
    data += plain_record("response", http, WARC_Payload_Digest="unknown:xyz", **kind)
    data += plain_record("revisit", b"", WARC_Payload_Digest="sha1:ABC", WARC_Refers_To="<urn:uuid:1>")
    data += plain_record("resource", b"HTTP/1.1 no header", Content_Type="text/plain", WARC_Target_URI="u:x")
    got = [(r[5], r[2], r[3], r[4]) for r in warc.read_records(io.BytesIO(data))]
    digest = warc.sha1_base32(b"body")
    assert got == [("warcinfo", b"software: x\r\n", 13, warc.sha1_base32(b"software: x\r\n")), *[("response", b"body", 4, digest)] * 3, ("revisit", None, None, "ABC"), ("resource", b"HTTP/1.1 no header", 18, warc.sha1_base32(b"HTTP/1.1 no header"))]
    for bad in (plain_record("response", http, WARC_Payload_Digest="md5:" + "0" * 32, **kind), plain_record("response", http, WARC_Block_Digest="sha1:" + "A" * 32, **kind), plain_record("response", b"HTTP/1.1 200 OK", **kind)):
        with pytest.raises(warc.WarcError):
            list(warc.read_records(io.BytesIO(bad)))


def test_inflated_blocks_are_bounded():
    payload = b"\0" * (50 << 20)
    data = gzip.compress(warc.record("response", 1, "u", payload, warc.sha1_base32(payload), len(payload)))
    member = warc.Member(io.BytesIO(data), 4096)
    assert member.begin()
    while member.read(1 << 30):
        assert len(member.data) <= 4096


def test_many_repeated_digests_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", 0)
    out = records(spark, [(i, f"u{i % 5}", "same" if i % 2 else f"own {i // 4}", None) for i in range(60)])
    assert Counter((r["record_type"], r["refers_to"]) for r in out)[("revisit", 59)] == 29
    assert sum(r["record_type"] == "response" for r in out) == 1 + 15


def brute_table(names, size):
    """Turn by turn, by the definition."""
    order = {n: [(sharding._hash(n, b"offset") + j * (sharding._hash(n, b"step") % (size - 1) + 1)) % size for j in range(size)] for n in names}
    table = {}
    while len(table) < size:
        for n in sorted(names):
            if len(table) < size:
                table[next(s for s in order[n] if s not in table)] = n
    return [table[i] for i in range(size)]


def test_lookup_table():
    names = ["c", "a", "b", "d"]
    got = sharding.lookup_table(names, 211)
    assert [names[i] for i in got] == brute_table(names, 211)
    counts = Counter(got.tolist())
    assert max(counts.values()) - min(counts.values()) <= 1
    less = sharding.lookup_table(["a", "b", "c"], 211)
    moved = sum(names[x] != ["a", "b", "c"][y] for x, y in zip(got, less) if names[x] != "d")
    assert moved < 211 * 0.25
    weighted = Counter(sharding.lookup_table({"a": 1.0, "b": 3.0}, 1009).tolist())
    assert abs(weighted[1] / weighted[0] - 3) < 0.1
    for bad in ([], ["a", "a"], {"a": 0.0}):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad, 211)
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 210)


def test_assign(spark):
    names = [f"s{i}" for i in range(5)]
    rows = [(1, "x", "old"), (1, "x", "old"), (None, None, None), (2, "", "old"), (-(1 << 60), "é", "old")]
    df = spark.createDataFrame(rows, "id long, text string, SLOT string")
    out = sharding.assign(df, ["id"], names, 211)
    assert out.columns == ["id", "text", "slot", "shard"] and out.count() == 5
    table = sharding.lookup_table(names, 211)
    for r in out.collect():
        h = 42 if r["id"] is None else xxhash.xxh64_intdigest((r["id"] & ((1 << 64) - 1)).to_bytes(8, "little"), 42)
        slot = (h - (1 << 64) if h >> 63 else h) % 211
        assert (r["slot"], r["shard"]) == (slot, names[table[slot]])
    assert sharding.assign(df.limit(0), ["id", "text"], names, 211).count() == 0
    assert "Broadcast" in out._jdf.queryExecution().executedPlan().toString()


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.Example.com", "/en/", "allow"), ("net", "/es", "block"), ("net", "/es", "allow"), ("x.org", None, "block"), (None, "/", "block"), ("", "/", "block"), ("y.org", "/", None)]


def brute_verdict(url, rules=RULES):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:].split("?")[0].split("#")[0]
    fits = [(len(h + (p or "")), len(h), h.lower() + (p or ""), v) for h, p, v in rules if h and v and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p or "")]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


URLS = [None, "", "no scheme/", "http://example.com/en/x?y#z", "HTTP://WWW.EXAMPLE.com/en/", "https://a.b.example.com/EN/", "http://notexample.com/en/", "http://com", "http://com/", "http://.com/x", "http://a.net/esx", "http://a.net/e", "http://x.org", "http://a.x.org?q=http://b.com/", "http://É.COM/", "ftp://u:p@a.com:80/", "http://a.com\n/x", "http://" + "a." * 5000 + "net/es/" + "y" * 10_000, "://net/es", "http://y.org/"]


def test_url_rules(spark):
    rows = [(i, u, "clash") for i, u in enumerate(URLS)] + [(3, URLS[3], "clash"), (None, URLS[3], "x"), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    want = sorted((repr(i), *map(repr, brute_verdict(u))) for i, u, _ in rows)
    for limit in (8 << 20, 0):
        out = urlfilter.judge(pages, rules, broadcast_bytes=limit)
        assert out.columns == ["page_id", "host", "path", "rule", "verdict"]
        assert sorted(tuple(map(repr, r)) for r in out.collect()) == want
    # Prefixes of one hex digit collide; the digest decides.
    assert sorted(tuple(map(repr, r)) for r in urlfilter.judge(pages, rules, prefix_hex=1).collect()) == want
    assert {r["verdict"] for r in urlfilter.judge(pages, rules.limit(0), default="block").collect()} == {"block"}
    assert urlfilter.judge(pages.limit(0), rules).count() == 0
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_url_rules_of_many_hosts(spark):
    rnd = random.Random(8)
    label = lambda: rnd.choice("abcd") * rnd.randrange(1, 3)
    path = lambda: "/" + "".join(rnd.choice("xy/") for _ in range(rnd.randrange(6)))
    rules = [(".".join(label() for _ in range(rnd.randrange(1, 4))), path(), rnd.choice(["allow", "block"])) for _ in range(400)]
    verdicts = {}
    for h, p, v in rules:
        verdicts[h, p] = max(verdicts.get((h, p), ""), v)
    rules = [(h, p, v) for (h, p), v in verdicts.items()]
    urls = [(i, f"http://{'.'.join(label() for _ in range(rnd.randrange(1, 5)))}{path()}{path()}") for i in range(500)]
    out = urlfilter.judge(spark.createDataFrame(urls, "page_id long, url string").repartition(3), spark.createDataFrame(rules, "host string, path string, verdict string"))
    want = {i: brute_verdict(u, rules) for i, u in urls}
    assert {r["page_id"]: tuple(r)[1:] for r in out.collect()} == want


def test_a_row_that_fills_the_table(spark):
    """Copies are made again by the partition they came from, never all in one row."""
    pages = spark.range(0, 30_000, 1, 6).select((F.col("id") * 0).alias("page_id"), F.lit("http://a.net/es/").alias("url"))
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    out = urlfilter.judge(pages, rules)
    assert out.count() == 30_000 and out.distinct().count() == 1
