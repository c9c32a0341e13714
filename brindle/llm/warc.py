"""WARC archives: a writer with deduplicating revisit records, and a sequential reader.

One gzip member for each record. The reader decompresses a stream in blocks that
are bounded on both sides, finds the member's end by zlib, frames the record by
Content-Length and verifies digests as the block goes by; it holds a payload
only where that is asked for. Files lie in the shared folder; each is
written under a name of its own and counts only once its name is in the
manifest, a Parquet table that Spark commits, so lost executors and repeated
tasks leave no half files behind in the result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import open_fs, shared_dir, written
from .words import parted

FILE_BYTES = 256 << 20
READ_BYTES = 1 << 20
#: Of a record's header, and of the HTTP header within its block.
HEADER_BYTES = 1 << 20
#: Digests of repeated payloads that are broadcast at most; beyond, pages meet them by salted keys.
BROADCAST_DIGESTS, SALTS = 200_000, 16
GZIP_LEVEL = 5
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, records long, bytes long"
RECORDS = "page_id long, target_uri string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, file string"


class WarcError(ValueError):
    """A record that breaks its framing or its digests."""


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, payload_bytes: int, refers_to: int | None = None, date: str | None = None) -> bytes:
    """One uncompressed record. Control characters of the URL are percent-encoded."""
    name = f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"
    head = HTTP_HEAD % payload_bytes
    block = head + payload
    fields = [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Date", date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"))]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}")]
    if kind == "revisit":
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


class Member:
    """What the current gzip member of a stream holds, decompressed a bounded block at a time."""

    def __init__(self, stream, read_bytes: int = READ_BYTES):
        self.stream, self.read_bytes, self.packed, self.data = stream, read_bytes, b"", b""
        self.inflate = None

    def begin(self) -> bool:
        """Go on to the next member; False at the stream's end. What is left of the current one is passed over."""
        while self.inflate is not None and self._more():
            self.data = b""
        self.packed = self.packed or self.stream.read(self.read_bytes)
        self.data, self.inflate = b"", zlib.decompressobj(31)
        return bool(self.packed)

    def _more(self) -> bool:
        """Decompress at most ``read_bytes`` more; False at the member's end."""
        while not self.inflate.eof:
            self.packed = self.packed or self.stream.read(self.read_bytes)
            if not self.packed:
                raise WarcError("the stream ends inside a gzip member")
            try:
                out = self.inflate.decompress(self.packed, self.read_bytes)
            except zlib.error as e:
                raise WarcError(f"damaged gzip member: {e}") from e
            self.packed = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            if out:
                self.data += out
                return True
        return False

    def read(self, size: int) -> bytes:
        """At most ``size`` bytes, none only at the member's end."""
        if not self.data and size:
            self._more()
        out, self.data = self.data[:size], self.data[size:]
        return out

    def head(self, most: int = HEADER_BYTES) -> bytes:
        """Up to the first empty line, which is passed over."""
        while (end := self.data.find(b"\r\n\r\n", 0, most)) < 0:
            if len(self.data) >= most or not self._more():
                raise WarcError("no header that an empty line ends")
        out, self.data = self.data[:end], self.data[end + 4 :]
        return out


def fields_of(head: bytes) -> dict[str, str]:
    """Header fields of a record, names in lower case; folded lines are joined."""
    lines = head.split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise WarcError("no WARC header")
    fields: dict[str, str] = {}
    name = ""
    for line in lines[1:]:
        text = line.decode("utf-8", "replace")
        if text[:1] in " \t" and name:
            fields[name] += " " + text.strip()
            continue
        name, colon, value = text.partition(":")
        name = name.strip().lower()
        if not colon:
            raise WarcError(f"bad header line {text!r}")
        fields[name] = value.strip()
    return fields


class _Digest:
    """A digest as a header states it: ``sha1:`` (or another algorithm) and base32 or hex; unknown algorithms are not checked."""

    def __init__(self, said: str | None):
        name, _, self.want = (said or "").partition(":")
        self.state = hashlib.new(name.lower()) if self.want and name.lower() in ("md5", "sha1", "sha256", "sha512") else None

    def update(self, data: bytes) -> None:
        if self.state:
            self.state.update(data)

    def holds(self) -> bool:
        if not self.state:
            return True
        raw = self.state.digest()
        return self.want.rstrip("=").upper() == base64.b32encode(raw).decode().rstrip("=") or self.want.lower() == raw.hex()


def _page(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def read_records(stream, file: str = "", with_payload: bool = True, read_bytes: int = READ_BYTES) -> Iterator[tuple]:
    """Tuples as ``RECORDS``, one for each record of any type.

    The payload of a response or revisit is what follows the HTTP header, of
    other records the whole block. A revisit's payload is null; its size is the
    Content-Length of the HTTP header it keeps, its digest the stated one. Block
    and payload digests are verified where the header has them; a response's
    SHA-1 is worked out in any case. The page id is null unless the record's
    name is one of ``write_archives``.
    """
    member = Member(stream, read_bytes)
    while member.begin():
        fields = fields_of(member.head())
        name, kind, size = fields.get("warc-record-id"), fields.get("warc-type", ""), fields.get("content-length", "")
        if not size.isdigit():
            raise WarcError(f"no Content-Length frames {name}")
        left, http = int(size), fields.get("content-type", "").replace(" ", "").startswith("application/http") and int(size) > 0
        block, payload, own = _Digest(fields.get("warc-block-digest")), _Digest(fields.get("warc-payload-digest") if kind != "revisit" else None), hashlib.sha1()
        head, in_head, held, length = b"", http, [], 0
        while left:
            data = member.read(left)
            if not data:
                raise WarcError(f"Content-Length doesn't frame {name}")
            left -= len(data)
            block.update(data)
            if in_head:
                head += data
                end = head.find(b"\r\n\r\n")
                if end < 0:
                    if len(head) > HEADER_BYTES:
                        raise WarcError(f"the HTTP header of {name} is too long")
                    continue
                head, data, in_head = head[:end], head[end + 4 :], False
            length += len(data)
            own.update(data)
            payload.update(data)
            if with_payload:
                held.append(data)
        if member.read(4) + member.read(4) + member.read(4) + member.read(4) != b"\r\n\r\n":
            raise WarcError(f"Content-Length doesn't frame {name}")
        if not block.holds():
            raise WarcError(f"block digest of {name} doesn't hold")
        stated = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", head)
        if kind == "revisit":
            said = fields.get("warc-payload-digest")
            yield _page(name), fields.get("warc-target-uri"), None, int(stated[1]) if stated else None, said.removeprefix("sha1:") if said else None, kind, _page(fields.get("warc-refers-to")), file
            continue
        whole = "warc-truncated" not in fields and not re.search(rb"(?im)^transfer-encoding:", head)
        if in_head or (stated and whole and length != int(stated[1])) or not payload.holds():
            raise WarcError(f"payload of {name} doesn't hold")
        yield _page(name), fields.get("warc-target-uri"), b"".join(held) if with_payload else None, length, base64.b32encode(own.digest()).decode(), kind, None, file


def mark_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """``(page_id, url, payload, payload_bytes, digest, refers_to)`` of each page.

    Of pages with equal payloads of at least ``min_bytes`` the one with the
    largest id answers and the others refer to it and lose their payload. Null
    html is an empty payload. Rows that repeat the largest id all answer; a
    null id never answers for others, and where all ids are null none refers.
    Only digests that repeat enter the join, as a broadcast while they are at
    most ``BROADCAST_DIGESTS``: then payloads are never shuffled. Beyond, a hot
    digest's pages are salted by their id and URL.
    """
    payload = F.coalesce(F.col(f"`{html_col}`").cast("string").cast("binary"), F.lit(b""))
    p = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload"))
    p = p.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1("payload"))
    first = p.where(F.col("payload_bytes") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    first = written(first.where("n > 1 and first_id is not null").select("digest", "first_id"), "repeated")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    if first.count() <= BROADCAST_DIGESTS:
        p = p.join(F.broadcast(first), "digest", "left")
    else:
        salted = first.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        p = p.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS))).join(salted, ["digest", "salt"], "left")
    return p.select("page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "payload_bytes", "digest", F.when(revisit, F.col("first_id")).alias("refers_to"))


def write_archives(marked: DataFrame, folder: str, file_bytes: int = FILE_BYTES, level: int = GZIP_LEVEL) -> DataFrame:
    """Write the rows of ``mark_revisits`` as ``.warc.gz`` files; returns the manifest (file, records, bytes).

    A task makes records of about 1 MB of pages at a time, of one where that is
    longer, and starts a new file once one has ``file_bytes``.
    """
    spark = marked.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        out, name, records, size = None, "", 0, 0
        for batch in batches:
            for rows, payloads in parted(batch, 2):
                page_ids, urls, _, sizes, digests, refer = rows.columns
                for page_id, url, payload, payload_bytes, digest, refers_to in zip(page_ids.to_pylist(), urls.to_pylist(), payloads, sizes.to_pylist(), digests.to_pylist(), refer.to_pylist()):
                    if out is None:
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        out, records, size = fs.open_output_stream(f"{base}/{name}"), 0, 0
                    kind = "response" if refers_to is None else "revisit"
                    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
                    member = squeeze.compress(record(kind, page_id, url, payload or b"", base64.b32encode(bytes.fromhex(digest)).decode(), payload_bytes, refers_to, date)) + squeeze.flush()
                    out.write(member)
                    records, size = records + 1, size + len(member)
                    if size >= file_bytes:
                        out.close()
                        yield pa.RecordBatch.from_pydict({"file": [name], "records": [records], "bytes": [size]})
                        out = None
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "records": [records], "bytes": [size]})

    marked = marked.select("page_id", "url", "payload", "payload_bytes", "digest", "refers_to")
    marked.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_archives(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """All records of the files that the folder's manifest lists, one task a file, as ``RECORDS``."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        schema = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in RECORDS.split(", "))])

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(f"{base}/{file}") as stream:
                    for row in read_records(stream, file, with_payload):
                        held += len(row[2] or b"")
                        rows.append(row)
                        if len(rows) >= 5000 or held >= 16 << 20:
                            yield made(rows)
                            rows, held = [], 0
                if rows:
                    yield made(rows)

    files = max(1, manifest.count())
    return manifest.select("file").repartition(files).mapInArrow(read, RECORDS)


def archive(pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> str:
    """Write all pages as archives; returns the folder."""
    folder = folder or shared_dir(pages.sparkSession, "warc")
    write_archives(mark_revisits(pages, min_bytes=min_bytes), folder)
    return folder
