"""WARC records inside ZIP packages, written and range-read without extraction.

A package holds stored members: ``archive/data.warc.gz`` (one gzip member for
each record) and ``indexes/index.cdx`` (one line for each record with its place).
The reader finds the end-of-directory record from the file's tail, follows the
ZIP64 locator where there is one, walks the central directory, resolves the data
offset of stored members from their local headers, reads the index and then only
the byte ranges of records, neighbouring ranges in one read.

Files lie below a URI that pyarrow's file systems can open (local, HDFS, S3, ...).
Tasks give every package a new name, and only packages named in the written
manifest are read, so a repeated task does no harm.

Defined results: null html is an empty payload; of rows with one payload that
with the smallest id is the response (rows repeating that id too, and rows
without an id where no row of the payload has one); an empty table gives no
package and no rows; urls with blanks or control characters are percent-encoded; a payload of
any length is one record, whole in one task; other columns are not read.
"""
from __future__ import annotations

import base64
import gzip
import hashlib

import struct
import uuid
import zipfile
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path, shuffle_width, table, written

PACKAGE_BYTES = 64 << 20
SALTS = 16
READ_BYTES = 4 << 20
WARC_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdx"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

# Fixed values of the ZIP format: signatures and the layouts after them.
END, END64_LOCATOR, END64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x07", b"PK\x06\x06", b"PK\x01\x02", b"PK\x03\x04"


def open_store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


# --- records -------------------------------------------------------------------------------------------------


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id, url: str | None, payload: bytes, refers_to=None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One WARC record, gzipped; a revisit keeps the HTTP head (with the payload's length) but not the payload."""
    revisit = refers_to is not None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if not revisit:
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
            f"WARC-Target-URI: {quote(url or '', safe=';/?:@&=+$,#%[]!~*()')}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest32(payload)}"]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 5, mtime=0)


def parse_record(data: bytes) -> dict:
    """Headers, payload (None for a revisit), payload_bytes and payload_digest of one gzipped record; the digest is checked."""
    raw = gzip.decompress(data)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record at this place")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    revisit = fields["warc-type"] == "revisit"
    if not revisit and (len(payload) != length or digest32(payload) != digest):
        raise ValueError("payload and its digest differ")
    number = lambda name: int(v) if (v := fields.get(name, "").removeprefix("<urn:page:").removesuffix(">")) else None
    return {"page_id": number("warc-record-id"), "url": fields["warc-target-uri"], "record_type": fields["warc-type"], "refers_to": number("warc-refers-to"),
            "payload": None if revisit else payload, "payload_bytes": length, "payload_digest": digest}


# --- packages ------------------------------------------------------------------------------------------------


def write_package(stream, records: Iterator[tuple[str, bytes]], zip64: bool = True) -> int:
    """Write (index key, record) pairs as one package to a binary stream; gives the number of records."""
    index, at = [], 0
    with zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        with z.open(WARC_MEMBER, "w", force_zip64=zip64) as member:
            for key, data in records:
                member.write(data)
                index.append(f"{key} {at} {len(data)}\n")
                at += len(data)
        with z.open(INDEX_MEMBER, "w", force_zip64=zip64) as member:
            member.write("".join(index).encode())
    return len(index)


class PackageReader:
    """Members of a ZIP file by byte ranges.  ``source`` has size() and read_at(n, offset)."""

    def __init__(self, source):
        self.source, self.size = source, source.size()
        self.members = {m["name"]: m for m in self._directory()}

    def _directory(self) -> Iterator[dict]:
        tail_at = max(0, self.size - (22 + 0xFFFF + 20))
        tail = self.source.read_at(self.size - tail_at, tail_at)
        end = tail.rfind(END)
        while end >= 0 and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail):
            end = tail.rfind(END, 0, end)  # the signature stood in a comment
        if end < 0:
            raise ValueError("not a ZIP file: no end of the central directory")
        count, length, start = struct.unpack_from("<HLL", tail, end + 10)
        if end >= 20 and tail[end - 20 : end - 16] == END64_LOCATOR:
            at = struct.unpack_from("<Q", tail, end - 20 + 8)[0]
            record = self.source.read_at(56, at)
            if record[:4] != END64:
                raise ValueError("the ZIP64 locator points elsewhere")
            count, length, start = struct.unpack_from("<QQQ", record, 32)
        data, p = self.source.read_at(length, start), 0
        for _ in range(count):
            if data[p : p + 4] != CENTRAL:
                raise ValueError("broken central directory")
            method, = struct.unpack_from("<H", data, p + 10)
            packed, size, n_name, n_extra, n_comment = struct.unpack_from("<LLHHH", data, p + 20)
            offset, = struct.unpack_from("<L", data, p + 42)
            name = data[p + 46 : p + 46 + n_name].decode()
            extra, q = data[p + 46 + n_name : p + 46 + n_name + n_extra], 0
            while q + 4 <= len(extra):
                kind, n = struct.unpack_from("<HH", extra, q)
                if kind == 1:  # ZIP64: 8 bytes for each field that is all ones, in this order
                    wide, k = extra[q + 4 : q + 4 + n], 0
                    values = []
                    for v in (size, packed, offset):
                        if v == 0xFFFFFFFF and k + 8 <= len(wide):
                            v = struct.unpack_from("<Q", wide, k)[0]
                            k += 8
                        values.append(v)
                    size, packed, offset = values
                q += 4 + n
            yield {"name": name, "method": method, "size": size, "offset": offset}
            p += 46 + n_name + n_extra + n_comment

    def data_offset(self, name: str) -> int:
        """Where the bytes of a stored member begin."""
        m = self.members[name]
        if m["method"] != 0:
            raise ValueError(f"{name} is compressed; only stored members can be range-read")
        head = self.source.read_at(30, m["offset"])
        if head[:4] != LOCAL:
            raise ValueError(f"no local header for {name}")
        n_name, n_extra = struct.unpack_from("<HH", head, 26)
        return m["offset"] + 30 + n_name + n_extra

    def read(self, name: str, offset: int = 0, length: int | None = None) -> bytes:
        m = self.members[name]
        length = m["size"] - offset if length is None else length
        return self.source.read_at(length, self.data_offset(name) + offset)

    def index(self) -> list[tuple[str, int, int]]:
        """(key, offset, length) of every record."""
        rows = self.read(INDEX_MEMBER).decode().splitlines()
        return [(key, int(at), int(n)) for key, at, n in (r.split(" ") for r in rows)]

    def records(self) -> Iterator[dict]:
        """All records by the index; neighbouring ranges come in one read."""
        rows, base, i = sorted(self.index(), key=lambda r: r[1]), self.data_offset(WARC_MEMBER), 0
        while i < len(rows):
            j, start = i, rows[i][1]
            while j + 1 < len(rows) and rows[j + 1][1] == rows[j][1] + rows[j][2] and rows[j + 1][1] + rows[j + 1][2] - start <= READ_BYTES:
                j += 1
            data = self.source.read_at(rows[j][1] + rows[j][2] - start, base + start)
            for _, at, n in rows[i : j + 1]:
                yield parse_record(data[at - start : at - start + n])
            i = j + 1


class BytesSource:
    """A package in memory."""

    def __init__(self, data: bytes):
        self.data = data

    def size(self) -> int:
        return len(self.data)

    def read_at(self, n: int, offset: int) -> bytes:
        return self.data[offset : offset + n]


# --- Spark jobs ----------------------------------------------------------------------------------------------


def with_references(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """``pages`` with _first: the smallest id that has the same payload, null where no other page has it.

    Ids meet on digests alone, salted, and pages then on digest and id, so a payload that very
    many pages have doesn't bring them together.
    """
    digest = F.sha1(F.coalesce(F.col(html), F.lit("")).cast("binary"))
    ids = pages.select(digest.alias("_d"), F.col(page_id).alias("_id"))
    firsts = ids.groupBy("_d").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = ids.distinct().withColumn("_s", F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int"))
    refs = salted.join(firsts, ["_d", "_s"]).where("_id IS NULL OR _id <> _first").select("_d", "_id", "_first")
    rows = pages.withColumn("_digest", digest)
    return rows.join(refs, (F.col("_digest") == F.col("_d")) & F.col(page_id).eqNullSafe(F.col("_id")), "left").drop("_digest", "_d", "_id")


def write_packages(pages: DataFrame, uri: str, page_id: str = "page_id", url: str = "url", html: str = "html", package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write every row of ``pages`` (with _first) as a record; gives the written manifest (path, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(uri)
        store.create_dir(root, recursive=True)

        def rows():
            for batch in batches:
                yield from zip(*[c.to_pylist() for c in batch.columns])

        def records(source, more: list) -> Iterator[tuple[str, bytes]]:
            total = 0
            for pid, address, text, first in source:
                revisit = first is not None and pid != first
                data = record_bytes(pid, address, (text or "").encode(), first if revisit else None)
                yield ("-" if pid is None else str(pid)), data
                total += len(data)
                if total >= package_bytes:
                    return
            more.clear()

        source, more = rows(), [True]
        while more:
            name = f"{root.rstrip('/')}/{uuid.uuid4().hex}.wacz"
            with store.open_output_stream(name) as out:
                n = write_package(out, records(source, more))
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["path", "records"])

    return written(pages.select(page_id, url, html, "_first").mapInArrow(run, "path string, records long"), "packages")


def read_packages(spark: SparkSession, manifest: DataFrame, uri: str, payloads: bool = False) -> DataFrame:
    """One row for each record of the packages that the manifest names."""
    kinds = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string()}
    kinds |= {"payload": pa.binary()} if payloads else {}
    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + (", payload binary" if payloads else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(uri)
        for batch in batches:
            for path, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_file(path) as file:
                    block, seen = [], 0
                    for record in PackageReader(file).records():
                        block.append(record)
                        seen += 1
                        if len(block) == 1000:
                            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in block], t) for k, t in kinds.items()], names=list(kinds))
                            block = []
                    if seen != n:
                        raise ValueError(f"{path}: {seen} of {n} records")
                    if block:
                        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in block], t) for k, t in kinds.items()], names=list(kinds))

    return manifest.select("path", "records").repartition(shuffle_width(spark)).mapInArrow(run, schema)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = shared_path(spark, "warc")
    manifest = write_packages(with_references(table(spark, sf_dir, "pages").select("page_id", "url", "html")), uri)
    return read_packages(spark, manifest, uri).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages),
r AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (((('0x' || substr(d, (i // 4) * 5 + 1, 5))::BIGINT) >> (15 - 5 * (i % 4))) & 31)::BIGINT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM r
"""
