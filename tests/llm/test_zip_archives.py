import base64
import hashlib
import io
import zipfile

import pytest

from palimpsest.llm import zip_archives as za
from palimpsest.llm.common import shared_path


def package(n=25, **more):
    out = io.BytesIO()
    records = [(str(i), za.record_bytes(i, f"http://a/{i}", b"x" * i, refers_to=None if i % 3 else 1)) for i in range(n)]
    za.write_package(out, iter(records), **more)
    return out.getvalue()


@pytest.mark.parametrize("zip64", [True, False])
def test_members_equal_zipfile(zip64):
    data = package(zip64=zip64)
    reader = za.PackageReader(za.BytesSource(data))
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert set(z.namelist()) == set(reader.members)
        for name in z.namelist():
            assert z.read(name) == reader.read(name)
    assert [r["page_id"] for r in reader.records()] == list(range(25))
    assert [r["payload_bytes"] for r in reader.records()] == list(range(25))


def test_zip64_directory_and_comment():
    """A ZIP64 end record, its locator and a comment that holds the end signature."""
    import struct

    data = package()
    end = data.rfind(za.END)
    count, length, start = struct.unpack_from("<HLL", data, end + 10)
    end64 = za.END64 + struct.pack("<QHHLLQQQQ", 44, 45, 45, 0, 0, count, count, length, start)
    locator = za.END64_LOCATOR + struct.pack("<LQL", 0, end, 1)
    comment = b"note " + za.END + b" and more text here ....."
    plain = za.END + struct.pack("<HHHHLLH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, len(comment)) + comment
    reader = za.PackageReader(za.BytesSource(data[:end] + end64 + locator + plain))
    assert len(list(reader.records())) == 25


def test_broken_files():
    with pytest.raises(ValueError):
        za.PackageReader(za.BytesSource(b"nothing here"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(za.INDEX_MEMBER, "x" * 1000)
    with pytest.raises(ValueError):
        za.PackageReader(za.BytesSource(out.getvalue())).index()


def test_small_reads(monkeypatch):
    monkeypatch.setattr(za, "READ_BYTES", 700)
    assert len(list(za.PackageReader(za.BytesSource(package())).records())) == 25


def test_round_trip(spark):
    rows = [(3, "u3", "same"), (1, "u 1\r\nx", "same"), (2, None, None), (7, "u7", ""), (5, "u5", "é" * 5000), (None, "n", "same"), (None, "m", "lonely"), (9, "u9", "one"), (9, "u9", "one")]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, payload_bytes int").repartition(3)
    for size in (1, 1 << 20):
        uri = shared_path(spark, "warc-test")
        manifest = za.write_packages(za.with_references(pages.select("page_id", "url", "html")), uri, package_bytes=size)
        got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in za.read_packages(spark, manifest, uri).collect()), key=repr)
        want = []
        for pid, _, html in rows:
            payload = (html or "").encode()
            first = min((p for p, _, h in rows if (h or "") == (html or "") and p is not None), default=None)
            revisit = first is not None and pid != first
            want.append((pid, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
        assert got == sorted(want, key=repr)
        payloads = {r.page_id: r.payload for r in za.read_packages(spark, manifest, uri, payloads=True).collect() if r.record_type == "response"}
        assert bytes(payloads[5]) == ("é" * 5000).encode() and 3 not in payloads
    empty = za.write_packages(za.with_references(pages.select("page_id", "url", "html").limit(0)), shared_path(spark, "warc-test"))
    assert za.read_packages(spark, empty, shared_path(spark, "warc-test")).collect() == []
