"""Archives: an exact round trip, ZIP64 directories, and the digest against a plain computation."""

import hashlib
import io
import struct
import zipfile

import pytest

from linkloom.functions.scratch import scratch_path
from linkloom.llm import warc_zip as w

SCHEMA = "page_id bigint, url string, html string, digest string"


def test_round_trip(spark):
    big = "<p>é" * 400
    rows = [(1, "http://a", big, None), (2, "http://b\r\nx%", big, "z"), (3, None, big, None), (3, None, big, None), (4, "u", "short", None), (5, "u", "short", None)]
    rows += [(6, "u", None, None), (7, "u", "", None), (None, "n", big, None), (None, "n", "tiny", None), (8, "l", "x\r\n\r\n" * 90_000, None)]
    pages = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = w.round_trip(spark, pages).collect()
    assert len(got) == len(rows)
    want = []
    for i, url, html, _ in rows:
        raw = (html or "").encode()
        older = len(raw) >= 1000 and html == big and i != 3
        want.append((i, url, "revisit" if older else "response", len(raw), hashlib.sha1(raw).hexdigest(), 3 if older else None, None if older else raw))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, got)) == sorted(map(key, map(tuple, want)))


def test_several_packages_and_none(spark):
    pages = spark.createDataFrame([(i, "u", f"page {i} " * 50, None) for i in range(40)], SCHEMA).coalesce(1)
    folder = scratch_path(spark, "warc")
    manifest = w.write_packages(w.mark_revisits(pages), folder, package_bytes=500)
    assert manifest.count() > 3
    assert {r.page_id for r in w.read_records(w.list_records(manifest, folder), folder, run_bytes=300).collect()} == set(range(40))
    assert w.round_trip(spark, pages.limit(0)).count() == 0


def test_zip64_fields():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as z:
        z.writestr("a", b"first")
        with z.open("b", "w", force_zip64=True) as f:
            f.write(b"second one")
    plain = raw.getvalue()
    read = lambda data: lambda at, n: data[at : at + n]
    found = w.zip_members(read(plain), len(plain))
    at, n = w.member_range(read(plain), found["b"])
    assert plain[at : at + n] == b"second one"
    # the same directory with every 32-bit field moved to ZIP64
    end = plain.rfind(b"PK\x05\x06")
    count, size, start = struct.unpack_from("<HII", plain, end + 10)
    entries, pos = b"", start
    for name, (place, packed, _) in found.items():
        head = bytearray(plain[pos : pos + 46])
        extra_n, = struct.unpack_from("<H", plain, pos + 30)
        struct.pack_into("<II", head, 20, 0xFFFFFFFF, 0xFFFFFFFF)
        struct.pack_into("<I", head, 42, 0xFFFFFFFF)
        extra = struct.pack("<HH", 9, 2) + b"zz" + struct.pack("<HHQQQ", 1, 24, packed, packed, place)
        struct.pack_into("<H", head, 30, len(extra))
        entries += bytes(head) + name.encode() + extra
        pos += 46 + 1 + extra_n
    big = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, count, count, len(entries), start)
    data = plain[:start] + entries + big + struct.pack("<4sIQI", b"PK\x06\x07", 0, start + len(entries), 1)
    data += struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    assert w.zip_members(read(data), len(data)) == found
    with pytest.raises(ValueError):
        w.zip_members(read(b"no archive"), 10)
