"""WARC archives inside ZIP packages: written by Spark tasks, read back by ranges.

A package holds two stored (not compressed) members: ``archive/data.warc.gz``, one gzip member per
record, and ``indexes/index.cdxj``, one line per record.  The reader never extracts a package: it
reads the end record, the ZIP64 record if there is one, the central directory and one local header,
then the index, and later only the byte ranges of records.

Packages lie below ``spark.checkpoint.dir`` and are opened through ``pyarrow.fs`` (local and mounted
folders, HDFS, object stores).  A task writes under a name of its own and moves the whole file to its
final name, so a task that ran twice leaves one complete package; a stored manifest lists them.

A null payload is empty, a null url leaves out the header, a null id is kept as null (it counts as
smaller than any id), rows that repeat an id and a payload are equal records of the same type, an
empty table gives no package and an empty result; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import cut, scratch_path
from .common import text_column

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
URN = "urn:linkloom:page:"
#: A package is closed at this size; records are read in runs of at most this many bytes.
PACKAGE_BYTES, RUN_BYTES = 256 << 20, 8 << 20
DATE = "2024-01-01T00:00:00Z"
RECORD_SCHEMA = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"


# -- records ----------------------------------------------------------------------------------------
def record_bytes(page_id, url, kind: str, digest: str, size: int, refers_to, payload: bytes) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{URN}{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <{URN}{refers_to}>")
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode().split("\r\n")[1:]
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}


def _page(text: str) -> int | None:
    inner = text.strip("<>").removeprefix(URN)
    return int(inner) if inner else None


def parse_record(raw: bytes) -> tuple:
    """Row of ``RECORD_SCHEMA``; a response is measured and digested anew, a revisit says what it was."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = _headers(head)
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, url = warc["warc-type"], warc.get("warc-target-uri")
    if url is not None:
        url = url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    if kind == "response":
        size, digest, refers = len(payload), hashlib.sha1(payload).hexdigest(), None
        if f"sha1:{digest}" != warc["warc-payload-digest"]:
            raise ValueError(f"payload of {warc['warc-record-id']} does not match its digest")
    else:
        size, digest, payload = int(_headers(http)["content-length"]), warc["warc-payload-digest"].removeprefix("sha1:"), None
        refers = _page(warc["warc-refers-to"])
    return _page(warc["warc-record-id"]), url, kind, size, digest, refers, payload


# -- ZIP directories --------------------------------------------------------------------------------
def zip_members(read_at: Callable[[int, int], bytes], size: int) -> dict[str, tuple[int, int, int]]:
    """``{name: (place of the local header, stored bytes, method)}`` from the central directory."""
    tail_at = max(0, size - 65_557)
    tail = read_at(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    n, length, at = struct.unpack_from("<HII", tail, end + 10)
    if n == 0xFFFF or length == 0xFFFFFFFF or at == 0xFFFFFFFF:
        if end < 20 or tail[end - 20 : end - 16] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        big = read_at(struct.unpack_from("<Q", tail, end - 12)[0], 56)
        if big[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record")
        n, length, at = struct.unpack_from("<QQQ", big, 32)
    directory, found, pos = read_at(at, length), {}, 0
    for _ in range(n):
        if directory[pos : pos + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, = struct.unpack_from("<H", directory, pos + 10)
        packed, plain, name_n, extra_n, comment_n = struct.unpack_from("<IIHHH", directory, pos + 20)
        place, = struct.unpack_from("<I", directory, pos + 42)
        name = directory[pos + 46 : pos + 46 + name_n].decode()
        extra = directory[pos + 46 + name_n : pos + 46 + name_n + extra_n]
        while len(extra) >= 4:
            tag, own = struct.unpack_from("<HH", extra)
            if tag == 1:  # the 64-bit values, only of those fields that are full
                wide = iter(struct.unpack_from(f"<{own // 8}Q", extra, 4))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                place = next(wide) if place == 0xFFFFFFFF else place
            extra = extra[4 + own :]
        found[name] = (place, packed, method)
        pos += 46 + name_n + extra_n + comment_n
    return found


def member_range(read_at: Callable[[int, int], bytes], member: tuple[int, int, int]) -> tuple[int, int]:
    """Place and length of a stored member's bytes."""
    place, length, method = member
    if method != 0:
        raise ValueError("only stored members can be read by ranges")
    local = read_at(place, 30)
    if local[:4] != b"PK\x03\x04":
        raise ValueError("broken local header")
    name_n, extra_n = struct.unpack_from("<HH", local, 26)
    return place + 30 + name_n + extra_n, length


# -- Spark jobs -------------------------------------------------------------------------------------
def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def mark_revisits(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """``page_id, url, payload`` and what the record will say: type, digest, size, referred page."""
    body = text_column("html")
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("payload"),
        F.sha1(body.cast("binary")).alias("digest"), F.octet_length(body).cast("long").alias("size"),
    )
    big = base.where(F.col("size") >= min_bytes).groupBy("digest", "size")
    same = big.agg(F.max("page_id").alias("latest"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    rows = base.join(cut(same, "copies"), ["digest", "size"], "left")
    older = F.col("latest").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("latest")))
    return rows.select(
        "page_id", "url", "digest", "size", F.when(older, F.lit("revisit")).otherwise(F.lit("response")).alias("kind"),
        F.when(older, F.col("latest")).alias("refers_to"), F.when(~older, F.col("payload")).otherwise(F.lit("")).alias("payload"),
    )


def write_packages(marked: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write one or more packages per task; returns the manifest ``package, bytes, records``."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        store.create_dir(root, recursive=True)
        part, made = TaskContext.get().partitionId(), 0
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        row = next(rows, None)
        while row is not None:
            final = f"{root}/part-{part:06d}-{made:04d}.zip"
            draft, index, at = f"{root}/_{uuid.uuid4().hex}", [], 0
            with store.open_output_stream(draft) as sink, zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED) as package:
                with package.open(DATA, "w", force_zip64=True) as data:
                    while row is not None and at < package_bytes:
                        page_id, url, digest, size, kind, refers_to, payload = row
                        raw = record_bytes(page_id, url, kind, digest, size, refers_to, payload.encode())
                        packed = gzip.compress(raw, 6, mtime=0)
                        data.write(packed)
                        index.append(json.dumps({"page_id": page_id, "type": kind, "offset": at, "length": len(packed)}))
                        at += len(packed)
                        row = next(rows, None)
                package.writestr(INDEX, "\n".join(index))
            length = store.get_file_info(draft).size
            store.move(draft, final)
            yield pa.RecordBatch.from_arrays([pa.array([final.rsplit("/", 1)[1]]), pa.array([length]), pa.array([len(index)])], ["package", "bytes", "records"])
            made += 1

    ordered = marked.select("page_id", "url", "digest", "size", "kind", "refers_to", "payload")
    return cut(ordered.mapInArrow(write, "package string, bytes bigint, records bigint"), "manifest")


def list_records(packages: DataFrame, folder: str) -> DataFrame:
    """Where each record lies: ``package, at, length`` (``at`` counts from the start of the package)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_file(f"{root}/{name}") as f:
                    read_at = lambda at, n, f=f: f.read_at(n, at)
                    members = zip_members(read_at, f.size())
                    base, _ = member_range(read_at, members[DATA])
                    at, length = member_range(read_at, members[INDEX])
                    lines = [json.loads(x) for x in read_at(at, length).splitlines()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(lines)), pa.array([base + x["offset"] for x in lines], pa.int64()), pa.array([x["length"] for x in lines], pa.int64())],
                    ["package", "at", "length"],
                )

    return packages.select("package").mapInArrow(read, "package string, at bigint, length bigint")


def read_records(places: DataFrame, folder: str, run_bytes: int = RUN_BYTES, tasks: int | None = None) -> DataFrame:
    """Range-read the given records; neighbours are fetched in one read.

    The places are small rows that stand for large reads, so the number of ``tasks`` is best given.
    """
    dealt = places.withColumn("__run", F.floor(F.col("at") / run_bytes))
    dealt = (dealt.repartition(tasks, "package", "__run") if tasks else dealt.repartition("package", "__run")).sortWithinPartitions("package", "at").select("package", "at", "length")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

        def fetch(name: str, run: list[tuple[int, int]]) -> pa.RecordBatch:
            start, end = run[0][0], sum(run[-1])
            with store.open_input_file(f"{root}/{name}") as f:
                raw = f.read_at(end - start, start)
            rows = [parse_record(gzip.decompress(raw[a - start : a - start + n])) for a, n in run]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

        name, run = None, []
        for batch in batches:
            for package, at, length in zip(*(c.to_pylist() for c in batch.columns)):
                if run and (package != name or at != sum(run[-1]) or at + length - run[0][0] > run_bytes):
                    yield fetch(name, run)
                    run = []
                name = package
                run.append((at, length))
        if run:
            yield fetch(name, run)

    return dealt.mapInArrow(read, RECORD_SCHEMA)


def round_trip(spark: SparkSession, pages: DataFrame, min_bytes: int = 1000, folder: str | None = None) -> DataFrame:
    """Write the pages as packages and read every record back (``RECORD_SCHEMA``)."""
    folder = folder or scratch_path(spark, "warc")
    manifest = write_packages(mark_revisits(pages, min_bytes), folder)
    size = manifest.agg(F.sum("bytes")).first()[0] or 0
    return read_records(list_records(manifest, folder), folder, tasks=1 + size // RUN_BYTES)
