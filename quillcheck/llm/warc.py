"""WARC archives in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding whole WARC records, and ends with a seek table in a
skippable frame, so that plain decompressors read it too. An index maps every record to its bundle, its frame and its
place within the frame: one record is read by fetching one frame.

Tasks write bundles into the shared folder under names of their own attempt; only the index, written when all have
ended, says which files count. Files of an attempt that was lost are never read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillcheck.session import scratch_path, settled

REVISIT_FROM = 1000  # bytes; smaller payloads are stored again
MOST_HEAVY = 1000  # payloads that are looked up by broadcast
FRAME_BYTES = 256 << 10  # records before compression
BUNDLE_BYTES = 64 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"  # pages carry no date; a fixed one keeps archives reproducible
# Fixed values of the seekable format.
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX = "page_id long, record_id string, bundle string, frame int, offset long, length long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"


def _page_id(record_id: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", record_id or "")
    return int(m[1]) if m else None


def _clean(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, revisit: bool) -> tuple[str, bytes]:
    """(record id, bytes of the WARC record). A revisit holds the response's head only, with the full payload's size."""
    name = _record_id(page_id)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return name, "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[tuple[int, int, dict[str, str], dict[str, str], bytes]]:
    """(offset, length, WARC head, HTTP head, payload) of the records in ``data``."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = _fields(data[at:end])
        size = int(head["content-length"])
        block = data[end + 4 : end + 4 + size]
        if data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"record at {at} is not closed")
        http, _, payload = block.partition(b"\r\n\r\n")
        yield at, end + 8 + size - at, head, _fields(http), payload
        at = end + 8 + size


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode().split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


class BundleWriter:
    """Streams frames into a file; memory holds one frame and the seek table."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES):
        self.out, self.frame_bytes = out, frame_bytes
        self.open_, self.size, self.frames, self.written = [], 0, [], 0
        self.zstd = zstandard.ZstdCompressor(level=3, write_checksum=True)

    def add(self, data: bytes) -> tuple[int, int]:
        """(frame, place within it) of the record."""
        if self.size and self.size + len(data) > self.frame_bytes:
            self.flush()
        place = len(self.frames), self.size
        self.open_.append(data)
        self.size += len(data)
        return place

    def flush(self) -> None:
        if self.open_:
            packed = self.zstd.compress(b"".join(self.open_))
            self.out.write(packed)
            self.frames.append((len(packed), self.size))
            self.written += len(packed)
            self.open_, self.size = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, _SEEKABLE)
        self.out.write(struct.pack("<II", _SKIPPABLE, len(table)) + table)
        self.out.close()


class BundleReader:
    """Random access to the frames of a bundle by its seek table."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        n, flags, magic = struct.unpack("<IBI", file.read_at(9, size - 9))
        if magic != _SEEKABLE:
            raise ValueError("no seek table")
        entry = 12 if flags & 0x80 else 8
        table = file.read_at(n * entry, size - 9 - n * entry)
        self.frames, at = [], 0
        for k in range(n):
            packed, plain = struct.unpack_from("<II", table, k * entry)
            self.frames.append((at, packed, plain))
            at += packed
        self.zstd = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> bytes:
        at, packed, plain = self.frames[k]
        return self.zstd.decompress(self.file.read_at(packed, at), max_output_size=plain)


def _at(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path)


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, size, refers_to and revisit of every row.

    Of equal payloads of ``REVISIT_FROM`` bytes or more, that with the largest page_id is the response (rows that share
    that page_id are each); without any page_id all are. Only ids and digests are aggregated. Payloads that make up more
    than a thousandth of all repeated bytes, a thousand at most, are looked up without a shuffle; the join by digest
    then deals their rows out by page.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    p = p.withColumns({"digest": F.sha1("html"), "size": F.octet_length("html").cast("long")})
    groups = p.where(F.col("size") >= REVISIT_FROM).groupBy("digest", "size").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = settled(groups.where("n > 1 AND first IS NOT NULL"), "copies")
    total = groups.agg(F.sum(F.col("n") * F.col("size"))).first()[0] or 0
    heavy = groups.where(F.col("n") * F.col("size") > total / MOST_HEAVY).select("digest", F.col("first").alias("known"))
    both = p.join(F.broadcast(heavy), "digest", "left")  # fewer than MOST_HEAVY rows
    apart = F.when(F.col("known").isNull(), F.col("digest")).otherwise(F.concat(F.col("digest"), F.lit(":"), F.xxhash64("page_id", "url").cast("string")))
    both = both.withColumn("by", apart).join(groups.select(F.col("digest").alias("by"), "first"), "by", "left")
    first = F.coalesce("known", "first")
    revisit = first.isNotNull() & ~F.col("page_id").eqNullSafe(first)
    return both.select("page_id", "url", "html", "digest", "size", F.when(revisit, first).alias("refers_to"), revisit.alias("revisit"))


def write_archives(pages: DataFrame, folder: str | None = None, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Writes every page as a record into bundles under ``folder`` and returns the index of records (a written table).

    A null html is an empty payload, a null url a record without target, a null page_id a record that maps to none;
    a repeated row is a record of its own; an empty table writes no bundle. Other columns are not read.
    """
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _at(folder)
        attempt, made, bundle, path = TaskContext.get().taskAttemptId(), 0, None, None
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                page_id, url, html, digest, size, refers_to, revisit = (batch.column(c)[i].as_py() for c in range(7))
                name, data = record(page_id, url, html.encode(), digest, size, refers_to, revisit)
                if bundle is None:
                    fs.create_dir(root, recursive=True)
                    path = f"bundle-{attempt:08d}-{made:05d}.warc.zst"
                    bundle, made = BundleWriter(fs.open_output_stream(f"{root}/{path}", compression=None), frame_bytes), made + 1
                rows.append((page_id, name, f"{folder}/{path}", *bundle.add(data), len(data)))
                if bundle.written > bundle_bytes:
                    bundle.close()
                    bundle = None
            yield _batch(rows, _INDEX_SCHEMA)
        if bundle is not None:
            bundle.close()

    return settled(with_revisits(pages).mapInArrow(write, INDEX), "warc-index")


_INDEX_SCHEMA = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("bundle", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])
_RECORD_SCHEMA = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _row(head: dict[str, str], http: dict[str, str], payload: bytes) -> tuple:
    kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"payload of {head['warc-record-id']} doesn't match its digest")
    return (
        _page_id(head["warc-record-id"]), int(http["content-length"]), digest, kind,
        _page_id(head.get("warc-refers-to")), head.get("warc-target-uri"), payload if kind == "response" else None,
    )


def read_archives(spark: SparkSession, index: DataFrame) -> DataFrame:
    """Every record of the bundles that ``index`` names, read frame by frame; payload is null for revisits.

    Payloads are checked against their digests; an empty index gives no rows.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, place = _at(path)
                with fs.open_input_file(place) as file:
                    bundle = BundleReader(file)
                    for k in range(len(bundle.frames)):
                        yield _batch([_row(head, http, payload) for _, _, head, http, payload in parse(bundle.frame(k))], _RECORD_SCHEMA)

    bundles = index.select("bundle").distinct()
    # A task for each bundle: their names alone are so small that Spark would put them all in one.
    return bundles.repartition(max(1, bundles.count())).mapInArrow(read, RECORD)


def fetch(wanted: DataFrame) -> DataFrame:
    """The records of some rows of an index, each by reading one frame; no rows of an index give no records."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, frame, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, place = _at(path)
                with fs.open_input_file(place) as file:
                    data = BundleReader(file).frame(frame)[offset : offset + length]
                rows += [_row(head, http, payload) for _, _, head, http, payload in parse(data)]
            yield _batch(rows, _RECORD_SCHEMA)

    return wanted.select("bundle", "frame", "offset", "length").mapInArrow(read, RECORD)
