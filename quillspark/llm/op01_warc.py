"""Operator 1: WARC records in seekable Zstandard bundles.

`write` turns pages into WARC/1.1 records. Records are grouped into independent Zstandard frames of about `frame_bytes`;
a bundle ends with a seek table in a skippable frame (compressed and uncompressed size of each frame, and the footer
that seekable readers look for), so any Zstandard reader takes the file as a whole and one frame can be read alone. The
index maps every record to its bundle, frame and place within the frame. `read_back` parses all bundles; `fetch` takes
single records through the index.

Of records with equal payloads of at least `min_revisit_bytes` bytes, the one with the smallest page_id is a response
and the others are revisits that refer to it and carry no payload. Equality is that of length and SHA-256. The smallest
page_id of a payload comes from one partly pre-aggregated groupBy, and goes back by a join whose hot keys Spark can
split.

Defined cases: null html is the empty payload; rows with a null page_id become responses with page_id null and are
never referred to; rows that repeat the page_id and payload of a response are responses too; empty tables give no rows; other columns are not read. One very long page makes one long
frame, held by one task.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import arrow_map, materialize, scratch
from quillspark.llm.files import Reader, Writer

#: Fixed values of the seekable format and of skippable frames.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES, BUNDLE_BYTES, LEVEL = 256 << 10, 128 << 20, 3
WARC_DATE = "2024-01-01T00:00:00Z"
INDEX = "page_id long, uri string, frame long, frame_begin long, frame_size long, place long, size long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def mark(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to): refers_to is null for responses."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("key", F.unhex(F.sha2("payload", 256)))
    known = rows.where(F.col("page_id").isNotNull() & (F.octet_length("payload") >= min_revisit_bytes))
    # Small payloads have no entry here, so the join leaves them responses.
    first = known.groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = rows.join(first, "key", "left")
    return joined.select("page_id", "url", "payload", F.when(F.col("page_id") != F.col("first"), F.col("first")).alias("refers_to"))


def record(page_id, url, payload: bytes, refers_to) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>", f"WARC-Date: {WARC_DATE}", f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}", f"X-Payload-Length: {len(payload)}", f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict, int]:
    """One record that begins at `at`, with its header fields and `payload`, and where the next one begins."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record here")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    begin, size = end + 4, int(fields["Content-Length"])
    block = data[begin : begin + size]
    fields["payload"] = block[block.index(b"\r\n\r\n") + 4 :]
    return fields, begin + size + 4


class Bundle:
    """Writes one bundle; gives the index rows."""

    def __init__(self, folder: str, frame_bytes: int):
        self.out, self.frame_bytes = Writer(folder, "bundle", ".warc.zst"), frame_bytes
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        self.seeks, self.open, self.open_size, self.rows = [], [], 0, []

    def add(self, page_id, data: bytes) -> None:
        if self.open and self.open_size + len(data) > self.frame_bytes:
            self.flush()
        self.open.append((page_id, self.open_size, len(data), data))
        self.open_size += len(data)

    def flush(self) -> None:
        if not self.open:
            return
        packed = self.packer.compress(b"".join(x[3] for x in self.open))
        begin = self.out.write(packed)
        self.rows += [(page_id, self.out.uri, len(self.seeks), begin, len(packed), place, size) for page_id, place, size, _ in self.open]
        self.seeks.append((len(packed), self.open_size))
        self.open, self.open_size = [], 0

    def close(self) -> list[tuple]:
        self.flush()
        table = b"".join(struct.pack("<II", *x) for x in self.seeks) + struct.pack("<IBI", len(self.seeks), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()
        return self.rows


def write(pages: DataFrame, min_revisit_bytes: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Writes bundles to the shared folder; returns the index, itself kept there."""
    spark = pages.sparkSession
    folder = scratch(spark, "warc")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in INDEX.split(", ")]
        types = [pa.string() if "uri" in n else pa.int64() for n in names]
        bundle = None
        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                bundle = bundle or Bundle(folder, frame_bytes)
                bundle.add(page_id, record(page_id, url, payload, refers_to))
                if bundle.out.at >= bundle_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*bundle.close()), types)], names)
                    bundle = None
        if bundle:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*bundle.close()), types)], names)

    return materialize(arrow_map(mark(pages, min_revisit_bytes), save, INDEX), "warc-index")


def seek_table(file: Reader) -> list[tuple[int, int]]:
    """(begin, compressed size) of each frame, from the end of the file."""
    n, _, magic = struct.unpack("<IBI", file.read(file.size - 9, 9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    raw = file.read(file.size - 9 - 8 * n, 8 * n)
    found, at = [], 0
    for k in range(n):
        size = struct.unpack_from("<I", raw, 8 * k)[0]
        found.append((at, size))
        at += size
    return found


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, stored_bytes long"


def read_back(index: DataFrame) -> DataFrame:
    """One row per record, parsed from all frames of all bundles; digests of stored payloads are computed anew."""
    bundles = index.groupBy("uri").agg(F.max("frame").alias("frames"))
    # One row per group of frames, so that a bundle is read by several tasks.
    work = bundles.select("uri", F.explode(F.sequence(F.lit(0).cast("long"), F.col("frames"), F.lit(32).cast("long"))).alias("begin")).repartition("uri", "begin")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in READ.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            for uri, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = Reader(uri)
                for begin, size in seek_table(file)[first : first + 32]:
                    data, at, rows = unpacker.decompress(file.read(begin, size)), 0, []
                    while at < len(data):
                        x, at = parse(data, at)
                        rows.append(_row(x))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                file.close()

    return arrow_map(work, load, READ)


def _row(x: dict) -> tuple:
    stored, told = x["payload"], x["WARC-Payload-Digest"].removeprefix("sha1:")
    if x["WARC-Type"] == "response" and (digest(stored) != told or len(stored) != int(x["X-Payload-Length"])):
        raise ValueError(f"damaged record {x['WARC-Record-ID']}")
    to = x.get("X-Refers-To-Page-ID")
    return (int(x["X-Page-ID"]) if x["X-Page-ID"] else None, int(x["X-Payload-Length"]), told, x["WARC-Type"], int(to) if to else None, len(stored))


def fetch(index: DataFrame, page_ids: list[int]) -> dict[int, dict]:
    """Single records through the index: one frame is read and unpacked for each."""
    found = {}
    for r in index.where(F.col("page_id").isin(page_ids)).collect():
        data = zstandard.ZstdDecompressor().decompress(Reader(r.uri).read(r.frame_begin, r.frame_size))
        found[r.page_id] = parse(data[r.place : r.place + r.size])[0]
    return found
