"""WARC archives in seekable Zstandard bundles (operator 1).

A bundle is a run of independent Zstandard frames, each holding whole WARC records, followed by a skippable frame with
the seek table. The archive is a table with a row per bundle, whose data is a complete seekable .warc.zst file, and an
index that maps record identifiers to frames and frame-relative offsets; so it can lie in any store that Spark writes.
Readers find frames by the seek table and unpack only those that hold what is asked for.
"""

from __future__ import annotations

import hashlib
import struct

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches, trim, written

# Fixed values of the seekable Zstandard format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 8 << 20
DATE = "2024-01-01T00:00:00Z"


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The footer for frames of (compressed, plain) sizes."""
    entries = b"".join(struct.pack("<II", *x) for x in sizes)
    footer = struct.pack("<IBI", len(sizes), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer


def read_seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(start in the bundle, compressed bytes, plain bytes) of each frame, read from the end of a bundle."""
    count, _, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    at, found = 0, []
    for c, d in struct.iter_unpack("<II", bundle[-9 - 8 * count : -9]):
        found.append((at, c, d))
        at += c
    return found


def record(page_id, url, payload: bytes, n_bytes: int, digest: str, refers_to) -> bytes:
    """A WARC/1.1 record: a response with the payload, or a revisit of refers_to without it."""
    name = "null" if page_id is None else str(page_id)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {n_bytes}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    head += ["Content-Type: text/html", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse_record(plain: bytes, at: int, length: int) -> tuple[dict[str, str], bytes]:
    """Headers and block of the record at frame-relative offset `at`."""
    end = plain.index(b"\r\n\r\n", at, at + length)
    lines = plain[at:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0]!r}")
    head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    size = int(head["Content-Length"])
    return head, plain[end + 4 : end + 4 + size]


ARCHIVE = "bundle string, record_ids array<long>, frames array<int>, offsets array<long>, lengths array<long>, data binary"
ARROW = pa.schema([("bundle", pa.string()), ("record_ids", pa.list_(pa.int64())), ("frames", pa.list_(pa.int32())), ("offsets", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("data", pa.binary())])


class BundleWriter:
    """Frames of about frame_bytes of records, and a seek table behind them."""

    def __init__(self, frame_bytes: int, level: int):
        self.frame_bytes, self.pack = frame_bytes, zstandard.ZstdCompressor(level=level)
        self.data, self.sizes, self.index = bytearray(), [], ([], [], [], [])
        self.frame, self.at = [], 0

    def add(self, page_id, data: bytes) -> None:
        for column, x in zip(self.index, (page_id, len(self.sizes), self.at, len(data)), strict=True):
            column.append(x)
        self.frame.append(data)
        self.at += len(data)
        if self.at >= self.frame_bytes:
            self._close_frame()

    def _close_frame(self) -> None:
        packed = self.pack.compress(b"".join(self.frame))
        self.data += packed
        self.sizes.append((len(packed), self.at))
        self.frame, self.at = [], 0

    def row(self, name: str) -> pa.RecordBatch:
        if self.frame:
            self._close_frame()
        self.data += seek_table(self.sizes)
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((name, *self.index, bytes(self.data)), ARROW.types, strict=True)], schema=ARROW)


def _bundles(frame_bytes: int, bundle_bytes: int, level: int):
    def run(batches):
        part, number, bundle = TaskContext.get().partitionId(), 0, BundleWriter(frame_bytes, level)
        for batch in batches:
            for small in small_batches(batch, "html"):
                for page_id, url, html, n, digest, refers in zip(*(c.to_pylist() for c in small.columns), strict=True):
                    bundle.add(page_id, record(page_id, url, html, n, digest, refers))
                    if len(bundle.data) >= bundle_bytes:
                        yield bundle.row(f"{part:06d}-{number:06d}")
                        number, bundle = number + 1, BundleWriter(frame_bytes, level)
        if bundle.index[0]:
            yield bundle.row(f"{part:06d}-{number:06d}")
        trim()

    return run


def write_archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", revisit_from: int = 1000, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, level: int = 3) -> DataFrame:
    """Pages as an archive table in the shared folder, a record per row.

    Of records with equal payloads of at least revisit_from bytes the one with the largest id is the response and the
    others revisit it; rows that repeat that id, and groups without any id, are all responses. A null body is an empty
    payload, a null URL an empty one; a record without id is named null and keeps a null id in the index. An empty
    table gives an empty archive. Payloads count as equal when length, SHA-1 and SHA-256 agree.
    """
    body = F.coalesce(F.col(body_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), body.alias("html")).select("*", F.length("html").cast("long").alias("n"), F.sha1("html").alias("digest"), F.sha2("html", 256).alias("d2"))
    key = ["n", "digest", "d2"]
    copied = rows.where(F.col("n") >= revisit_from).groupBy(*key).agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    refers = F.when(F.col("page_id") == F.col("first"), F.lit(None)).otherwise(F.col("first"))
    planned = rows.join(copied, key, "left").select("page_id", "url", "html", "n", "digest", refers.alias("refers_to"))
    return written(planned.mapInArrow(_bundles(frame_bytes, bundle_bytes, level), ARCHIVE), codec="uncompressed")


RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def _name(urn: str) -> int | None:
    text = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if text == "null" else int(text)


def _records(with_payload: bool, ids: set[int] | None):
    def rows_of(plain, places):
        for at, length in places:
            head, block = parse_record(plain, at, length)
            kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
            n = int(head["X-Payload-Length"])
            if kind == "response":
                n = len(block)
                if hashlib.sha1(block).hexdigest() != digest:
                    raise ValueError(f"payload of {head['WARC-Record-ID']} does not match its digest")
            refers = _name(head["WARC-Refers-To"]) if kind == "revisit" else None
            yield _name(head["WARC-Record-ID"]), head["WARC-Target-URI"], n, digest, kind, refers, block if with_payload else None

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for k in range(batch.num_rows):
                record_ids, frames, offsets, lengths, data = (batch.column(c)[k].as_py() for c in ("record_ids", "frames", "offsets", "lengths", "data"))
                table, places = read_seek_table(data), {}
                for i, frame, at, length in zip(record_ids, frames, offsets, lengths, strict=True):
                    if ids is None or i in ids:
                        places.setdefault(frame, []).append((at, length))
                for frame, wanted in places.items():
                    start, size, plain_bytes = table[frame]
                    plain = unpack.decompress(data[start : start + size], max_output_size=plain_bytes)
                    found = list(rows_of(plain, wanted))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), OUT.types, strict=True)], schema=OUT)
        trim()

    return run


def read_archive(archive: DataFrame, with_payload: bool = True) -> DataFrame:
    """Every record of an archive table, frame by frame as the seek tables say; payload digests of responses are verified."""
    return archive.select("record_ids", "frames", "offsets", "lengths", "data").mapInArrow(_records(with_payload, None), RECORDS)


def read_records(archive: DataFrame, ids: list[int]) -> DataFrame:
    """Single records by identifier: only bundles that the index names are read and only their frames unpacked."""
    hit = archive.where(F.arrays_overlap("record_ids", F.array(*[F.lit(int(x)).cast("long") for x in ids])))
    return hit.select("record_ids", "frames", "offsets", "lengths", "data").mapInArrow(_records(True, {int(x) for x in ids}), RECORDS)
