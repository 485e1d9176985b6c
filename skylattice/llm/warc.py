"""WARC records in seekable Zstandard bundles.

A bundle is one ``.warc.zst`` file held in a binary cell: records are grouped into frames of bounded
size, each frame is compressed by itself, and a skippable frame at the end holds the seek table
(compressed and plain size of every frame, then the footer). An index maps each record's identifier to
its frame and to the offset and length inside the plain frame, so that one record is read by
decompressing one frame. Bundles are rows of a Parquet table in the shared folder: Spark commits them
as a whole, rewrites those of a lost task, and any store that Spark can write will do. Bytes of
``data`` copied to a file give a bundle that other readers of the seekable format open.

Of pages with equal payloads the one with the smallest page_id is a ``response``; the others are
``revisit`` records that name it and carry no payload. The page with the smallest id is found by an
aggregation on the payload's SHA-256: a payload that a third of all pages share makes one row in each map
task. The ids of payloads that are more than a ten-thousandth of all pages are broadcast, so that those pages are
bundled where they are read; the others are shuffled once by their digest. Records are read back by the index.

Defined cases: null html is an empty payload; a null url leaves the target out; a null page_id is
never the smallest (a group of nulls only is all responses) and is read back as null;
repeated rows of the smallest page_id are all responses; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_groups, stage, table

FRAME_BYTES = 256 * 1024
BUNDLE_BYTES = 4 * 1024 * 1024
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
BUNDLES = "bundle string, data binary, index array<struct<record:string,frame:int,offset:int,length:int>>"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC/1.1 record; a revisit if ``refers_to`` is given."""
    revisit = refers_to is not None
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {re.sub(r'[\x00-\x20\x7f]', lambda m: f'%{ord(m[0]):02X}', url)}"] if url is not None else []),
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(plain: bytes) -> Iterator[dict]:
    """The records of a plain frame."""
    at = 0
    while at < len(plain):
        body = plain.index(b"\r\n\r\n", at) + 4
        fields = dict(x.split(": ", 1) for x in plain[at : body - 4].decode().split("\r\n")[1:])
        end = body + int(fields["Content-Length"])
        start = plain.index(b"\r\n\r\n", body) + 4
        page = fields["WARC-Record-ID"][len("<urn:page:") : -1]
        yield {
            "page_id": None if page == "none" else int(page),
            "url": fields.get("WARC-Target-URI"),
            "payload_bytes": int(re.search(rb"Content-Length: (\d+)", plain[body:start])[1]),
            "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
            "record_type": fields["WARC-Type"],
            "refers_to": int(fields["WARC-Refers-To"][len("<urn:page:") : -1]) if "WARC-Refers-To" in fields else None,
            "payload": plain[start:end],
        }
        at = end + 4


class BundleWriter:
    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = LEVEL) -> None:
        self.press, self.frame_bytes = zstandard.ZstdCompressor(level=level), frame_bytes
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.index: list[dict] = []
        self.open, self.held = bytearray(), 0

    def add(self, record: str, data: bytes) -> None:
        if self.open and len(self.open) + len(data) > self.frame_bytes:
            self._close()
        self.index.append({"record": record, "frame": len(self.frames), "offset": len(self.open), "length": len(data)})
        self.open += data

    def _close(self) -> None:
        packed = self.press.compress(bytes(self.open))
        self.frames.append(packed)
        self.sizes.append((len(packed), len(self.open)))
        self.held += len(packed)
        self.open = bytearray()

    def bytes(self) -> bytes:
        if self.open:
            self._close()
        table = b"".join(struct.pack("<II", *x) for x in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE, len(table)) + table


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, plain size) of each frame, from the footer of a bundle."""
    n, _, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    sizes = struct.unpack(f"<{2 * n}I", data[-9 - 8 * n : -9])
    out, start = [], 0
    for packed, plain in zip(sizes[::2], sizes[1::2], strict=True):
        out.append((start, packed, plain))
        start += packed
    return out


def read_frame(data: bytes, frame: int) -> bytes:
    start, packed, plain = seek_table(data)[frame]
    return zstandard.ZstdDecompressor().decompress(data[start : start + packed], max_output_size=plain)


def read_record(data: bytes, frame: int, offset: int, length: int) -> dict:
    """One record by its index entry; only its frame is decompressed."""
    return next(parse_records(read_frame(data, frame)[offset : offset + length]))


def _bundle(bundle_bytes: int, frame_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k, out = TaskContext.get().partitionId(), 0, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {"bundle": [f"{part:06d}-{k:06d}"], "data": [out.bytes()], "index": [out.index]},
                pa.schema([("bundle", pa.string()), ("data", pa.binary()), ("index", pa.list_(pa.struct([("record", pa.string()), ("frame", pa.int32()), ("offset", pa.int32()), ("length", pa.int32())])))]),
            )

        for batch in batches:
            for i in range(batch.num_rows):
                page, url, html, first = (batch.column(c)[i].as_py() for c in ("page_id", "url", "html", "first"))
                out = out or BundleWriter(frame_bytes)
                refers = first if page != first else None
                out.add(f"urn:page:{'none' if page is None else page}", record_bytes(page, url, (html or "").encode(), refers))
                if out.held >= bundle_bytes:
                    yield done()
                    out, k = None, k + 1
        if out:
            yield done()

    return run


def write_bundles(pages: DataFrame, bundle_bytes: int = BUNDLE_BYTES, frame_bytes: int = FRAME_BYTES, least_revisit_bytes: int = 0) -> DataFrame:
    """Bundles of all rows of ``pages`` (page_id, url, html), committed in the shared folder."""
    html = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.unhex(F.sha2(html, 256)).alias("key"), F.octet_length(html).alias("size"))
    least = F.min(F.when(F.col("size") >= least_revisit_bytes, F.col("page_id")))
    firsts = stage(keyed.groupBy("key").agg(least.alias("first"), F.count("*").alias("members")), "firsts")
    rows = join_groups(keyed, firsts, "key", "members").select("page_id", "url", "html", F.coalesce("first", "page_id").alias("first"))
    return stage(rows.mapInArrow(_bundle(bundle_bytes, frame_bytes), BUNDLES), "warc")


def _read(with_payload: bool):
    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, index in zip(batch.column("data"), batch.column("index"), strict=True):
                data = data.as_py()
                for k, entries in groupby(sorted(index.as_py(), key=itemgetter("frame", "offset")), itemgetter("frame")):
                    plain, rows = read_frame(data, k), []
                    for e in entries:
                        r = next(parse_records(plain[e["offset"] : e["offset"] + e["length"]]))
                        rows.append(r if with_payload else r | {"payload": None})
                    yield pa.RecordBatch.from_pylist(rows, pa.schema(list(zip(names, kinds, strict=True))))

    return run


def read_bundles(bundles: DataFrame, with_payload: bool = True) -> DataFrame:
    """All records, each by its entry in the index; a frame is decompressed once."""
    return bundles.select("data", "index").mapInArrow(_read(with_payload), RECORDS)


def op6_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_bundles(write_bundles(table(spark, sf_dir, "pages")), with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT body, min(page_id) AS first FROM p GROUP BY body)
SELECT page_id, octet_length(encode(p.body))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 8), lambda i: (
    array_to_string(list_transform([15, 10, 5, 0], lambda s:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (i * 5 + 1)::INT, 5))::INT >> s) & 31) + 1, 1)), ''))), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f ON p.body = f.body
"""
