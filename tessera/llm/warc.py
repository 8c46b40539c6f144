"""WARC archives in seekable zstandard bundles.

Each page becomes a WARC 1.1 record. Of records with equal payloads of at least
100 bytes, that with the smallest page_id is a response and the others revisit it
without repeating the payload. Records are grouped into independent zstandard
frames; the file ends with a seek table, before which an index maps record
identifiers to a frame and an offset in it. Readers decompress single frames.

Which pages are copies is decided on (page_id, digest) alone: the smallest page_id
of each digest is a grouped minimum, so that a digest of a third of all rows is
added up before it is shuffled.

Defined results: null html is an empty payload; records with equal payloads whose
page_id is the smallest too (repeated rows) are all responses; a null page_id
counts as the largest and revisits any other, and if all are null all are responses; extra
columns are ignored; an empty table gives no files and an empty table.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import seekable
from .common import shared_dir

LEAST_SHARED = 100
FRAME_BYTES = 512 << 10
FILE_BYTES = 64 << 20
DATE = "1970-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(identifier: str) -> int | None:
    number = identifier.rpartition(":")[2].rstrip(">")
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None, date: str = DATE) -> bytes:
    block = HTTP.format(len(payload)).encode() + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {' '.join(url.split())}"] if url is not None else []),
        f"WARC-Payload-Digest: sha256:{digest}",
        *([f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"] if kind == "revisit" else []),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, bytes, int]:
    """Headers, HTTP header, payload and end of the record at ``at``."""
    end = data.index(b"\r\n\r\n", at)
    version, *lines = data[at:end].decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines)
    start = end + 4
    stop = start + int(headers["Content-Length"])
    http, _, payload = data[start:stop].partition(b"\r\n\r\n")
    return headers, http, payload, stop + 4


class Bundle:
    """Random access to the records of one file: from its bytes or from a reader that fetches ranges."""

    def __init__(self, content: bytes | memoryview | seekable.Reader):
        self.reader = content if isinstance(content, seekable.Reader) else seekable.Reader(content)
        self.index: list[tuple[str, int, int]] = [tuple(x) for x in json.loads(self.reader.index())]

    def find(self, identifier: str) -> list[tuple[dict[str, str], bytes, bytes]]:
        """The records of an identifier; only their frames are decompressed."""
        return [parse(self.reader.frame(f), at)[:3] for i, f, at in self.index if i == identifier]

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
        held, raw = -1, b""
        for _, f, at in self.index:
            if f != held:
                held, raw = f, self.reader.frame(f)
            yield parse(raw, at)[:3]


def fetch(spark: SparkSession, file: str, page_id: int) -> list[tuple[dict[str, str], bytes, bytes]]:
    """A page's records in one file; only the file's end, its index and the page's frames are read."""
    return Bundle(seekable.open_remote(spark, file)).find(record_id(page_id))


def pack_bundle(ids: list[str], records: list[bytes], level: int = 3) -> bytes:
    frames, index = [], []
    for a, b in seekable.batches_of(map(len, records), FRAME_BYTES):
        at = 0
        for i in range(a, b):
            index.append((ids[i], len(frames), at))
            at += len(records[i])
        frames.append(b"".join(records[a:b]))
    return seekable.pack(frames, level, json.dumps(index).encode())


def plan(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, digest, first): first is the response's page_id where there are copies.

    Payloads under LEAST_SHARED bytes have no copies; they are dealt out by page.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"))
    copies = rows.filter(F.octet_length("html") >= LEAST_SHARED).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    # Short payloads get keys that no digest equals, each its own, so that they are no hot key.
    key = F.when(F.octet_length("html") >= LEAST_SHARED, F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string")))
    return rows.withColumn("__key", key).join(copies.select(F.col("digest").alias("__digest"), "first"), F.col("__key") == F.col("__digest"), "left").drop("__digest", "__key")


def write(pages: DataFrame, path: str) -> None:
    """Write a record for each row of ``pages`` (page_id, url, html) under ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, records, size = [], [], 0

        def file() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([pack_bundle(ids, records)], pa.binary())], names=["file"])

        for b in batches:
            for page_id, url, html, digest, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                kind = "response" if first is None or page_id == first else "revisit"
                ids.append(record_id(page_id))
                records.append(record(page_id, url, html.encode(), digest, kind, first))
                size += len(records[-1])
                if size >= FILE_BYTES:
                    yield file()
                    ids, records, size = [], [], 0
        if ids:
            yield file()

    seekable.write_files(plan(pages).mapInArrow(run, "file binary"), path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record under ``path``."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                out = []
                for headers, http, payload in Bundle(content.as_buffer()):
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                    kind = headers["WARC-Type"]
                    length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
                    if kind == "response" and (length != len(payload) or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"record {headers['WARC-Record-ID']} is damaged")
                    refers_to = page_of(headers["WARC-Refers-To"]) if kind == "revisit" else None
                    out.append((page_of(headers["WARC-Record-ID"]), length, digest, kind, refers_to))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    out = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return seekable.read_files(spark, path).select("content").mapInArrow(run, out)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to the shared folder and read them back."""
    path = shared_dir(pages.sparkSession, "warc")
    write(pages, path)
    return read(pages.sparkSession, path)
