"""Seekable zstandard files, written and read through Spark's own file layer.

A file is a run of independent zstandard frames and a trailing seek table in a
skippable frame: for each frame its compressed size, its size and the low 32 bits
of the XXH64 of its content (the public seekable format). Readers find the table
from the file's end and decompress only the frames that they need.

Spark writes a file from one row: its text writer puts the row's bytes and then
the line separator, which here is the format's closing magic number. So files
reach any store that Spark can write, by its commit protocol, and lost executors
leave no half-written files.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format.
SKIPPABLE = 0x184D2A5E
SKIPPABLE_INDEX = 0x184D2A5D
SEEKABLE = struct.pack("<I", 0x8F92EAB1)
HAS_CHECKSUMS = 0x80


def pack(frames: list[bytes], level: int = 3, index: bytes | None = None) -> bytes:
    """A file's bytes without the closing magic number; an index goes into a skippable frame before the table."""
    z = zstandard.ZstdCompressor(level=level, write_content_size=True)
    out, table = [], []
    for raw in frames:
        data = z.compress(raw)
        out.append(data)
        table.append(struct.pack("<III", len(data), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
    body = b"".join(table) + struct.pack("<IB", len(frames), HAS_CHECKSUMS)
    if index is not None:
        data = z.compress(index)
        out += [struct.pack("<II", SKIPPABLE_INDEX, len(data)), data]
    return b"".join([*out, struct.pack("<II", SKIPPABLE, len(body) + len(SEEKABLE)), body])


class Reader:
    """Random access to the frames of one file: from its bytes, or by ``read(at, size)`` where only ranges are fetched."""

    def __init__(self, data: bytes | memoryview | None = None, read: Callable[[int, int], bytes] | None = None, length: int | None = None):
        if data is not None:
            view = memoryview(data)
            read, length = (lambda at, size: view[at : at + size]), len(view)
        self.read, self.z = read, zstandard.ZstdDecompressor()
        end = bytes(read(length - 9, 9)) if length >= 9 else b""
        if end[-4:] != SEEKABLE:
            raise ValueError("no seek table at the end")
        n, flags = struct.unpack("<IB", end[:5])
        width = 12 if flags & HAS_CHECKSUMS else 8
        self.table_at = length - 9 - n * width
        self.frames, at = [], 0
        for row in struct.iter_unpack("<III" if width == 12 else "<II", read(self.table_at, n * width)):
            self.frames.append((at, *row))
            at += row[0]

    def index(self) -> bytes:
        """The index after the last frame."""
        at = sum(f[1] for f in self.frames)
        magic, size = struct.unpack("<II", self.read(at, 8))
        if magic != SKIPPABLE_INDEX:
            raise ValueError("no index")
        return self.z.decompress(self.read(at + 8, size))

    def __len__(self) -> int:
        return len(self.frames)

    def frame(self, i: int) -> bytes:
        at, size, length, *check = self.frames[i]
        raw = self.z.decompress(self.read(at, size), max_output_size=length)
        if check and xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check[0]:
            raise ValueError(f"frame {i} is damaged")
        return raw


def open_remote(spark: SparkSession, file: str) -> Reader:
    """A reader on the driver that fetches ranges of a file from any store that Spark reads."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(file)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def read(at: int, size: int) -> bytes:
        stream = fs.open(path)
        try:
            stream.seek(at)
            return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size))
        finally:
            stream.close()

    return Reader(read=read, length=fs.getFileStatus(path).getLen())


def write_files(rows: DataFrame, path: str) -> None:
    """One file for each row of the binary column ``file``, in the order of partitions and rows."""
    (
        rows.select(F.col("file").cast("string").alias("value"))
        .write.option("lineSep", SEEKABLE.decode("latin-1"))
        .option("encoding", "ISO-8859-1")
        .option("maxRecordsPerFile", 1)
        .text(path)
    )


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of each file."""
    return spark.read.format("binaryFile").load(path).filter(F.col("length") > 0).select("path", "content")


def batches_of(sizes: Iterator[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items whose sizes sum to about ``most``."""
    start, total, i = 0, 0, -1
    for i, s in enumerate(sizes):
        if total and total + s > most:
            yield start, i
            start, total = i, 0
        total += s
    if i >= start:
        yield start, i + 1
