"""Token ids in seekable binary files.

Documents are dealt by ranges of (doc_id, hash of text), encoded with the
tokenizers library and written in ascending doc_id order. A file holds a
directory frame (doc ids, token counts) and frames of about 1 MB of ids, each an
independent zstandard frame with a checksum in the seek table; a reader
decompresses the directory and the frames of the documents it wants.

The library encodes each distinct pre-token of a worker's chunk once; a bounded
cache keeps the ids of units of text (from one space to the next), and a document's
ids are those of its units in order. That this is what the library gives for whole
texts is tested over all code points.

A directory also holds the file's place: its part (the range it was written from)
and its number in the part. Nothing is told from file names.

Defined results: null and empty texts are one end id; null doc_ids come first;
repeated rows are each written, side by side; extra columns are ignored; texts of
any length are encoded whole, and rows equal in both id and text lie in one range; an empty table gives no files and an empty table.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import seekable
from .common import parts_for, shared_dir, stash, text_bytes
from .pretokens import IdCache, cut, read_vocabulary, vocabulary

FRAME_BYTES = 1 << 20
FILE_BYTES = 16 << 20


@functools.lru_cache(maxsize=2)
def _library_cache(data: bytes) -> IdCache:
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(data.decode())

    def make(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for at in range(0, len(pieces), 5000):
            part = pieces[at : at + 5000]
            e = tok.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(e.ids, np.uint32))
            counts.append(np.bincount(np.array(e.word_ids, np.int64), minlength=len(part)))
        return np.concatenate(ids), np.concatenate(counts)

    return IdCache(vocabulary(data), make)


def library_ids(data: bytes, texts: list[str | None] | pa.Array) -> list[bytes]:
    """What the tokenizers library gives for each text, as little-endian unsigned 32-bit integers."""
    ids, counts = _library_cache(data).encode(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
    raw, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
    return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def pack_file(doc_ids: list[int | None], ids: list[bytes], part: int = 0, number: int = 0, level: int = 1) -> bytes:
    """Directory: the file's place (part, number in it); number of documents; whether each has a doc_id; doc_ids; token counts. Then the ids."""
    n = len(ids)
    directory = b"".join(
        [
            struct.pack("<QQQ", part, number, n),
            np.array([d is not None for d in doc_ids], "<u1").tobytes(),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            np.array([len(x) // 4 for x in ids], "<u8").tobytes(),
        ]
    )
    frames = [b"".join(ids[a:b]) for a, b in seekable.batches_of(map(len, ids), FRAME_BYTES)]
    return seekable.pack([directory, *frames], level)


class TokenFile:
    """Reads documents of one file by their place in it: from its bytes or from a reader that fetches ranges."""

    def __init__(self, content: bytes | seekable.Reader):
        self.reader = content if isinstance(content, seekable.Reader) else seekable.Reader(content)
        d = self.reader.frame(0)
        self.part, self.number, n = struct.unpack_from("<QQQ", d)
        self.has_id = np.frombuffer(d, "<u1", n, 24).astype(bool)
        self.doc_ids = np.frombuffer(d, "<i8", n, 24 + n)
        self.counts = np.frombuffer(d, "<u8", n, 24 + 9 * n).astype(np.int64)
        ends = np.cumsum(self.counts) * 4
        self.starts = ends - self.counts * 4
        self.frame_ends = np.cumsum([f[2] for f in self.reader.frames[1:]])
        self._held = (-1, b"")

    def ids(self, i: int) -> bytes:
        """The ids of the i-th document; decompresses its frame only."""
        f = int(np.searchsorted(self.frame_ends, self.starts[i], side="right"))
        if self._held[0] != f:
            self._held = (f, self.reader.frame(f + 1))
        raw = self._held[1]
        at = int(self.starts[i] - (self.frame_ends[f] - len(raw)))
        return raw[at : at + int(self.counts[i]) * 4]

    def find(self, doc_id: int) -> list[bytes]:
        return [self.ids(int(i)) for i in np.flatnonzero(self.has_id & (self.doc_ids == doc_id))]


def write(docs: DataFrame, path: str, vocabulary_path: str, text_col: str = "text", key_col: str = "doc_id", end_id: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Encode ``docs`` and write them under ``path``; files in the order of (part, number) hold documents in ascending doc_id order."""
    data = read_vocabulary(vocabulary_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, keys, ids, size = TaskContext.get().partitionId(), 0, [], [], 0
        end = struct.pack("<I", end_id)

        def file() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([pack_file(keys, ids, part, number)], pa.binary())], names=["file"])

        for b in cut(batches, 1):
            for k, x in zip(b.column(0).to_pylist(), library_ids(data, b.column(1)), strict=True):
                keys.append(k)
                ids.append(x + end)
                size += len(ids[-1])
                if size >= file_bytes:
                    yield file()
                    number, keys, ids, size = number + 1, [], [], 0
        if ids:
            yield file()

    rows = docs.select(F.col(f"`{key_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    n = parts_for(text_bytes(rows), 2 * FILE_BYTES)
    h = F.xxhash64("text")
    # The parts are ranges, in order, so a task's number is its part's.
    dealt = rows.repartitionByRange(n, "doc_id", h).sortWithinPartitions("doc_id", h, "text")
    seekable.write_files(dealt.mapInArrow(run, "file binary"), path)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, part, number, at, n_tokens, ids_crc32) of every document; ``at`` counts the ids before it in its file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                f = TokenFile(content.as_buffer())
                n = len(f.counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(f.doc_ids, pa.int64(), mask=~f.has_id),
                        pa.array(np.full(n, f.part), pa.int64()),
                        pa.array(np.full(n, f.number), pa.int64()),
                        pa.array(f.starts // 4, pa.int64()),
                        pa.array(f.counts, pa.int64()),
                        pa.array([zlib.crc32(f.ids(i)) for i in range(n)], pa.int64()),
                    ],
                    names=["doc_id", "part", "number", "at", "n_tokens", "ids_crc32"],
                )

    return seekable.read_files(spark, path).select("content").mapInArrow(run, "doc_id long, part long, number long, at long, n_tokens long, ids_crc32 long")


def with_start(rows: DataFrame) -> DataFrame:
    """``documents`` with ``start``: the ids before the document in all files.

    Totals are added up over files within groups of 1,024 parts, and over those
    groups, so no task sees a row for each file.
    """
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    group = F.floor(F.col("part") / 1024).alias("group")
    files = stash(rows.groupBy("part", "number").agg(F.sum("n_tokens").alias("total")).withColumn("group", group), "files")
    groups = files.groupBy("group").agg(F.sum("total").alias("total"))
    groups = groups.select(F.col("group").alias("__group"), F.coalesce(F.sum("total").over(ahead(Window.orderBy("group"))), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("total").over(ahead(Window.partitionBy("group").orderBy("part", "number"))), F.lit(0))
    base = files.withColumn("inside", inside).join(groups, F.col("group") == F.col("__group"))
    base = base.select(F.col("part").alias("__part"), F.col("number").alias("__number"), (F.col("before") + F.col("inside")).alias("base"))
    return rows.join(base, (F.col("part") == F.col("__part")) & (F.col("number") == F.col("__number"))).withColumn("start", F.col("base") + F.col("at"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of the files under ``path``; each file is opened once."""
    return with_start(stash(documents(spark, path), "documents")).select("doc_id", "start", "n_tokens", "ids_crc32")


def fetch(spark: SparkSession, file: str, doc_id: int) -> list[bytes]:
    """The ids of a document in one file; only the file's end, its directory and the document's frames are read."""
    return TokenFile(seekable.open_remote(spark, file)).find(doc_id)


def round_trip(docs: DataFrame, vocabulary_path: str, text_col: str = "text", key_col: str = "doc_id") -> DataFrame:
    """Write ``docs`` to the shared folder and read them back."""
    path = shared_dir(docs.sparkSession, "tokens")
    write(docs, path, vocabulary_path, text_col, key_col)
    return read(docs.sparkSession, path)
