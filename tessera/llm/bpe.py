"""BPE encoding and decoding with a pair occurrence index.

The distinct pre-tokens of a chunk of a partition are laid out in one array of
symbols. An index maps each mergeable pair to all its positions in the array.
Ranks that have positions are applied in ascending order; each merge updates the
lists of the pairs that it destroys and makes. Units of text (from one space to the
next) that the worker has encoded before come from a bounded cache.

Defined results: null and empty texts have no ids and decode to ""; a special
token's string in a text becomes its id, as the tokenizers library does by
default; texts of any length are encoded whole; rows are independent, so repeated
rows, ties and extra columns change nothing; an empty table gives an empty table.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import IdCache, Vocabulary, cut, gather, read_vocabulary, run_sums, vocabulary

BOUNDARY, GONE = -1, -2
#: Pre-tokens that one index holds, bytes of text cut up at once, and entries of a worker's cache.
INDEX_PIECES, CHUNK_BYTES, CACHE_ENTRIES = 8_000, 1_000_000, 150_000


class PairIndexEncoder:
    """Encodes many pre-tokens at once."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.width = len(v.token_bytes)
        self.rank = {a * self.width + b: r for r, (a, b, _) in enumerate(v.merges)}
        self.byte_ids = np.array(v.byte_ids, dtype=np.int64)

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces, one after another, and how many each has."""
        lots = [self._encode(pieces[i : i + INDEX_PIECES]) for i in range(0, len(pieces), INDEX_PIECES)] or [self._encode([])]
        return np.concatenate([ids for ids, _ in lots]), np.concatenate([n for _, n in lots])

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [b"" if p in self.v.special else p.encode() for p in pieces]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        # One boundary before each piece and one at the end.
        starts = np.cumsum(lengths + 1) - lengths
        flat = np.full(int(lengths.sum()) + len(raw) + 1, BOUNDARY, dtype=np.int64)
        inside = np.ones(len(flat), dtype=bool)
        inside[starts - 1] = False
        inside[-1] = False
        flat[inside] = self.byte_ids[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        symbols = self._merge(flat)
        live = symbols >= 0
        counts = np.add.reduceat(live, starts - 1, dtype=np.int64) if len(raw) else np.zeros(0, np.int64)
        ids = symbols[live]
        if special := [i for i, p in enumerate(pieces) if p in self.v.special]:
            ids = np.insert(ids, np.cumsum(counts)[special], [self.v.special[pieces[i]] for i in special])
            counts[special] = 1
        return ids, counts

    def _index(self, flat: np.ndarray) -> dict[int, list[int]]:
        """Rank -> positions of its pair, ascending."""
        keys = flat[:-1] * self.width + flat[1:]
        keys[(flat[:-1] < 0) | (flat[1:] < 0)] = -1
        pairs, which = np.unique(keys, return_inverse=True)
        ranks = np.array([self.rank.get(k, -1) for k in pairs.tolist()], dtype=np.int64)[which] if len(pairs) else np.zeros(0, np.int64)
        at = np.flatnonzero(ranks >= 0)
        at = at[np.argsort(ranks[at], kind="stable")]
        found, first = np.unique(ranks[at], return_index=True)
        bounds = [*first.tolist(), len(at)]
        positions = at.tolist()
        return {r: positions[bounds[i] : bounds[i + 1]] for i, r in enumerate(found.tolist())}

    def _merge(self, flat: np.ndarray) -> np.ndarray:
        index = self._index(flat)
        active = list(index)
        heapq.heapify(active)
        symbols = flat.tolist()
        after = list(range(1, len(symbols) + 1))
        before = list(range(-1, len(symbols) - 1))
        rank, merges, width = self.rank.get, self.v.merges, self.width
        while active:
            r = heapq.heappop(active)
            a, b, new = merges[r]
            positions = index.pop(r)
            if a == b:
                positions.sort()
            for i in positions:
                if symbols[i] != a:
                    continue
                j = after[i]
                if symbols[j] != b:
                    continue
                k = after[j]
                symbols[i] = new
                symbols[j] = GONE
                after[i] = k
                before[k] = i
                h = before[i]
                if symbols[h] >= 0:
                    made = rank(symbols[h] * width + new)
                    if made is not None:
                        if made in index:
                            index[made].append(h)
                        else:
                            index[made] = [h]
                            heapq.heappush(active, made)
                if symbols[k] >= 0:
                    made = rank(new * width + symbols[k])
                    if made is not None:
                        if made in index:
                            index[made].append(i)
                        else:
                            index[made] = [i]
                            heapq.heappush(active, made)
        return np.array(symbols, dtype=np.int64)


@functools.lru_cache(maxsize=2)
def _cache(data: bytes) -> IdCache:
    return IdCache(vocabulary(data), PairIndexEncoder(vocabulary(data)).encode, CACHE_ENTRIES)


def encode_texts(data: bytes, texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the texts, one after another, and how many each text has."""
    return _cache(data).encode(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))


def give_back() -> None:
    """Forget what was learnt and return free memory to the system.

    A worker outlives its task: other operators' tasks run in it beside what is kept here. A partition
    fills the cache about once, so that the next one has little use for it.
    """
    _cache.cache_clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


@functools.lru_cache(maxsize=2)
def _token_bytes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    tokens = vocabulary(data).token_bytes
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(lengths) - lengths, lengths


def decode_ids(data: bytes, ids: np.ndarray, counts: np.ndarray) -> list[str]:
    """The texts of runs of ids; bytes that are not UTF-8 become replacement characters."""
    raw, sizes = gather(*_token_bytes(data), ids)
    raw, ends = raw.tobytes(), np.cumsum(run_sums(sizes, counts)).tolist()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip([0, *ends], ends, strict=False)]


def encode(docs: DataFrame, vocabulary_path: str, text_col: str = "text", key_col: str = "doc_id") -> DataFrame:
    """(doc_id, ids array<bigint>) of every document."""
    data = read_vocabulary(vocabulary_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches, 1, CHUNK_BYTES):
            ids, counts = encode_texts(data, b.column(1))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids, pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["doc_id", "ids"])

    kind = docs.schema[key_col].dataType.simpleString()
    return docs.select(F.col(f"`{key_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<bigint>")


def decode(encoded: DataFrame, vocabulary_path: str) -> DataFrame:
    """(doc_id, text) of the rows of ``encode``."""
    data = read_vocabulary(vocabulary_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [np.asarray(x or [], np.int64) for x in b.column(1).to_pylist()]
            texts = decode_ids(data, np.concatenate([*lists, np.zeros(0, np.int64)]), np.array([len(x) for x in lists], np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def round_trip(docs: DataFrame, vocabulary_path: str, text_col: str = "text", key_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes, decodes the ids again and returns digests of both."""
    data = read_vocabulary(vocabulary_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches, 1, CHUNK_BYTES):
            ids, counts = encode_texts(data, b.column(1))
            raw, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
            ids_sha = [hashlib.sha256(raw[i:j]).hexdigest() for i, j in zip([0, *ends], ends, strict=False)]
            text_sha = [hashlib.sha256(t.encode()).hexdigest() for t in decode_ids(data, ids, counts)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        give_back()

    kind = docs.schema[key_col].dataType.simpleString()
    out = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col(f"`{key_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, out)
