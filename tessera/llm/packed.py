"""Sorted keys and counts, packed in binary values."""

from __future__ import annotations

import struct

import numpy as np
import zstandard


def squeeze(x: np.ndarray) -> bytes:
    """Whole numbers, bytes of equal weight side by side, compressed."""
    raw = x.astype("<u8").view("u1").reshape(-1, 8).T.tobytes()
    return struct.pack("<I", len(x)) + zstandard.ZstdCompressor(level=1).compress(raw)


def widen(data: bytes) -> np.ndarray:
    (n,) = struct.unpack_from("<I", data)
    raw = zstandard.ZstdDecompressor().decompress(data[4:], max_output_size=8 * n) if n else b""
    return np.ascontiguousarray(np.frombuffer(raw, "u1").reshape(8, n).T).view("<u8").reshape(n)


def bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's keys begin and end in sorted keys; buckets share the key range equally."""
    edges = np.array([(b << 64) // buckets for b in range(1, buckets)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]]).astype(np.int64)
