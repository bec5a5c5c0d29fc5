"""Global facts about hashed keys without moving what they belong to.

Documents are dealt into blocks of bounded size. A block sends the sorted 64-bit keys it holds, cut into bucket ranges and
delta-coded; a bucket meets the same range of all blocks and sends back one value for each key in the same order. So a block
can line the answers up with keys that it works out anew, and neither keys nor rows travel back. A key occurs once per
block at most, which keeps buckets even however hot a key is; blocks and buckets grow in number with the input, not in size.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

BLOCK_BYTES = 8 << 20


def in_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """Adds ``block`` to rows with doc_id and text, by hash of the id (of the text where the id is NULL)."""
    size = docs.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = max(1, ceil(size / block_bytes))
    place = F.xxhash64(F.lit(29), "doc_id", F.when(F.col("doc_id").isNull(), F.col("text")))
    return docs.withColumn("block", F.pmod(place, F.lit(n)).cast("int")), n


def pack(values: np.ndarray) -> bytes:
    """Compressed byte planes: leading zero bytes cost next to nothing."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()) if len(values) else b""


def unpack(blob: bytes, kind: type) -> np.ndarray:
    if not blob:
        return np.zeros(0, kind)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob, np.uint64), dtype=np.uint64)


def bucket_bounds(keys: np.ndarray, buckets: int, shift: int = 0) -> np.ndarray:
    """Where each of ``buckets`` equal ranges of the key space, of ``shift`` bits fewer than 64, begins in the sorted keys, and the end."""
    starts = np.array([(b << (64 - shift)) // buckets for b in range(buckets)], np.uint64)
    return np.append(np.searchsorted(keys, starts), len(keys))


class Hashes(dict):
    """64-bit hashes of byte strings, remembered; a full memory starts anew."""

    def __init__(self, most: int = 400_000):
        self.most = most

    def __missing__(self, key: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[key] = value = xxhash.xxh3_64_intdigest(key)
        return value


MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of pairs of hashes."""
    x = (left ^ (left >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + right * MIX
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def sorted_rows(rows: pa.Table) -> pa.Table:
    """Rows of a block in an order that any pass over the block repeats; NULL ids last."""
    return rows.sort_by([("doc_id", "ascending"), ("text", "ascending")]) if rows.num_rows else rows
