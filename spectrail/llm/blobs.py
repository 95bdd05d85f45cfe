"""Hashes with their places, packed by bucket of the hash, so that a shuffle moves few large rows."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import SparkSession

#: Windows or keys that a map task sorts at once, and that a bucket is sized for; both bound memory, neither changes a result.
FLUSH = 1_500_000
BUCKET = 500_000

BLOBS = "bucket int, n int, keys binary, docs binary, starts binary"
SCHEMA = pa.schema([("bucket", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("docs", pa.binary()), ("starts", pa.binary())])


def bucket_bits(spark: SparkSession, hashes: float) -> int:
    """High bits of a hash that name its bucket: buckets hold about BUCKET hashes, and every shuffle partition gets one at least."""
    return max(1, math.ceil(math.log2(max(int(spark.conf.get("spark.sql.shuffle.partitions")), hashes / BUCKET))))


def planes(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes of their differences."""
    step = np.diff(values, prepend=values.dtype.type(0))
    return zstandard.compress(step.view(np.uint8).reshape(-1, step.itemsize).T.tobytes(), 1)


def unplanes(blob: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(blob), np.uint8)
    size = np.dtype(kind).itemsize
    return np.cumsum(np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel(), dtype=kind)


def blob(bucket: int, keys: np.ndarray | None, docs: np.ndarray, starts: np.ndarray) -> tuple:
    """keys: 7 low bytes of each hash, the bucket holds the high bits; none for windows known as repeated."""
    body = b"" if keys is None else np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8)[:, :7]).tobytes()
    return bucket, len(docs), body, planes(docs), planes(starts)


def unpacked(keys: bytes) -> np.ndarray:
    """The hashes of one blob without the byte that its bucket stands for; within a bucket they tell hashes apart."""
    out = np.zeros((len(keys) // 7, 8), np.uint8)
    out[:, :7] = np.frombuffer(keys, np.uint8).reshape(-1, 7)
    return out.view(np.uint64).ravel()


def bucketed(h: np.ndarray, bits: int, doc: np.ndarray, start: np.ndarray, with_keys: bool) -> list[tuple]:
    """Blobs of hashes, in the order given within each bucket."""
    bucket = h >> np.uint64(64 - bits)
    order = np.argsort(bucket.astype(np.uint16) if bits <= 16 else bucket, kind="stable")
    h, bucket, doc, start = h[order], bucket[order], doc[order], start[order]
    edges = np.flatnonzero(np.diff(bucket, prepend=np.uint64(1 << 63)))
    return [blob(int(bucket[lo]), h[lo:hi] if with_keys else None, doc[lo:hi], start[lo:hi]) for lo, hi in zip(edges, [*edges[1:], len(h)], strict=False)]


def table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), SCHEMA, strict=True)], schema=SCHEMA) if rows else SCHEMA.empty_table()


def leads(keys: np.ndarray) -> np.ndarray:
    """Of sorted keys, for each the position of the first that equals it."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0)) if len(keys) else np.zeros(0, np.int64)
