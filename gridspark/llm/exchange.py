"""Rounds of a distributed sort between buckets of documents and ranges of keys.

Documents are dealt by a hash of their key into buckets of a bounded size. In each round a bucket sends the distinct keys that
it holds, sorted and cut into key ranges, with a small payload; a range sorts what all buckets sent, compares neighbours, and
answers every bucket key by key. One key costs a range at most one entry per bucket, however many documents hold it, so neither
a hot passage nor a large group of copies gathers in one task; no links or keys reach the driver. All of it is a lazy plan of
grouped and cogrouped Arrow functions, so a lost executor's part is computed again.

A message is a row (dest int, src int, kind int, blob binary). Ranges have numbers from 0; a message to a bucket that has to
pass through a round of ranges goes to dest -1 - bucket.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trim

MESSAGE = "dest int, src int, kind int, blob binary"
ARROW = pa.schema([("dest", pa.int32()), ("src", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])
#: Text bytes of a bucket; it grows with the square root of the input beyond 1 GB, up to the largest.
BUCKET_BYTES, LARGEST_BUCKET = 4 << 20, 256 << 20
LEAST_BUCKETS = 64

Message = tuple[int, int, int, bytes]


class Layout:
    """How many buckets and ranges there are, from the size of the input alone."""

    def __init__(self, total_bytes: int, bucket_bytes: int | None = None):
        size = bucket_bytes or min(LARGEST_BUCKET, int(BUCKET_BYTES * max(1.0, math.sqrt(total_bytes / 1e9))))
        self.buckets = max(LEAST_BUCKETS, -(-total_bytes // size))
        self.range_bits = max(6, math.ceil(math.log2(self.buckets)) - 1)
        #: Leading bits of a key that make a false meeting of two keys as rare as 2**-10 a key.
        self.key_bits = min(64, 10 + max(20, math.ceil(math.log2(max(total_bytes, 2)))))

    def short(self, keys: np.ndarray) -> np.ndarray:
        """Keys cut to key_bits: enough to find candidates."""
        shift = np.uint64(64 - self.key_bits)
        return keys >> shift << shift

    def cut(self, keys: np.ndarray) -> np.ndarray:
        """Where each range begins in sorted keys, and the end."""
        n = 1 << self.range_bits
        edges = np.arange(1, n, dtype=np.uint64) << np.uint64(64 - self.range_bits)
        return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def total_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).collect()[0][0]


def pack(keys: np.ndarray, bits: int = 64) -> bytes:
    """Sorted keys of which only the leading bits count, as differences of as few bytes as they need; 8 bytes say how many and how wide."""
    if not len(keys):
        return b"\0" * 8
    shift = 64 - bits
    step = np.diff(keys >> np.uint64(shift))
    wide = max(1, -(-int(step.max()).bit_length() // 8)) if len(step) else 1
    narrow = np.ascontiguousarray(step.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide])
    return len(keys).to_bytes(6, "little") + bytes([wide, shift]) + keys[:1].astype("<u8").tobytes() + narrow.tobytes()


def unpack(blob: bytes) -> tuple[np.ndarray, bytes]:
    """Keys, and what follows them."""
    n = int.from_bytes(blob[:6], "little")
    if not n:
        return np.zeros(0, np.uint64), blob[8:]
    wide, shift = blob[6], np.uint64(blob[7])
    end = 16 + (n - 1) * wide
    step = np.zeros((n, 8), np.uint8)
    step[1:, :wide] = np.frombuffer(blob, np.uint8, (n - 1) * wide, 16).reshape(-1, wide)
    step = step.view("<u8").ravel()
    step[0] = np.frombuffer(blob, "<u8", 1, 8)[0] >> shift
    return np.cumsum(step, dtype=np.uint64) << shift, blob[end:]


def planes(values: np.ndarray) -> bytes:
    """64-bit numbers byte plane by byte plane, so that the planes that all numbers share compress to nothing."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes()


def unplanes(blob: bytes, dtype=np.int64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, -1).T).view(dtype).ravel()


def message_table(messages: list[Message]) -> pa.Table:
    cols = list(zip(*messages)) if messages else [[], [], [], []]
    return pa.table([pa.array(c, f.type) for c, f in zip(cols, ARROW)], schema=ARROW)


def read_messages(table: pa.Table) -> list[Message]:
    return sorted(zip(*(table.column(n).to_pylist() for n in ("dest", "src", "kind", "blob"))), key=lambda m: (m[0], m[2], m[1]))


def trimmed(table: pa.Table) -> pa.Table:
    trim()
    return table


def dealt(docs: DataFrame, layout: Layout, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows by a hash of key and text, so that rows without a key, or of one key, spread as their texts do."""
    bucket = F.pmod(F.xxhash64(key, text), F.lit(layout.buckets)).cast("int")
    return docs.select(bucket.alias("b"), F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), *carry)


def first_round(dealt_docs: DataFrame, fn: Callable[[int, pa.Table], list[Message]]) -> DataFrame:
    """Each bucket's messages to ranges."""
    def run(key, table):
        return trimmed(message_table(fn(key[0].as_py(), table)))

    return dealt_docs.groupBy("b").applyInArrow(run, MESSAGE)


def ranges(messages: DataFrame, fn: Callable[[int, list[Message]], list[Message]]) -> DataFrame:
    """Each range's answers; what is only passed through arrives unchanged at its bucket."""
    def run(key, table):
        dest = key[0].as_py()
        got = read_messages(table)
        return trimmed(message_table([(-1 - dest, *m[1:]) for m in got] if dest < 0 else fn(dest, got)))

    return messages.groupBy("dest").applyInArrow(run, MESSAGE)


def next_round(dealt_docs: DataFrame, answers: DataFrame, fn: Callable[[int, pa.Table, list[Message]], pa.Table], schema: str) -> DataFrame:
    """Documents of a bucket and the answers to it, together."""
    def run(key, docs, table):
        return trimmed(fn(key[0].as_py(), docs, read_messages(table)))

    return dealt_docs.groupBy("b").cogroup(answers.groupBy("dest")).applyInArrow(run, schema)


def merged(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the joined parts by key, where each distinct key begins in that order, and how many entries it has."""
    keys = np.concatenate(parts)
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    begin = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    return order, begin, np.diff(np.concatenate([begin, [len(keys)]]))


def back(order: np.ndarray, counts: np.ndarray, values: np.ndarray, lengths: list[int]) -> list[np.ndarray]:
    """A value per distinct key, as a value per entry of each part."""
    out = np.empty(len(order), values.dtype)
    out[order] = np.repeat(values, counts)
    return np.split(out, np.cumsum(lengths)[:-1])
