"""Asking a table too large to broadcast, from blocks of documents, with arrays instead of rows.

A block of documents asks for the distinct keys it has: one array for each
bucket of keys. A bucket's task sees one array from each block, answers each in
the order it was asked, and the answers go back to the block. So Spark moves few
rows with long arrays, a key that every document has is asked for once a block,
and positions need not be sent, as both sides keep the order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty


def with_blocks(docs: DataFrame, n: int, text: str = "text", *more: Column) -> DataFrame:
    """(block, doc_id, text, more) with documents spread over n blocks by a hash that any run repeats."""
    t = text_or_empty(text)
    block: Column = F.pmod(F.xxhash64(F.col("doc_id"), F.crc32(t), F.lit(41)), F.lit(n)).cast("int")
    return docs.select(block.alias("block"), F.col("doc_id").cast("long").alias("doc_id"), t.alias("text"), *more)


def sorted_lookup(keys: np.ndarray, table: np.ndarray, values: np.ndarray, default: int | float) -> np.ndarray:
    """``values`` of the ``keys`` in the sorted ``table``."""
    if not len(table):
        return np.full(len(keys), default, values.dtype)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, values[at], np.array(default, values.dtype))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def packed(values: np.ndarray, ascending: bool = False) -> bytes:
    """An array in few bytes: differences if it ascends, byte planes, zstd. Element sizes are 4 and 8."""
    if ascending and len(values):
        values = np.concatenate([values[:1], values[1:] - values[:-1]])
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(raw: bytes, dtype, ascending: bool = False) -> np.ndarray:
    n, size = int.from_bytes(raw[:8], "little"), np.dtype(dtype).itemsize
    planes = np.frombuffer(pa.decompress(memoryview(raw)[8:], n * size, codec="zstd", asbytes=True), np.uint8)
    values = np.ascontiguousarray(planes.reshape(size, n).T).reshape(-1).view(dtype)
    return np.cumsum(values, dtype=dtype) if ascending else values


def coded(values: np.ndarray) -> bytes:
    """Doubles of which many are equal: the distinct ones, and each one's place among them."""
    distinct, place = np.unique(values, return_inverse=True)
    head = packed(distinct)
    return len(head).to_bytes(8, "little") + head + packed(place.astype(np.int32))


def decoded(raw: bytes) -> np.ndarray:
    size = 8 + int.from_bytes(raw[:8], "little")
    return unpacked(raw[8:size], np.float64)[unpacked(raw[size:], np.int32)]
