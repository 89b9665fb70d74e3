"""Blocks of documents that ask tables dealt by hash.

A block is a row: documents of one task, up to a bound of bytes (a longer
document is a block of its own). It asks about its distinct keys, one packed row
per part of the table; the part answers each block with one row, in the order
asked. Rows are blocks times parts at most, never documents times parts, and a
key of very many documents is one entry per block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import U, mixed, raw

#: Bytes of text in a block.
BLOCK_BYTES = 8 << 20


def pack(x: np.ndarray) -> bytes:
    """The bytes of numbers, compressed: first all lowest bytes, then all next ones."""
    x = np.ascontiguousarray(x)
    rows = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(rows.tobytes())


def unpack(raw: bytes, kind) -> np.ndarray:
    rows = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(rows.reshape(size, -1).T).reshape(-1).view(kind)


def pack_sorted(x: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as their differences."""
    return pack(np.diff(x, prepend=x.dtype.type(0)))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw, U))


def sliced(batches: Iterator[pa.RecordBatch], column: int = 1, most: int = BLOCK_BYTES) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(block, rows): the rows of a task in blocks of at most ``most`` bytes of the text in ``column``."""
    block = TaskContext.get().partitionId() << 16
    for b in batches:
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(b.column(column)), 0), np.int64)) if b.num_rows else np.zeros(0, np.int64)
        i, before = 0, 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(size, before + most, "right")))
            yield block, b.slice(i, j - i)
            block, i, before = block + 1, j, int(size[j - 1])


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of each key. Neighbours, up to 1024, go to one part, so that their differences are small there."""
    return (mixed(keys >> U(10)) % U(parts)).astype(np.int32)


def by_part(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Order that puts sorted keys part by part, sorted within each, and where each part begins and the last ends."""
    part = part_of(keys, parts)
    order = np.argsort(part.astype(np.uint16) if parts < 1 << 16 else part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> list[np.ndarray]:
    """For every list of keys, the sums over all lists of their counts."""
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    every = every[order]
    first = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, np.int64)
    total = np.add.reduceat(np.concatenate(counts)[order], first) if len(first) else np.zeros(0, np.int64)
    out = np.empty(len(every), np.int64)
    out[order] = np.repeat(total, np.diff(np.append(first, len(every))))
    return np.split(out, np.cumsum([len(k) for k in keys])[:-1])


def kind_of(docs: DataFrame, column: str = "doc_id") -> str:
    return docs.schema[column].dataType.simpleString()


def text_blocks(docs: DataFrame) -> DataFrame:
    """(block, ids, marks, sizes, data, load): blocks of documents with the hashes and bytes of their texts."""

    def run(batches):
        for block, b in sliced(batches):
            data, offsets = raw(b.column(1))
            ids = pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(0))
            binary = [pa.array([x], pa.binary()) for x in (pack(np.asarray(b.column(2))), pack(np.diff(offsets)), zstandard.ZstdCompressor(level=3).compress(data.tobytes()))]
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), ids, *binary, pa.array([len(data)], pa.int64())], ["block", "ids", "marks", "sizes", "data", "load"])

    kept = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    return kept.mapInArrow(run, f"block long, ids array<{kind_of(docs)}>, marks binary, sizes binary, data binary, load long")


def texts_of(sizes: bytes, data: bytes) -> tuple[bytes, np.ndarray, pa.Array]:
    """Bytes of a block's texts, where each begins and the last ends, and the texts."""
    data, edge = zstandard.ZstdDecompressor().decompress(data), np.append(0, np.cumsum(unpack(sizes, np.int64)))
    return data, edge, pa.Array.from_buffers(pa.large_binary(), len(edge) - 1, [None, pa.py_buffer(edge.tobytes()), pa.py_buffer(data)])
