"""Arrays of numbers that travel packed: a row holds many numbers for one bucket, so a shuffle moves few and large rows."""

from __future__ import annotations

from collections.abc import Iterator

import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from filmspark.llm.common import blocks, written

#: Buckets for each partition, so that hashing buckets to partitions comes out even.
BUCKETS_EACH = 8


def by_bucket(keys: np.ndarray, n_buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places) of 64-bit hashes: which of them fall into each bucket, in their order. The work is bound by the hashes at hand, however many buckets there are."""
    bucket = (keys % np.uint64(n_buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else order
    for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(order)], strict=False):
        yield int(bucket[a]), order[a:z]


def deal(df: DataFrame, partitions: int) -> DataFrame:
    return df.repartition(partitions, "bucket")


def block_ids() -> Iterator[int]:
    """Numbers that no other task gives, the same if the task runs again."""
    task = TaskContext.get()
    base = (task.partitionId() if task else 0) << 32
    return iter(range(base, base + (1 << 32)))


def sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of the values of each."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    k, v = keys[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[first], np.add.reduceat(v, first)


def raw(column: pa.Array, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) if x.is_valid else np.zeros(0, kind) for x in column]


def packed_blocks(docs: DataFrame, text_col: str, size: int) -> DataFrame:
    """(block, batch): about `size` bytes of text and all other columns of its rows, as a compressed Arrow batch.

    Later steps answer to blocks instead of documents: they move few and large rows, and find a block's contents again without a
    shuffle by document. The table is written, so a block's number stands for the same rows whatever executor is lost.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = block_ids()
        for b in blocks(batches, text_col, size):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(b)
            yield pa.record_batch([pa.array([next(numbers)]), pa.array([sink.getvalue().to_pybytes()])], names=["block", "batch"])

    return written(docs.mapInArrow(run, "block long, batch binary"), "blocks", 16 << 20)


def unpacked(blob: pa.Scalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(blob.as_buffer()).read_next_batch()


_WIDTHS = [np.uint8, np.uint16, np.uint32, np.uint64, np.float32]


def squeezed(arrays: list[np.ndarray]) -> bytes:
    """Unsigned integers, each array in the least width that holds it, and 32-bit floats, compressed together."""
    parts = []
    for x in arrays:
        if x.dtype == np.float32:
            code = 4
        else:
            top = int(x.max()) if len(x) else 0
            code = next(k for k in range(4) if top <= np.iinfo(_WIDTHS[k]).max)
        parts += [struct.pack("<BI", code, len(x)), np.ascontiguousarray(x, _WIDTHS[code]).tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def stretched(blob: bytes) -> list[np.ndarray]:
    body, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(body):
        code, n = struct.unpack_from("<BI", body, at)
        out.append(np.frombuffer(body, _WIDTHS[code], n, at + 5))
        at += 5 + n * np.dtype(_WIDTHS[code]).itemsize
    return out
