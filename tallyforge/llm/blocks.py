"""Arrays in packed form, for operators that deal out work as a few large rows in place of many small ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Kinds of numbers that are packed.
KINDS = ("<u8", "<i8", "<u4", "<i4", "<u2", "<f8", "|u1")


def mixed(x: np.ndarray) -> np.ndarray:
    """A public 64-bit mixer (splitmix64's), element by element."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays as one compressed piece; each byte by byte, all first bytes first, as that compresses well."""
    import zstandard

    head = [len(arrays)]
    for x in arrays:
        head += [KINDS.index(x.dtype.str), len(x)]
    planes = (np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes() for x in arrays)
    return zstandard.ZstdCompressor(level=level).compress(np.array(head, "<i8").tobytes() + b"".join(planes))


def unpack(raw: bytes) -> list[np.ndarray]:
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(raw)
    n = int(np.frombuffer(data, "<i8", 1)[0])
    head = np.frombuffer(data, "<i8", 2 * n, 8).reshape(n, 2)
    at, out = 8 * (1 + 2 * n), []
    for kind, length in head.tolist():
        size = np.dtype(KINDS[kind]).itemsize
        part = np.frombuffer(data, np.uint8, length * size, at).reshape(size, length)
        out.append(np.ascontiguousarray(part.T).view(KINDS[kind]).ravel())
        at += length * size
    return out


def narrow(x: np.ndarray) -> np.ndarray:
    """Numbers from 0 in two bytes each where they all fit, else in four."""
    return x.astype("<u2" if not len(x) or int(x.max()) < 1 << 16 else "<u4")


def bucket_ends(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket ends in sorted 64-bit keys; buckets are equal ranges of the keys' upper half."""
    starts = [(k << 32) // buckets + ((k << 32) % buckets > 0) << 32 for k in range(1, buckets)]
    return np.r_[np.searchsorted(keys, np.array(starts, np.uint64)), len(keys)].astype(np.int64)


def partition() -> int:
    """The number of the task's partition, which with a count of its own names what the task makes."""
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[tuple]]:
    """The rows that agree in the first ``width`` columns, run by run."""
    at, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and row[:width] != at:
                yield rows
                rows = []
            at = row[:width]
            rows.append(row)
    if rows:
        yield rows


def record_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
