"""Arrays that travel in rows: packed numbers, batches of rows, slices by bucket."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard


def pack(a: np.ndarray) -> bytes:
    """An array of numbers, its bytes of equal weight together."""
    a = np.ascontiguousarray(a)
    return zstandard.ZstdCompressor(1).compress(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes())


def unpack(raw: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(flat.reshape(size, -1).T).reshape(-1).view(kind)


def pack_rising(a: np.ndarray) -> bytes:
    return pack(np.diff(a, prepend=a.dtype.type(0)))


def unpack_rising(raw: bytes, kind: str) -> np.ndarray:
    return np.cumsum(unpack(raw, kind), dtype=kind)


def rows(names: str, rows: list[tuple]) -> pa.RecordBatch:
    """A batch of rows; ``names`` is a schema of plain types."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [f.split() for f in names.split(", ")]
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def bucket_slices(buckets: np.ndarray, parts: int) -> Iterator[tuple[int, slice]]:
    """The buckets that occur in a sorted array, and where."""
    stops = np.searchsorted(buckets, np.arange(parts + 1))
    for k in np.unique(buckets).tolist():
        yield k, slice(int(stops[k]), int(stops[k + 1]))
