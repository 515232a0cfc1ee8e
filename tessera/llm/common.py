"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.sources.shared import batches_of, discard, scratch, stored

__all__ = ["batches_of", "discard", "sample_share", "scratch", "stored", "text_crc", "tiles", "utf8_buffers"]

#: Bytes of text that one numpy kernel call works on; longer texts go alone.
TILE_BYTES = 1 << 19


def text_crc(column: str) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")))


def sample_share(share: float, *keys: Column) -> Column:
    """Rows whose hash of the keys falls into the first `share` of all hash values."""
    return F.pmod(F.xxhash64(*keys, F.lit("sample")), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))


def utf8_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; nulls have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def tiles(offsets: np.ndarray, limit: int = TILE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows whose texts have about `limit` bytes together; one row at least."""
    n, start = len(offsets) - 1, 0
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        end = min(max(end, start + 1), n)
        yield start, end
        start = end
