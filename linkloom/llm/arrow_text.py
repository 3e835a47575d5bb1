"""Byte-level views of Arrow string columns, cut into slices of bounded size.

The Python operators work on whole texts but never on more than one slice of rows at a time, so
the memory of a worker follows ``SLICE_BYTES`` or the longest single text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SLICE_BYTES = 1 << 19
#: Rows of an Arrow batch on their way to a Python worker.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """df, after making sure that its session sends at most `BATCH_ROWS` rows at a time to Python: with
    whole documents in the rows, Spark's default of 10,000 takes hundreds of megabytes a task."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty. offsets has one entry more than rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch's rows in order, in runs of about ``limit`` bytes of text (one row at least)."""
    if batch.num_rows == 0:
        return
    _, offsets = utf8(batch.column(text))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = max(start + 1, min(end, batch.num_rows))
        yield batch.slice(start, end - start)
        start = end
    pa.default_memory_pool().release_unused()


def sums_by_row(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of values[start:end] for each row; empty ranges give 0."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)))
    return total[ends] - total[starts]


def joined(column: pa.Array, separator: str = "\n") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all rows with ``separator`` (one byte) after each, and every row's start and end
    in them, the end being the separator's place. Nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    data, offsets = utf8(pc.binary_join_element_wise(column.cast(pa.large_string()), *(pa.scalar(x, pa.large_string()) for x in ("", separator))))
    return data, offsets[:-1], offsets[1:] - 1


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that sums and comparisons of hashes behave as if random."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)


_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {b: np.ones(1, np.uint64) for b in (_BASE, _INVERSE)}
_bytes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def _power(base: int, n: int) -> np.ndarray:
    if len(_powers[base]) < n:
        with np.errstate(over="ignore"):
            steps = np.full(1 << int(n).bit_length(), base, np.uint64)
            steps[0] = 1
            _powers[base] = np.multiply.accumulate(steps)
    return _powers[base][:n]


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range data[start:end], equal for equal bytes wherever they stand."""
    with np.errstate(over="ignore"):
        upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_bytes[data] * _power(_BASE, len(data)), dtype=np.uint64)))
        return mix((upto[ends] - upto[starts]) * _power(_INVERSE, len(data) + 1)[starts] + (ends - starts).astype(np.uint64))
