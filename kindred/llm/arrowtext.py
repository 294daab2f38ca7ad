"""Arrow helpers shared by the text operators: slicing, words and hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import SparkSession

ASCII_SPACE = " \t\n\x0b\x0c\r"
SLICE_BYTES = 2 << 20


def small_batches(spark: SparkSession, rows: int = 2000, size: int = 4 << 20) -> None:
    """Bound the session's Arrow batches in rows and bytes, and with them a worker's memory.

    The setting counts when a query runs, so it stays with the session.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def small_scans(spark: SparkSession, rows: int = 512) -> None:
    """Bound the rows that a scan decodes at once, which for texts are arrays of many MB in the executor's heap.

    The heap grows for arrays of that size sooner than it is collected.  The setting stays with the session.
    """
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(rows))


def clear_driver(spark: SparkSession) -> None:
    """Collect the driver's heap, which grows sooner than it is collected.

    Spark forgets the broadcasts, shuffles and code of queries that ended when they are collected.
    """
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Return freed memory to the system: workers live on and serve other operators."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # a C library without it


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Split a batch by the bytes of ``column``; a longer single row stays whole."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
    start, total = 0, 0
    for i, n in enumerate(size):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < len(size):
        yield batch.slice(start)
    give_back()


def texts(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The column with nulls as empty texts and 64-bit offsets.

    ``take`` copies, so the buffers start at this slice: some string kernels
    misread arrays that are views into a larger buffer.
    """
    values = batch.column(column).cast(pa.large_string())
    return pc.fill_null(values.take(pa.array(np.arange(len(values)))), "")


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 step)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_PLACES = 48
_HASHED = 1 << 13


def _table() -> np.ndarray:
    """Random 64-bit numbers for every (place, byte): simple tabulation hashing."""
    return mix(np.arange(1, (_PLACES + 1) * 256 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(-1, 256)


_TABLE = _table()


def hash_strings(values: pa.Array) -> np.ndarray:
    """64-bit hashes of the strings' UTF-8 bytes: tabulation up to 48 bytes, xxh3 beyond.

    Tabulation takes some tens of bytes a byte, so it goes by blocks of strings.
    """
    values = values.cast(pa.large_binary())
    if not len(values):
        return np.zeros(0, np.uint64)
    ends = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    starts, size = ends[:-1] - ends[0], np.diff(ends)
    out = np.empty(len(values), np.uint64)
    short = np.flatnonzero(size <= _PLACES)
    for at in range(0, len(short), _HASHED):
        some = short[at : at + _HASHED]
        n = size[some]
        end = np.cumsum(n)
        place = np.arange(end[-1]) - np.repeat(end - n, n)
        each = _TABLE[place, data[np.repeat(starts[some], n) + place]]
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(each)))
        out[some] = mix(total[end] - total[end - n] + _TABLE[_PLACES, n])
    raw = memoryview(data)
    for i in np.flatnonzero(size > _PLACES):
        out[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : starts[i] + size[i]])
    return out


def words(text: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words of ``[^\\x20\\x09-\\x0D]+`` after A-Z are lower-cased.

    Returns (index of each word in the dictionary, the dictionary, offsets of
    each text's words).
    """
    parts = pc.ascii_split_whitespace(pc.ascii_lower(text))
    offsets = parts.offsets.to_numpy()
    flat = parts.flatten()
    full = np.asarray(pc.binary_length(flat)) > 0
    offsets = np.concatenate(([0], np.cumsum(full)))[offsets - offsets[0]]
    coded = flat.filter(pa.array(full)).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, offsets


def translate(text: pa.Array, table: np.ndarray) -> pa.Array:
    """Map every byte; ``table`` must keep UTF-8 valid (change ASCII to ASCII only)."""
    if not len(text):
        return text
    ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = table[np.frombuffer(text.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]]
    return pa.LargeStringArray.from_buffers(len(text), pa.py_buffer((ends - ends[0]).tobytes()), pa.py_buffer(data.tobytes()))


def _plain_table() -> np.ndarray:
    word = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
    low = [c + 32 if 0x41 <= c <= 0x5A else c for c in range(256)]
    return np.array([c if c in word else 0x20 for c in low], np.uint8)


#: A-Z lower-cased; ASCII other than letters and digits to spaces.
PLAIN = _plain_table()
