"""64-bit hashes of texts and rasters, and the image kernels.

A text is hashed by its bag of words over 64 buckets: bit i is set where bucket
i holds more words than the mean of buckets 1-63, and bucket 0 gives no bit,
the rule a perceptual hash applies to its frequency coefficients.  Rasters are
grey values in row-major arrays, 8 x 8 here; the perceptual hash and SSIM take
any square raster (32 x 32 and 256 x 256 for whole images), the difference
hash any width and height (9 x 8).  The DCT runs as an Arrow function over
whole batches, the others are array expressions.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.functions as F
import pyspark.sql.types as T
from pyspark.sql import Column, DataFrame

SIDE = 8
BUCKETS = 64
TEXTS = 512  # hashed at a time


def word_bits(texts: pa.Array, part: int, found: tuple) -> np.ndarray:
    """Hashes by byte ``part`` of the words' MD5; ``found`` is what ``_digested`` gives."""
    owner, index, digests = found
    n = len(texts)
    counts = np.bincount(owner * BUCKETS + digests[:, part][index] % BUCKETS, minlength=n * BUCKETS).reshape(n, BUCKETS)[:, 1:]
    above = (BUCKETS - 1) * counts > counts.sum(axis=1)[:, None]
    return (above * (np.int64(1) << np.arange(BUCKETS - 2, -1, -1, dtype=np.int64))).sum(axis=1)


def _digested(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text of each word, its place in the list of distinct words, their MD5 digests)."""
    split = pc.split_pattern(texts, " ")
    words = split.flatten().dictionary_encode()
    raw = b"".join(md5(w, usedforsecurity=False).digest() for w in words.dictionary.cast(pa.large_binary()).to_pylist())
    return np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy())), words.indices.to_numpy(), np.frombuffer(raw, np.uint8).reshape(-1, 16)


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over all cores, if they come in fewer splits; at most a split a core is moved."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if rows.isStreaming or rows.rdd.getNumPartitions() >= cores:
        return rows
    return rows.repartition(cores)


def text_hashes(texts: DataFrame, key: str, text: str, parts: tuple[int, ...] = (0,)) -> DataFrame:
    """``key`` and a 64-bit hash column h0, h1, ... of every row for each MD5 byte in ``parts``.

    One narrow pass: each distinct word of a few texts is digested once, and
    nothing is shuffled, unless the scan has fewer splits than the cluster has
    cores (one row group is one task, whatever it holds): then its rows are
    dealt out first.  A null text is an empty one; repeated rows each give a
    row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), TEXTS):
                part = batch.slice(at, TEXTS)
                values = part.column("_text").cast(pa.large_string())
                found = _digested(values)
                yield pa.RecordBatch.from_pydict({key: part.column(key)} | {f"h{p}": pa.array(word_bits(values, p, found)) for p in parts})

    used = texts.select(key, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_text"))
    kind = used.schema[key].dataType.simpleString()
    return spread(used).mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"h{p} long" for p in parts))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hex_hash(h: Column) -> Column:
    """16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(h)), 16, "0")


def from_hex(text: Column) -> Column:
    """The signed 64-bit number of 16 hex digits."""
    return F.conv(text, 16, -10).cast("long")


def raster(values: Column) -> Column:
    """Grey values 0-255 of 64 components."""
    return F.transform(values, lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(x.cast("double") * 64 + 128))).cast("int"))


def difference_hash(grey: Column, side: int = SIDE, height: int = SIDE) -> Column:
    """Bit set where a pixel is darker than its right neighbour, row by row of ``side`` pixels."""
    place = F.sequence(F.lit(0), F.lit(height * (side - 1) - 1))
    left = lambda k: F.floor(k / (side - 1)).cast("int") * side + k % (side - 1)
    bit = lambda k: F.when(F.get(grey, left(k)) < F.get(grey, left(k) + 1), 1).otherwise(0).cast("long")
    return F.aggregate(F.transform(place, bit), F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, 1).bitwiseOR(x))


def quality(grey: Column, side: int = SIDE) -> Column:
    """Sharpness 0-100 from the population variance of the inner Laplacian."""
    inner = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(side - 2)), lambda r: F.transform(F.sequence(F.lit(1), F.lit(side - 2)), lambda c: r * side + c)))
    at = lambda k: F.get(grey, k).cast("long")
    lap = F.transform(inner, lambda k: at(k - side) + at(k + side) + at(k - 1) + at(k + 1) - 4 * at(k))
    n = (side - 2) ** 2
    total = F.aggregate(lap, F.lit(0).cast("long"), lambda a, x: a + x)
    squares = F.aggregate(lap, F.lit(0).cast("long"), lambda a, x: a + x * x)
    return F.round(100 * (1 - F.exp(-((n * squares - total * total) / (n * n)) / 500.0)), 2)


def dct_matrix(n: int) -> np.ndarray:
    """Orthonormal DCT-II."""
    k, x = np.arange(n)[:, None], np.arange(n)[None, :]
    out = np.sqrt(2 / n) * np.cos((2 * x + 1) * k * np.pi / (2 * n))
    out[0] /= np.sqrt(2)
    return out


def dct(rasters: np.ndarray) -> np.ndarray:
    """2-D DCT of a batch of square rasters."""
    c = dct_matrix(rasters.shape[-1])
    return c @ rasters @ c.T


def _cosines(grey: pd.Series) -> np.ndarray:
    """The lowest 8 x 8 DCT coefficients of square rasters."""
    out = np.empty((len(grey), SIDE, SIDE))
    size = grey.map(len).to_numpy()
    for n in np.unique(size):
        side, at = isqrt(n), np.flatnonzero(size == n)
        if side * side != n or side < SIDE:
            raise ValueError(f"a raster of {n} values is no square of at least {SIDE} x {SIDE}")
        out[at] = dct(np.stack(grey.to_numpy()[at]).astype(float).reshape(len(at), side, side))[:, :SIDE, :SIDE]
    return out.round(6)


@F.pandas_udf(T.LongType())
def perceptual_hash(grey: pd.Series) -> pd.Series:
    """63 bits: lowest 8 x 8 coefficients above the mean of all but the first."""
    if not len(grey):
        return pd.Series([], dtype="int64")
    weight = np.int64(1) << np.arange(62, -1, -1, dtype=np.int64)
    flat = _cosines(grey).reshape(len(grey), -1)[:, 1:]
    return pd.Series(np.where(flat > flat.mean(axis=1, keepdims=True), weight, 0).sum(axis=1))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def dct_coefficients(grey: pd.Series) -> pd.Series:
    """The lowest 64 DCT coefficients, row by row."""
    return pd.Series(list(_cosines(grey).reshape(len(grey), -1))) if len(grey) else pd.Series([], dtype=object)


def squared_error(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: ((x - y) * (x - y)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def nmse(a: Column, b: Column) -> Column:
    """Mean squared difference over 255 squared."""
    return squared_error(a, b) / (F.size(a) * F.lit(255.0 * 255.0))


def _ssim_window(a: Column, b: Column) -> Column:
    """Structural similarity of one window, from exact integer sums."""
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s + v.cast("long"))
    product = lambda x, y: total(F.zip_with(x, y, lambda u, v: u.cast("long") * v.cast("long")))
    n = F.size(a).cast("double")
    ma, mb = total(a) / n, total(b) / n
    va, vb, cov = product(a, a) / n - ma * ma, product(b, b) / n - mb * mb, product(a, b) / n - ma * mb
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    return ((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma * ma + mb * mb + c1) * (va + vb + c2))


def windows(grey: Column) -> Column:
    """The whole 8 x 8 windows, side by side, of a square raster."""
    side = F.floor(F.sqrt(F.size(grey))).cast("int")
    across = F.floor(side / SIDE).cast("int")
    corner = lambda k: F.floor(k / across).cast("int") * SIDE * side + k % across * SIDE
    rows = lambda k: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(SIDE - 1)), lambda r: F.slice(grey, corner(k) + r * side + 1, SIDE)))
    return F.when(side == SIDE, F.array(grey)).otherwise(F.transform(F.sequence(F.lit(0), across * across - 1), rows))


def ssim(a: Column, b: Column) -> Column:
    """Mean structural similarity of the 8 x 8 windows, side by side, of square rasters."""
    side = F.floor(F.sqrt(F.size(a))).cast("int")
    across = F.floor(side / SIDE).cast("int")
    corner = lambda k: F.floor(k / across).cast("int") * SIDE * side + k % across * SIDE
    window = lambda x, k: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(SIDE - 1)), lambda r: F.slice(x, corner(k) + r * side + 1, SIDE)))
    scores = F.transform(F.sequence(F.lit(0), across * across - 1), lambda k: _ssim_window(window(a, k), window(b, k)))
    mean = F.aggregate(scores, F.lit(0.0), lambda s, x: s + x) / (across * across)
    bad = (side * side != F.size(a)) | (F.size(a) != F.size(b)) | (side < SIDE)
    return F.when(bad, F.raise_error(F.lit("rasters must be equal squares of at least 8 x 8")).cast("double")).when(side == SIDE, _ssim_window(a, b)).otherwise(mean)  # one window needs no slices
