"""Approximate nearest neighbours by cosine along shifted Hilbert curves.

Unit vectors are rotated once; each group of ``dims`` rotated coordinates,
spread evenly by a normal fit on a bounded sample and shifted by its own
offset, gives one Hilbert ordering of all vectors.  Orderings are
range-partitioned and ranked by Spark.  A query looks at the ``window`` share
of each ordering around its own rank, ``least`` rows at least: it meets the
blocks that its window covers (a quarter of a window each, ``block`` rows at
most), one block in memory at a time, and keeps the best of each.  Only there
vectors travel as one byte a coordinate; the ``k + 1 + SPARE`` best of all
orderings get the exact measure from the original vectors.

The window is a share of the table, not a row count, because the share decides
the recall; for isotropic data no ordering can do with less, but many narrow
windows find more than few wide ones of the same total.  Equal vectors are
indexed once, with their ``k + 1`` smallest ids, which loses no answer and
keeps a vector that fills a third of the table from filling a window.

Defined results: vectors that are null, zero, of another length than most, or
hold a null or non-finite component take no part, nor do null ids; rows with
the query's own id are never its neighbours; ties go to the smaller id; fewer
candidates than ``k`` are all returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession, Window

from kindred.storage import materialise

CURVES = 32
DIMS = 6
BITS = 8
WINDOW = 0.02
LEAST = 128
BLOCK = 2048
SPARE = 5  # ranks that rounding to bytes may cost
SAMPLE = 10_000
SEED = 20_240_607


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions of integer grid cells (rows) on a Hilbert curve.

    Works from the top bit down: each step undoes the reflection and exchange
    that the curve's orientation at that level asks for (Skilling,
    "Programming the Hilbert curve", 2004), then bits are Gray-decoded and
    interleaved.
    """
    x = cells.astype(np.int64).copy()
    dims = x.shape[1]
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for d in range(dims):
            set_here = (x[:, d] >> level & 1).astype(bool)
            swap = np.where(set_here, 0, (x[:, 0] ^ x[:, d]) & low)
            x[:, 0] ^= np.where(set_here, low, swap)
            x[:, d] ^= swap
    x = np.bitwise_xor.accumulate(x, axis=1)
    flip = np.zeros(len(x), np.int64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[:, -1] >> level & 1, (1 << level) - 1, 0)
    x ^= flip[:, None]
    key = np.zeros(len(x), np.int64)
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            key = key << 1 | (x[:, d] >> level & 1)
    return key


def stack(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def to_bytes(x: np.ndarray) -> pa.Array:
    """Rows rounded to one byte a coordinate, each on its own scale: cosines need no other."""
    code = np.rint(x / np.abs(x).max(axis=1, keepdims=True) * 127).astype(np.int8)
    return pa.array([row.tobytes() for row in code], pa.binary())


def from_bytes(column: pa.Array) -> np.ndarray:
    """Unit vectors, in single precision."""
    code = np.frombuffer(b"".join(column.to_pylist()), np.int8).astype(np.float32)
    return unit(code.reshape(len(column), -1))


def code_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_pydict({"uid": batch.column("uid"), "asked": batch.column("asked"), "code": to_bytes(stack(batch.column("v")))})


def exact_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = stack(batch.column("left")), stack(batch.column("right"))
        score = (left * right).sum(axis=1) / (np.sqrt((left * left).sum(axis=1)) * np.sqrt((right * right).sum(axis=1)))
        yield pa.RecordBatch.from_pydict({"asker": batch.column("asker"), "ids": batch.column("ids"), "score": pa.array(score)})


class Orderings:
    """Rotation, spread and shifts shared by all rows; drawn from a fixed seed."""

    def __init__(self, sample: np.ndarray, curves: int, dims: int, bits: int):
        size = sample.shape[1]
        draw = np.random.default_rng(SEED)
        self.dims, self.bits = min(dims, size), bits
        turns = [np.linalg.qr(draw.normal(size=(size, size)))[0] for _ in range(-(-curves * self.dims // size))]
        self.turn = np.concatenate(turns, axis=1)[:, : curves * self.dims]
        self.curves = self.turn.shape[1] // self.dims
        seen = unit(sample) @ self.turn
        self.centre, self.scale = seen.mean(axis=0), np.maximum(seen.std(axis=0), 1e-12)
        self.shift = draw.random(self.turn.shape[1]) / 2
        self.grid = np.array([NormalDist().cdf(z) for z in np.linspace(-6, 6, 4097)])

    def keys(self, x: np.ndarray) -> np.ndarray:
        """A row of Hilbert keys, one a curve, for each vector."""
        z = (unit(x) @ self.turn - self.centre) / self.scale
        even = np.interp(z, np.linspace(-6, 6, 4097), self.grid)
        cell = np.minimum(((even + 2 * self.shift) / 2 * (1 << self.bits)), (1 << self.bits) - 1).astype(np.int64)
        return np.stack([hilbert_keys(cell[:, c * self.dims : (c + 1) * self.dims], self.bits) for c in range(self.curves)], axis=1)


def usable(vectors: DataFrame, vec_col: str, id_col: str) -> DataFrame:
    """(vec_id, v): rows that take part, as doubles, repeated rows once."""
    v = F.col(vec_col).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("v", lambda x: x != 0)
    good = vectors.select(F.col(id_col).alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(finite & some)
    sizes = good.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    return good.where(F.size("v") == (sizes[0]["size"] if sizes else 0)).distinct()


def search(vectors: DataFrame, is_query: Column, *, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", curves: int = CURVES, dims: int = DIMS, window: float = WINDOW, least: int = LEAST, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """The ``k`` nearest rows of every query row: query_id, rank, vec_id, score.

    ``is_query`` is a condition on column ``vec_id``.
    """
    spark = vectors.sparkSession
    rows = materialise(usable(vectors, vec_col, id_col), "vectors")
    smallest = Window.partitionBy("v").orderBy("vec_id")
    listed = rows.withColumn("n", F.row_number().over(smallest)).where(F.col("n") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asked = rows.where(is_query).select("v").distinct().withColumn("asked", F.lit(True))
    distinct = materialise(listed.join(asked, "v", "left").select(F.monotonically_increasing_id().alias("uid"), "v", "ids", F.coalesce("asked", F.lit(False)).alias("asked")), "distinct")
    total = distinct.count()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not total:
        return empty
    chosen = distinct.orderBy(F.xxhash64("v")).limit(sample).select("v").toPandas()["v"]
    orders = spark.sparkContext.broadcast(Orderings(np.stack(chosen.to_list()), curves, dims, BITS))

    def key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = orders.value.keys(stack(batch.column("v")))
            n, c = keys.shape
            yield pa.RecordBatch.from_pydict({"uid": pa.array(np.repeat(batch.column("uid").to_numpy(), c)), "curve": pa.array(np.tile(np.arange(c, dtype=np.int32), n)), "key": pa.array(keys.reshape(-1))})

    keyed = distinct.select("uid", "v").mapInArrow(key_rows, "uid long, curve int, key long")
    # Ranks along each curve: range partitions are stored, so their row numbers are fixed.
    ordered = materialise(keyed.repartitionByRange("curve", "key", "uid").sortWithinPartitions("curve", "key", "uid").withColumn("place", F.monotonically_increasing_id()), "curves")
    part = ordered.withColumn("part", F.shiftright("place", 33))
    counts = part.groupBy("curve", "part").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    earlier = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("curve", "part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    ranked = part.join(shift, ["curve", "part"]).select("uid", "curve", (F.col("place") + F.col("shift")).alias("position"))
    half = int(np.ceil(max(least, total * window) / 2))
    block = min(block, max(1, half // 2))
    spot = ranked.join(distinct.select("uid", "asked", "v").mapInArrow(code_rows, "uid long, asked boolean, code binary"), "uid")
    held = spot.select("curve", F.floor(F.col("position") / block).cast("long").alias("block"), F.lit(0).alias("role"), "uid", "code")
    last = (total - 1) // block
    reach = F.sequence(F.greatest(F.lit(0), F.floor((F.col("position") - half) / block)).cast("long"), F.least(F.lit(last), F.floor((F.col("position") + half) / block)).cast("long"))
    asking = spot.where("asked").select("curve", F.explode(reach).alias("block"), F.lit(1).alias("role"), "uid", "code")
    met = held.unionByName(asking).repartition("curve", "block").sortWithinPartitions("curve", "block", "role")
    top = k + 1 + SPARE

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, ids, x, xu = None, [], [], None
        for batch in batches:
            spot = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("curve", "block", "role")], axis=1)
            uid, v = batch.column("uid").to_numpy(), from_bytes(batch.column("code"))
            cuts = [0, *(np.flatnonzero((np.diff(spot, axis=0) != 0).any(axis=1)) + 1), len(spot)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                curve, number, role = spot[a]
                if here != (curve, number):
                    here, ids, x, xu = (curve, number), [], [], None
                if role == 0:  # at most ``block`` rows
                    ids.append(uid[a:b])
                    x.append(v[a:b])
                    continue
                if not ids:
                    continue
                if xu is None:
                    own, xu = np.concatenate(ids), np.concatenate(x)
                for at in range(a, b, 256):
                    end = min(b, at + 256)
                    near = v[at:end] @ xu.T
                    m = min(top, near.shape[1])
                    pick = np.argpartition(-near, m - 1, axis=1)[:, :m]
                    yield pa.RecordBatch.from_pydict({"asker": pa.array(np.repeat(uid[at:end], m)), "uid": pa.array(own[pick.reshape(-1)]), "near": pa.array(np.take_along_axis(near, pick, axis=1).reshape(-1))})

    found = met.mapInArrow(rerank, "asker long, uid long, near float").groupBy("asker", "uid").agg(F.max("near").alias("near"))
    best = found.withColumn("n", F.row_number().over(Window.partitionBy("asker").orderBy(F.desc("near"), "uid"))).where(F.col("n") <= top).select("asker", "uid")
    pairs = best.join(distinct.select("uid", "ids", F.col("v").alias("right")), "uid").join(distinct.where("asked").select(F.col("uid").alias("asker"), F.col("v").alias("left")), "asker")
    kind = distinct.schema["ids"].dataType.simpleString()
    measured = pairs.select("asker", "ids", "left", "right").mapInArrow(exact_rows, f"asker long, ids {kind}, score double")
    named = measured.select("asker", "score", F.explode("ids").alias("vec_id"))
    queries = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "v").join(distinct.where("asked").select("v", F.col("uid").alias("asker")), "v").select("query_id", "asker")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = queries.join(named, "asker").where(F.col("vec_id") != F.col("query_id")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: vec_id divisible by 50 against all rows, 5 nearest."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
