"""First fit of groups of any size, block by block, without their links.

A group's items come in blocks of about ``BLOCK``, in order.  A block meets the
items placed before, dealt over the tasks by pieces of clusters: an item may
enter a cluster whose every member it is linked with.  It meets a piece's
members some at a time and goes no further once one shuts it out, so most
members of a large cluster are never tested.  The block's own items then take
their places one after another, knowing these clusters and their own links.
Links are tested with arrays where items meet and never written, so a group's
pairs cost time but no space, and no task holds a group.

An item gets its ``KEEP`` earliest clusters.  Should block mates have shut it
out of all of those, the rest of the block waits and meets the placed items
again; the first that waits always finds its place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from kindred.storage import discard, materialise

BLOCK = 1 << 16
KEEP = 64
PIECE = 2048  # members of a cluster that are dealt together
FEW = 256  # members met at a time
ROWS = 4096  # items that meet them at a time
STRIP = 256  # items of a block whose links are held at a time

Rows = slice | np.ndarray


@dataclass(frozen=True)
class Links:
    """A test of rasters with each other.

    ``ready`` makes arrays of rasters of one size, a row each; ``linked(a, i, b, j)``
    tells which rows i of one such tuple pass with which rows j of another.
    """

    ready: Callable[[np.ndarray], tuple[np.ndarray, ...]]
    linked: Callable[[tuple[np.ndarray, ...], Rows, tuple[np.ndarray, ...], Rows], np.ndarray]


class _Side:
    """Rasters made ready for a test; those of different sizes are not linked."""

    def __init__(self, links: Links, grey: pa.ChunkedArray):
        column = grey.combine_chunks()
        self.links = links
        self.size = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
        self.row = np.zeros(len(self.size), np.int64)
        self.ready: dict[int, tuple[np.ndarray, ...]] = {}
        values, begin = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(self.size) - self.size
        for size in np.unique(self.size).tolist():
            rows = np.flatnonzero(self.size == size)
            self.row[rows] = np.arange(len(rows))
            self.ready[size] = links.ready(values.reshape(-1, size) if len(rows) == len(self.size) else values[begin[rows][:, None] + np.arange(size)])

    def linked(self, i: Rows, other: _Side, j: Rows) -> np.ndarray:
        """Which of the items i are linked with which of the other side's j."""
        if len(self.ready) == 1 and self.ready.keys() == other.ready.keys():
            (a,), (b,) = self.ready.values(), other.ready.values()
            return self.links.linked(a, i, b, j)
        out = np.zeros((len(self.size[i]), len(other.size[j])), bool)
        for size in self.ready.keys() & other.ready.keys():
            x, y = np.flatnonzero(self.size[i] == size), np.flatnonzero(other.size[j] == size)
            if len(x) and len(y):
                out[np.ix_(x, y)] = self.links.linked(self.ready[size], self.row[i][x], other.ready[size], other.row[j][y])
        return out


def _gathered(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key; batches come in the keys' order."""
    held: list[pa.RecordBatch] = []
    here = None
    for batch in batches:
        spots = list(zip(*(batch.column(c).to_pylist() for c in keys), strict=True))
        begin = 0
        for k, spot in enumerate(spots):
            if spot != here:
                if k > begin:
                    held.append(batch.slice(begin, k - begin))
                if held:
                    yield pa.Table.from_batches(held)
                held, here, begin = [], spot, k
        if len(spots) > begin:
            held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held)


def _entered(asking: _Side, there: _Side, begin: np.ndarray, held: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(items, clusters): who is linked with all members there; a cluster's ``held`` members follow its ``begin``."""
    n, k = len(asking.size), 0
    while k < len(begin):
        after = max(k + 1, int(np.searchsorted(begin + held, begin[k] + FEW, side="right")))
        for at in range(0, n, ROWS):
            if after > k + 1:  # small clusters together
                free = np.logical_and.reduceat(asking.linked(slice(at, at + ROWS), there, slice(begin[k], begin[after - 1] + held[after - 1])), begin[k:after] - begin[k], axis=1)
                i, c = np.nonzero(free)
                yield at + i, k + c
                continue
            left: Rows = slice(at, at + ROWS)
            rows = np.arange(at, min(n, at + ROWS))
            for some in range(begin[k], begin[k] + held[k], FEW):
                rows = left = rows[asking.linked(left, there, slice(some, min(some + FEW, begin[k] + held[k]))).all(axis=1)]
                if not len(rows):
                    break
            yield rows, np.full(len(rows), k)
        k = after


def _open_clusters(block: DataFrame, placed: DataFrame, links: Links, parts: int) -> DataFrame:
    """_id, seq, seeds, held: the earliest clusters an item of ``block`` may enter and their members so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place in _gathered(batches, ["_id", "_part"]):
            new = place["seed"].is_null().combine_chunks().to_numpy(zero_copy_only=False)
            asking, there = place.filter(pa.array(new)), place.filter(pa.array(~new))
            if not len(asking) or not len(there):
                continue
            seq = asking["seq"].to_numpy()
            named, begin, held = np.unique(there["seed"].to_numpy(), return_index=True, return_counts=True)
            for i, k in _entered(_Side(links, asking["grey"]), _Side(links, there["grey"]), begin, held):
                if len(i):
                    yield pa.RecordBatch.from_pydict({"_id": pa.array(np.full(len(i), place["_id"][0].as_py())), "seq": pa.array(seq[i]), "seed": pa.array(named[k]), "n": pa.array(held[k])})

    each = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    piece = F.pmod(F.xxhash64("seed", F.floor(F.col("place") / PIECE)), F.lit(parts)).cast("int")
    both = placed.select("_id", piece.alias("_part"), "seq", "seed", "grey")
    both = both.unionByName(block.select("_id", each.alias("_part"), "seq", F.lit(None).cast("long").alias("seed"), "grey"))
    task = (F.pmod("_id", F.lit(parts)) + F.col("_part")).cast("int")
    met = both.repartitionById(parts, task).sortWithinPartitions("_id", "_part", "seed")
    passed = met.mapInArrow(run, "_id long, seq long, seed long, n long").groupBy("_id", "seq", "seed").agg(F.sum("n").alias("n"))
    sizes = placed.groupBy("_id", "seed").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("_id", "seq").orderBy("seed"))
    first = passed.join(sizes, ["_id", "seed", "n"]).withColumn("rank", rank).where(F.col("rank") <= KEEP)
    return first.groupBy("_id", "seq").agg(F.array_sort(F.collect_list(F.struct("seed", "n"))).alias("_c")).select("_id", "seq", F.col("_c.seed").alias("seeds"), F.col("_c.n").alias("held"))


def _joined(side: _Side, items: np.ndarray) -> np.ndarray:
    """Those of ``items``, one after another, that are linked with all taken before."""
    taken = [items[:0]]
    while len(items):
        some, items = items[:STRIP], items[STRIP:]
        linked, free, fresh = side.linked(some, side, some), np.ones(len(some), bool), []
        for i in range(len(some)):
            if free[i]:
                fresh.append(i)
                free &= linked[i]
        taken.append(some[fresh])
        if len(items):
            items = np.concatenate([x[side.linked(x, side, taken[-1]).all(axis=1)] for x in (items[at : at + ROWS] for at in range(0, len(items), ROWS))])
    return np.concatenate(taken)


def _begun(side: _Side, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First fit of ``items`` among themselves: the first item of each one's cluster and its place there.

    One cluster after another while they are large, then one item after another.
    """
    first, places, free = np.zeros(len(items), np.int64), np.zeros(len(items), np.int64), np.ones(len(items), bool)
    while free.any():
        left = np.flatnonzero(free)
        into = left[np.isin(items[left], _joined(side, items[left]), assume_unique=True)]
        first[into], places[into], free[into] = items[into[0]], np.arange(len(into)), False
        if len(into) < FEW:
            break
    left = np.flatnonzero(free)
    first[left], places[left] = _one_by_one(side, items[left])
    return first, places


def _one_by_one(side: _Side, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``_begun`` by each item's links with all before it."""
    n, clusters = len(items), 0
    mine, place, shut = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    first, sizes = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(n):
        if i % STRIP == 0:
            apart = ~np.hstack([side.linked(items[i : i + STRIP], side, items[j : min(j + ROWS, i + STRIP)]) for j in range(0, i + STRIP, ROWS)])
        against = mine[np.flatnonzero(apart[i % STRIP, :i])]
        shut[against] = True
        k = int(shut[: clusters + 1].argmin())  # the next cluster is never shut
        shut[against] = False
        if k == clusters:
            first[k] = items[i]
            clusters += 1
        mine[i], place[i] = k, sizes[k]
        sizes[k] += 1
    return first[mine], place


def _in_turn(seq: np.ndarray, asked: tuple[np.ndarray, np.ndarray, np.ndarray], side: _Side, keep: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Seeds of a block's items as if one after another, their places there, and how many are decided.

    ``asked`` has the clusters that an item may enter: item, seed, members so
    far.  These are older than any that begins in the block.  Who enters one
    depends on those only who come to it, so they are filled in order of seeds.
    """
    n = len(seq)
    homes, places, free = np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, bool)
    order = np.lexsort(asked[:2])
    item, seed, held = (x[order] for x in asked)
    cuts = np.flatnonzero(np.diff(seed, prepend=seed[:1] - 1)) if len(seed) else np.zeros(0, np.int64)
    for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(seed)], strict=False):
        some = item[x:y]
        into = _joined(side, some[free[some]])
        homes[into], places[into], free[into] = seed[x], held[x] + np.arange(len(into)), False
    stuck = np.flatnonzero(free & (np.bincount(item, minlength=n) >= keep))
    decided = int(stuck[0]) if len(stuck) else n
    left = np.flatnonzero(free[:decided])
    first, places[left] = _begun(side, left)
    homes[left] = seq[first]
    return homes, places, decided


def _placed(block: DataFrame, links: Links, tasks: int) -> DataFrame:
    """_id, seq, grey, seed, place of a block (_id, seq, grey, seeds, held); no seed from where known clusters do not decide."""
    keep = KEEP

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _gathered(batches, ["_id"]):
            seeds, held = rows["seeds"].combine_chunks(), rows["held"].combine_chunks()
            item = np.repeat(np.arange(len(rows)), pc.fill_null(pc.list_value_length(seeds), 0).to_numpy(zero_copy_only=False))
            asked = (item, seeds.flatten().to_numpy(), held.flatten().to_numpy())
            homes, places, decided = _in_turn(rows["seq"].to_numpy(), asked, _Side(links, rows["grey"]), keep)
            waits = np.arange(len(rows)) >= decided
            found = rows.select(["_id", "seq", "grey"]).append_column("seed", pa.array(homes, mask=waits)).append_column("place", pa.array(places, mask=waits))
            yield from found.to_batches()

    dealt = block.repartition(tasks, "_id").sortWithinPartitions("_id", "seq").select("_id", "seq", "grey", "seeds", "held")
    return dealt.mapInArrow(run, "_id long, seq long, grey array<int>, seed long, place long")


def first_fit(items: DataFrame, links: Links) -> DataFrame:
    """_g, seq, seed (the first member of its cluster) of every item (_g, seq, grey)."""
    spark = items.sparkSession
    cores = spark.sparkContext.defaultParallelism
    groups = materialise(items.groupBy("_g").agg(F.count("*").alias("n")).withColumn("_id", F.xxhash64("_g")), "groups")
    if groups.select("_id").distinct().count() != groups.count():
        raise RuntimeError("two groups share a number")
    n = groups.agg(F.sum("n")).first()[0] or 0
    ranged = items.withColumn("_id", F.xxhash64("_g")).select("_id", "seq", "grey").repartitionByRange(max(1, -(-n // BLOCK)), "_id", "seq")
    blocks = materialise(ranged.withColumn("_block", F.spark_partition_id()), "blocks")
    order = Window.partitionBy("_id").orderBy("_block")
    turns = materialise(blocks.select("_id", "_block").distinct().withColumn("_turn", F.row_number().over(order)), "turns")
    done: list[DataFrame] = []
    path = lambda t: t.inputFiles()[0].rsplit("/", 1)[0]
    for turn in range(1, (turns.agg(F.max("_turn")).first()[0] or 0) + 1):
        waiting = blocks.join(F.broadcast(turns.where(F.col("_turn") == turn)), ["_id", "_block"], "left_semi").select("_id", "seq", "grey")
        waiting = waiting.repartition(cores)  # a block is one file, which each part of the placed items meets
        while True:
            if done:
                earlier = spark.read.schema(done[0].schema).parquet(*map(path, done)).where("seed IS NOT NULL")
                asking = waiting.join(_open_clusters(waiting, earlier, links, 2 * cores), ["_id", "seq"], "left")
            else:
                none = F.array().cast("array<long>")
                asking = waiting.withColumn("seeds", none).withColumn("held", none)
            now = materialise(_placed(asking, links, cores), "placed")
            done.append(now)
            waiting = now.where("seed IS NULL").select("_id", "seq", "grey")
            if waiting.isEmpty():
                break
    discard(blocks, turns)
    if not done:
        return groups.select("_g", F.lit(0).cast("long").alias("seq"), F.lit(0).cast("long").alias("seed")).where("false")
    placed = spark.read.schema(done[0].schema).parquet(*map(path, done)).where("seed IS NOT NULL")
    return placed.join(groups.select("_id", "_g"), "_id").select("_g", "seq", "seed")
