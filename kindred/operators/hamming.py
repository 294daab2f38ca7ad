"""Exact Hamming range join of 64-bit hashes by multi-index hashing.

Equal hashes form classes first, so a hash that fills the table joins as one
row.  Classes are dealt into tiles of bounded size, and every two tiles meet in
one place, so a class is shuffled once a tile and nothing else is: pairs are
found where two tiles meet, with arrays.

There a hash is cut into bands.  Two hashes at distance t or less agree within
r_i bits in some band i, whenever the radii r_i add up to t + 1 - bands
(Norouzi, Punjani & Fleet, 2012; Qin et al., 2018).  One tile looks up every
band value that close in a table of the other's; a check of the full distance,
and a check that no earlier band meets leave each pair in range once.  Tiles
with fewer classes than values to look up are compared all with all.

Links in range may be far more than classes, so groups never write them: a
tile's own links become labels, and two tiles give the forest that joins their
labels.  Classes that carry one label already need not meet: once most do, only
the others meet all.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from kindred.operators.components import connected_components

TILE = 1 << 17  # classes, about
LEAST_TILE = 1024
SPREAD = 8  # tiles of smaller tables, for all cores
PLACES = 1000  # tasks at most
FEW = 8  # classes a value to look up from which bands pay
STRIPS = 8  # parts of a tile between which labels are looked at
AT_ONCE = 1 << 18  # values looked up, or candidates compared


def masks(width: int, most: int) -> list[int]:
    """All masks of ``width`` bits with at most ``most`` set."""
    return [sum(1 << i for i in bits) for k in range(most + 1) for bits in combinations(range(width), k)]


def band_plan(distance: int, bands: int) -> list[tuple[int, int, int]]:
    """(lowest bit, width, radius) of each band; a negative radius means that the band is not needed."""
    edges = [64 * i // bands for i in range(bands + 1)]
    spare = distance + 1 - bands
    radii = [spare // bands + (i < spare % bands) for i in range(bands)]
    return [(a, b - a, r) for a, b, r in zip(edges, edges[1:], radii, strict=False)]


def hash_classes(hashed: DataFrame, id_col: str, hash_col: str) -> DataFrame:
    """h, rep (the least id) and members of each distinct hash."""
    return hashed.where(F.col(hash_col).isNotNull()).groupBy(F.col(hash_col).alias("h")).agg(F.min(id_col).alias("rep"), F.count("*").alias("members"))


def _value(h: np.ndarray, low: int, width: int) -> np.ndarray:
    return ((h >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64)


def hits(mask: np.ndarray) -> np.ndarray:
    """``np.flatnonzero`` of many cells with few hits: eight are looked at together."""
    flat = mask.ravel()
    even = len(flat) & ~7
    some = np.flatnonzero(flat[:even].view(np.uint64))
    row, cell = np.nonzero(flat[:even].reshape(-1, 8)[some])
    return np.concatenate([8 * some[row] + cell, even + np.flatnonzero(flat[even:])])


def _all_pairs(a: np.ndarray, b: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(i, j, distance) of a and b in range, all with all."""
    step = max(1, AT_ONCE // max(1, len(b)))
    for at in range(0, len(a), step):
        apart = np.bitwise_count(a[at : at + step, None] ^ b).ravel()
        hit = hits(apart <= distance)
        i, j = np.divmod(hit, len(b))
        yield i + at, j, apart[hit]


def _banded_pairs(a: np.ndarray, b: np.ndarray, distance: int, plan: list[tuple[int, int, int]]) -> Iterator[tuple[np.ndarray, ...]]:
    """The same by bands, each pair at its first one."""
    for k, (low, width, radius) in enumerate(plan):
        value = _value(b, low, width)
        order = np.argsort(value, kind="stable")
        begin = np.zeros((1 << width) + 1, np.int32)
        np.cumsum(np.bincount(value, minlength=1 << width), out=begin[1:])
        there, spelt = b[order], np.array(masks(width, radius))
        step = max(1, AT_ONCE // len(spelt))
        for at in range(0, len(a), step):
            asked = (_value(a[at : at + step], low, width)[:, None] ^ spelt).ravel()
            n = begin[asked + 1] - begin[asked]
            some = np.flatnonzero(n)
            if not len(some):
                continue
            total = np.cumsum(n[some], dtype=np.int64)
            cuts = np.searchsorted(total, np.arange(0, total[-1], AT_ONCE), side="right").tolist()
            for x, y in zip(cuts, [*cuts[1:], len(some)], strict=True):
                part = some[x:y]
                held = n[part].astype(np.int64)
                i = np.repeat(part // len(spelt) + at, held)
                j = np.arange(len(i)) + np.repeat(begin[asked[part]] - (np.cumsum(held) - held), held)
                apart = a[i] ^ there[j]
                far = np.bitwise_count(apart)
                ok = np.flatnonzero(far <= distance)
                for low0, width0, radius0 in plan[:k]:
                    ok = ok[np.bitwise_count(_value(apart[ok], low0, width0)) > radius0]
                yield i[ok], order[j[ok]], far[ok]


def near_pairs(a: np.ndarray, b: np.ndarray, distance: int, few: int = FEW) -> Iterator[tuple[np.ndarray, ...]]:
    """(i, j, distance) of the elements of a and b within ``distance``, each pair once."""
    plan = [p for p in band_plan(distance, 3) if p[2] >= 0]
    bands = few == 0 or len(b) > few * sum(len(masks(width, radius)) for _, width, radius in plan)
    return _banded_pairs(a, b, distance, plan) if bands else _all_pairs(a, b, distance)


def _dealt(classes: DataFrame, tiles: int, own: bool, hashes: tuple[str, ...] = ("h",)) -> DataFrame:
    """``classes`` with their tile, at the places (lo, hi) where it meets the others; ``own``: itself alone."""
    tile = F.pmod(F.xxhash64(*hashes), F.lit(tiles)).cast("int")
    if own:
        rows = classes.withColumn("tile", tile).withColumn("lo", tile).withColumn("hi", tile)
        return rows.repartition(min(2 * tiles, PLACES), "lo", "hi").sortWithinPartitions("lo", "hi")
    places = F.transform(F.sequence(F.lit(0), F.lit(tiles - 1)), lambda x: F.struct(F.least(tile, x).alias("lo"), F.greatest(tile, x).alias("hi")))
    rows = classes.withColumn("tile", tile).withColumn("_at", F.explode(places)).select(*classes.columns, "tile", "_at.lo", "_at.hi")
    return rows.repartition(min(tiles * (tiles + 1), PLACES), "lo", "hi").sortWithinPartitions("lo", "hi", "tile")


def _tiles(classes: DataFrame) -> int:
    n = classes.count()
    return max(1, -(-n // TILE), min(SPREAD, -(-n // LEAST_TILE)))


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each place (lo, hi); batches come in its order."""
    held: list[pa.RecordBatch] = []
    here = None
    for batch in batches:
        if not len(batch):
            continue
        spot = np.stack([batch.column(c).to_numpy() for c in ("lo", "hi")], axis=1)
        cuts = [0, *(np.flatnonzero((np.diff(spot, axis=0) != 0).any(axis=1)) + 1).tolist(), len(spot)]
        for x, y in zip(cuts, cuts[1:], strict=False):
            if held and tuple(spot[x]) != here:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            here = tuple(spot[x])
            held.append(batch.slice(x, y - x))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _sides(place: pa.Table) -> tuple[np.ndarray, int, int]:
    """(hashes, where the second tile begins, where the first ends); one tile alone is both."""
    h, tile = place["h"].to_numpy().view(np.uint64), place["tile"].to_numpy()
    cut = int(np.searchsorted(tile, tile[0], side="right"))
    return (h, cut, cut) if cut < len(h) else (h, 0, len(h))


def _met(place: pa.Table, distance: int, few: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(i, j, distance) of the rows in range of a place."""
    h, second, first = _sides(place)
    for i, j, far in near_pairs(h[:first], h[second:], distance, few):
        if not second:
            once = i < j
            i, j, far = i[once], j[once], far[once]
        yield i, j + second, far


def class_pairs(classes: DataFrame, distance: int, few: int = FEW) -> DataFrame:
    """(a, b, dist): class representatives a < b within ``distance``.

    ``classes`` is read twice, so it should be a stored table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place in _places(batches):
            lo, hi, reps = place["lo"][0].as_py(), place["hi"][0].as_py(), place["rep"].combine_chunks()
            if lo != hi and place["tile"][0] == place["tile"][-1]:
                continue  # the other tile is empty
            for i, j, far in _met(place, distance, few):
                yield pa.RecordBatch.from_pydict({"a": reps.take(pa.array(i)), "b": reps.take(pa.array(j)), "dist": pa.array(far.astype(np.int32))})

    kind = classes.schema["rep"].dataType.simpleString()
    found = _dealt(classes.select("h", "rep"), _tiles(classes), own=False).mapInArrow(run, f"a {kind}, b {kind}, dist int")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "dist")


def _joined(root: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Components of numbered nodes: ``root`` (each its own, or a root) after linking all pairs; the least number is the root."""
    for x, y in pairs:
        while True:
            x, y = root[x], root[y]
            apart = x != y
            x, y = x[apart], y[apart]
            if not len(x):
                break
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while True:
                further = root[root]
                if np.array_equal(further, root):
                    break
                root = further
    return root


def _linked(h: np.ndarray, one: np.ndarray, two: np.ndarray, label: np.ndarray, root: np.ndarray, distance: int, few: int) -> np.ndarray:
    """``_joined`` over the labels of all rows of ``one`` in range of rows of ``two``; these are the same rows or none.

    Rows of the commonest label are not compared with each other.
    """
    rows, within = np.union1d(one, two), np.array_equal(one, two)
    _, first, equal = np.unique(h[rows], return_index=True, return_inverse=True)
    root = _joined(root, [(label[rows], label[rows[first[equal]]])])
    at, step = 0, LEAST_TILE
    while at < len(one) and len(two):
        there = two[at:] if within else two
        now = root[label]
        common = np.bincount(now[there]).argmax()
        if at > LEAST_TILE and np.count_nonzero(now[there] == common) * STRIPS < len(there):
            step = len(one)  # too many labels for another look
        some = one[at : at + step]
        inside, other = now[some] == common, there[now[there] != common]
        for x, y in ((some[~inside], there), (some[inside], other)):
            if len(x) and len(y):
                root = _joined(root, ((label[x[i]], label[y[j]]) for i, j, _ in near_pairs(h[x], h[y], distance, few)))
        at += step
        step = max(LEAST_TILE, -(-len(one) // STRIPS))
    return root


def _links(h: np.ndarray, one: np.ndarray, two: np.ndarray, distance: int) -> int:
    """Pairs in range among the first rows."""
    return sum(len(i) for i, _, _ in _all_pairs(h[one[:256]], h[two[-2048:]], distance))


def _rooted(place: pa.Table, distances: dict[str, int], label: np.ndarray, few: int) -> np.ndarray:
    """Roots of the labels of a place's rows after linking what is in range by any hash, the hash with most links first."""
    tile = place["tile"].to_numpy()
    cut = int(np.searchsorted(tile, tile[0], side="right"))
    sides = (np.arange(cut), np.arange(cut, len(tile))) if cut < len(tile) else (np.arange(cut),) * 2
    asked = []
    for name, distance in distances.items():
        column = place[name].combine_chunks()
        known, h = column.is_valid().to_numpy(zero_copy_only=False), column.fill_null(0).to_numpy().view(np.uint64)
        one, two = (x[known[x]] for x in sides)
        asked.append((_links(h, one, two, distance), h, one, two, distance))
    root = np.arange(label.max() + 1)
    for _, h, one, two, distance in sorted(asked, key=lambda x: -x[0]):
        root = _linked(h, one, two, label, root, distance, few)
    return root


def class_forest(classes: DataFrame, distance: int | dict[str, int], few: int = FEW) -> DataFrame:
    """(src, dst): edges between representatives whose components are those of ``class_pairs``.

    Classes may have several hashes, each with its distance: one in range is
    enough.  At most one edge a class from its own tile, and where two tiles
    meet fewer than they have labels together.
    """
    from kindred.storage import materialise

    distances = distance if isinstance(distance, dict) else {"h": distance}

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place in _places(batches):
            root = _rooted(place, distances, np.arange(len(place)), few)
            reps = place["rep"].combine_chunks()
            yield pa.RecordBatch.from_pydict({c: place[c].combine_chunks() for c in distances} | {"rep": reps, "label": reps.take(pa.array(root))})

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place in _places(batches):
            if place["tile"][0] == place["tile"][-1]:
                continue  # one tile alone was done before
            coded = place["label"].combine_chunks().dictionary_encode()
            named = coded.dictionary
            root = _rooted(place, distances, coded.indices.to_numpy(), few)
            moved = np.flatnonzero(root != np.arange(len(root)))
            yield pa.RecordBatch.from_pydict({"src": named.take(pa.array(moved)), "dst": named.take(pa.array(root[moved]))})

    kind = classes.schema["rep"].dataType.simpleString()
    tiles = _tiles(classes)
    hashes = ", ".join(f"`{c}` long" for c in distances)
    labels = materialise(_dealt(classes.select(*distances, "rep"), tiles, own=True, hashes=tuple(distances)).mapInArrow(alone, f"{hashes}, rep {kind}, label {kind}"), "tiles")
    inner = labels.where(F.col("rep") != F.col("label")).select(F.col("rep").alias("src"), F.col("label").alias("dst"))
    if tiles == 1:
        return inner
    return inner.unionByName(_dealt(labels, tiles, own=False, hashes=tuple(distances)).mapInArrow(across, f"src {kind}, dst {kind}"))


def hash_edges(hashed: DataFrame, id_col: str, hash_col: str, distance: int) -> DataFrame:
    """(src, dst): edges whose components are the single-link groups within ``distance``."""
    from kindred.storage import materialise

    classes = materialise(hash_classes(hashed, id_col, hash_col), "classes")
    members = hashed.select(F.col(id_col).alias("src"), F.col(hash_col).alias("h")).join(classes.where("members > 1").select("h", F.col("rep").alias("dst")), "h").select("src", "dst")
    return members.unionByName(class_forest(classes, distance))


def union_edges(hashed: DataFrame, id_col: str, distances: dict[str, int]) -> DataFrame:
    """(src, dst): edges whose components are the groups that any hash column links within its distance.

    Rows of equal hashes are one class; what one column has linked needs no
    comparison by the next.
    """
    from kindred.storage import materialise

    known = hashed.where(F.coalesce(*distances).isNotNull()).select(F.col(id_col).alias("src"), *distances)
    classes = materialise(known.groupBy(*distances).agg(F.min("src").alias("rep"), F.count("*").alias("members")), "classes")
    many = classes.where("members > 1").select(*(F.col(c).alias(f"_{c}") for c in distances), F.col("rep").alias("dst"))
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in distances))
    return known.join(many, same).select("src", "dst").unionByName(class_forest(classes, distances))


def hash_groups_of(hashed: DataFrame, id_col: str, distances: dict[str, int]) -> list[DataFrame]:
    """(id, label) for each hash column: single-link groups within its distance; label is the least id.

    Every id appears; those without a partner label themselves.  The columns'
    components are found together, as those of (column, id).
    """
    from kindred.storage import materialise

    vertex = lambda k, c: F.struct(F.lit(k).alias("k"), F.col(c).alias("id"))
    edges = reduce(DataFrame.unionByName, (hash_edges(hashed, id_col, c, d).select(vertex(k, "src").alias("src"), vertex(k, "dst").alias("dst")) for k, (c, d) in enumerate(distances.items())))
    labels = materialise(connected_components(edges).select(F.col("id.k").alias("k"), F.col("id.id").alias("id"), F.col("component.id").alias("label")), "labels")
    every = hashed.select(F.col(id_col).alias("id"), *distances)
    return [every.where(F.col(c).isNotNull()).select("id").join(labels.where(F.col("k") == k).drop("k"), "id", "left").select("id", F.coalesce("label", "id").alias("label")) for k, c in enumerate(distances)]


def hash_groups(hashed: DataFrame, id_col: str, hash_col: str, distance: int) -> DataFrame:
    """``hash_groups_of`` for one column."""
    labels = connected_components(hash_edges(hashed, id_col, hash_col, distance))
    return hashed.where(F.col(hash_col).isNotNull()).select(F.col(id_col).alias("id")).join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("label"))
