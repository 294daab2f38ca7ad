"""N-gram Jaccard join by parity sketches, and the components of its links.

A text is the set of its hashed word shingles.  Sets of sizes a and b with
Jaccard similarity of at least t differ in at most (1 - t) / (1 + t) * (a + b)
elements.  A parity sketch XORs every element into one bit; the Hamming
distance of two sketches can only be smaller than the symmetric difference.
The sketch's 64-bit words deal the elements into that many blocks, so with
more blocks than allowed differences some blocks must be equal: the XOR of the
hashes in a block is a join key (pigeonhole), within bands of similar set
sizes.  More blocks than needed let every text leave out some: its empty ones,
then the keys that most other texts hold, which would join unrelated texts.

* equal sets meet first, by digest, and go on as one;
* the texts of a key that many hold first meet one leader, so that most of a
  large group are linked before any two of them are compared;
* the texts of a key are compared in tiles of bounded size by folded sketches
  and give a spanning forest of the pairs that pass, not all pairs; texts of a
  key's largest component meet only those outside of it;
* every candidate pair is verified on the exact sets.  Where verification
  breaks a forest, the keys that both texts of a refuted pair hold run again,
  for the texts linked to one of such a pair, with the links known so far and
  without any pair refuted so far, until no candidate joins two components.

So no link between different texts is lost, no key's texts meet in one task
and no group's pairs are all written or, where its texts are alike, compared.
The keys XOR whole hashes and not just the sketch's bits: blocks of the sketch
alone are equal by chance too often; the sketch is the filter that follows.

Defined results: null texts and texts without words have an empty set and link
with nothing; with fewer words than ``shingle`` the whole sequence is the one
element; repeated rows each give a row; a null id belongs to the component but
never names it.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window

from kindred.llm.arrowtext import clear_driver, hash_strings, mix, slices, small_batches, texts, words
from kindred.operators.components import connected_components
from kindred.storage import discard, materialise

SHINGLE = 3
SIMILARITY = (90, 100)
SPARE = 0.3  # more blocks than differences allowed
TILE = 512


def shingle_sets(values: pa.Array, size: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    index, listed, ends = words(values)
    h = hash_strings(listed)[index]
    n = np.diff(ends)
    short = np.minimum(n, size)
    total = np.zeros(len(h), np.uint64)
    for k in range(size):  # the hash of a shingle is kept at its first word
        moved = np.concatenate((h[k:], np.zeros(min(k, len(h)), np.uint64)))
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + moved + np.uint64(k + 1))
    out = []
    for a, b, s in zip(ends[:-1], ends[1:], short, strict=True):
        if not s:
            out.append(np.zeros(0, np.uint64))
        elif s < size:
            out.append(np.array([xxhash.xxh3_64_intdigest(h[a:b].tobytes())], np.uint64))
        else:
            out.append(np.unique(total[a : b - size + 1]))
    return out


class Bands:
    """Size bands and blocks for similarity ``num`` / ``den``.

    Band k holds sizes in [edge[k], edge[k + 1]), whose ratio is at most
    (den / num) squared.  A text links only within its band and the next, and
    only with a size above ``num / den`` of the next band's least in the next.
    """

    def __init__(self, num: int, den: int, spare: float = SPARE):
        self.num, self.den = num, den
        edges = [1]
        while edges[-1] < 1 << 32:
            edges.append(max(edges[-1] + 1, edges[-1] * den * den // (num * num)))
        self.edges = np.array(edges)
        self.spare = spare

    def of(self, size: int) -> int:
        return int(np.searchsorted(self.edges, size, side="right")) - 1

    def reaches(self, size: int) -> bool:
        """Whether a text may link into the next band."""
        return size * self.den >= int(self.edges[self.of(size) + 1]) * self.num

    def allowed(self, total: int) -> int:
        """Differences two sets of ``total`` elements together may have."""
        return (self.den - self.num) * total // (self.den + self.num)

    def blocks(self, band: int) -> tuple[int, int]:
        """(blocks of a band's sketch, words a text may leave out)."""
        most = self.allowed(2 * (int(self.edges[band + 1]) - 1))
        out = floor(most * self.spare / 2)
        return most + 1 + 2 * out, out


def sketch(elements: np.ndarray, blocks: int) -> np.ndarray:
    """Parity sketch of ``blocks`` 64-bit words."""
    at = ((elements >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
    bits = np.bincount(at * 64 + (elements & np.uint64(63)).astype(np.int64), minlength=blocks * 64) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view("<u8")


def fold_sketch(sketched: np.ndarray) -> bytes:
    """The sketch with each word folded to 16, 8 or 4 bits, the fewer the more words.

    Folding XORs parts of a word together, so the result is a parity sketch of
    the same elements with fewer bits, still at least four a difference
    allowed, and its distances are lower bounds as well.
    """
    bits = 16 if len(sketched) <= 32 else 8 if len(sketched) <= 128 else 4
    word, wide = sketched.copy(), 64
    while wide > bits:
        wide //= 2
        word = word ^ (word >> np.uint64(wide))
    word &= np.uint64((1 << bits) - 1)
    if bits == 16:
        return word.astype("<u2").tobytes()
    if bits == 4:
        word = np.append(word, np.zeros(len(word) % 2, np.uint64))
        word = word[::2] | word[1::2] << np.uint64(4)
    return word.astype(np.uint8).tobytes()


def bits_apart(a: bytes, b: bytes) -> int:
    return (int.from_bytes(a, "little") ^ int.from_bytes(b, "little")).bit_count()


def block_keys(elements: np.ndarray, blocks: int, band: int, leave: int) -> np.ndarray:
    """Join keys of a set's blocks without its ``leave`` emptiest ones.

    A block's key XORs the whole hashes of its elements, not only their bits
    of the sketch, so that blocks meet when they hold the same elements and
    hardly ever by chance.  ``elements`` are sorted, so blocks are runs.
    """
    at = ((elements >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
    held = np.bincount(at, minlength=blocks)
    total = np.zeros(blocks, np.uint64)
    some = np.flatnonzero(held)
    total[some] = np.bitwise_xor.reduceat(mix(elements), (np.cumsum(held) - held)[some])
    place = np.sort(np.argsort(held, kind="stable")[leave:]) if leave else np.arange(blocks)
    return mix(mix(np.uint64(band) << np.uint64(32) | place.astype(np.uint64)) + total[place])


def _digests(sets: list[np.ndarray], seed: int) -> list[bytes]:
    return [xxhash.xxh3_128_digest(x.tobytes(), seed) for x in sets]


def _nodes(digests: list[bytes]) -> np.ndarray:
    """The first 64 bits of each digest."""
    return np.frombuffer(b"".join(d[:8] for d in digests), "<i8")


def text_sets(docs: DataFrame, *, id_col: str, text_col: str, shingle: int, seed: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, ``keep``, n_shingles, digest, node) of every row; the last two are null for empty sets."""
    columns = (id_col, *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                sets = shingle_sets(texts(part, text_col), shingle)
                digests = _digests(sets, seed)
                none = np.array([not len(x) for x in sets], bool)
                yield pa.RecordBatch.from_pydict({c: part.column(c) for c in columns} | {"n_shingles": pa.array([len(x) for x in sets], pa.int64()), "digest": pa.array([d if len(x) else None for d, x in zip(digests, sets, strict=True)], pa.binary()), "node": pa.array(_nodes(digests), mask=none)})

    used = docs.select(*columns, text_col)
    kept = ", ".join(f"`{c}` {used.schema[c].dataType.simpleString()}" for c in columns)
    return used.mapInArrow(run, f"{kept}, n_shingles long, digest binary, node long")


def distinct_sets(docs: DataFrame, *, id_col: str, text_col: str, shingle: int, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, int]:
    """(rows with their sets' digests, one row per distinct set, the digests' seed).

    A set's ``low`` is the least (id, *keep) of its rows that have an id.
    Nodes are 64 bits of the digest; should two sets share one, another seed
    is taken, so that nodes stand for sets one to one.
    """
    for seed in range(8):
        sets = materialise(text_sets(docs, id_col=id_col, text_col=text_col, shingle=shingle, seed=seed, keep=keep), "sets")
        low = F.min(F.when(F.col(id_col).isNotNull(), F.struct(F.col(id_col).alias("id"), *keep)))
        grouped = sets.where(F.col("digest").isNotNull()).groupBy("digest").agg(low.alias("low"), F.min("n_shingles").alias("n"), F.min("node").alias("node"))
        reps = materialise(grouped, "reps")
        if reps.select("node").distinct().count() == reps.count():
            return sets, reps, seed
    raise RuntimeError("no seed gives every set its own number")


def empty_blocks(elements: np.ndarray, blocks: int) -> int:
    """How many of a set's blocks hold nothing."""
    return blocks - len(np.unique((elements >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)))


def one_of_equal(rows: DataFrame) -> DataFrame:
    """One of the keys that the very same sets hold, which would give the same comparisons.

    (key, node, own, spare, leader, held, stands): the least set of a key, how
    many hold it and for how many keys it stands; keys of one set go.
    """
    holders = rows.groupBy("key").agg(F.count("*").alias("held"), F.min("node").alias("leader"), F.bit_xor(F.xxhash64("node", "own")).alias("x"), F.bit_xor(F.xxhash64("own", "node", F.lit(1))).alias("y"))
    kept = holders.where("held > 1").groupBy("held", "x", "y").agg(F.min("key").alias("key"), F.min("leader").alias("leader"), F.count("*").alias("stands"))
    return rows.join(kept.select("key", "leader", "held", "stands"), "key")


def without_hot(rows: DataFrame) -> DataFrame:
    """Rows of ``one_of_equal`` without the keys each set spares: those that most sets hold, ``spare`` a set and band at most.

    A key counts as many times as it stands for keys, so no two sets that may
    link lose all of theirs.
    """
    hottest = Window.partitionBy("node", "own").orderBy(F.desc(F.col("held") / F.col("stands")), "key")
    return rows.select("key", "node", "own", "spare", F.sum("stands").over(hottest).alias("_left")).where("_left > spare").drop("_left")


def join_keys(docs: DataFrame, bands: Bands, *, text_col: str, shingle: int, seed: int) -> DataFrame:
    """(key, node, own, leader, held): keys that several sets hold, the least of them and how many do.

    Of keys that the same sets hold one stays, and sets spare their hottest.

    A task emits each distinct set once; only keys and numbers are shuffled,
    once: a key's rows meet, and those of a single set end there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[bytes] = set()
        for batch in batches:
            for part in slices(batch, text_col):
                if len(done) > 500_000:
                    done.clear()
                sets = [x for x in shingle_sets(texts(part, text_col), shingle) if len(x)]
                digests = _digests(sets, seed)
                keys, owner, which, spare = [], [], [], []
                for x, digest, node in zip(sets, digests, _nodes(digests), strict=True):
                    if digest in done:
                        continue
                    done.add(digest)
                    for k in range(1 + bands.reaches(len(x))):
                        band = bands.of(len(x)) + k
                        blocks, leave = bands.blocks(band)
                        empty = min(leave, empty_blocks(x, blocks))
                        found = block_keys(x, blocks, band, empty)
                        keys.append(found)
                        owner.append(np.full(len(found), node))
                        which.append(np.full(len(found), k == 0))
                        spare.append(np.full(len(found), leave - empty, np.int32))
                if keys:
                    yield pa.RecordBatch.from_pydict({"key": pa.array(np.concatenate(keys).view(np.int64)), "node": pa.array(np.concatenate(owner)), "own": pa.array(np.concatenate(which)), "spare": pa.array(np.concatenate(spare))})

    keyed = docs.select(text_col).mapInArrow(run, "key long, node long, own boolean, spare int")
    of_key = Window.partitionBy("key")
    met = keyed.withColumn("_least", F.min("node").over(of_key)).withColumn("_most", F.max("node").over(of_key)).where("_least <> _most")
    # Stored before it is counted, so that a hot key's rows may be split.
    rows = materialise(met.select("key", "node", "own", "spare").distinct(), "rows")
    cool = materialise(without_hot(one_of_equal(rows)), "cool")
    out = materialise(one_of_equal(cool).drop("spare", "stands"), "keys")
    discard(rows, cool)
    return out


def broken_rows(keys: DataFrame, open_pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``keys`` that may hold an untested pair between two components.

    A tree of a key's forest came apart where one of its edges was refuted, so
    both texts of an open pair hold the key, and every text of that tree is
    linked to a text of some open pair.
    """
    ends = open_pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    known = labels.select(F.col("id").alias("node"), "component")
    near = known.join(known.join(ends, "node", "left_semi").select("component").distinct(), "component", "left_semi").select("node")
    rows = keys.join(ends.unionByName(near).distinct(), "node", "left_semi")
    held = rows.select("key", "node")
    first = open_pairs.select("a", F.col("b").alias("node")).join(held.withColumnRenamed("node", "a"), "a").select("key", "node")
    return rows.join(held.join(first, ["key", "node"], "left_semi").select("key").distinct(), "key", "left_semi")


def read_sets(docs: DataFrame, wanted: DataFrame, make, fields: str, *, id_col: str, text_col: str, shingle: int, seed: int) -> DataFrame:
    """``make(set)`` as a row of ``fields`` for the sets of ``wanted`` (node, digest, low), with their node.

    A Bloom filter on the ids spares the other texts; an equi-join on the
    digest decides.
    """
    from kindred.llm.url_filter import build_filter, maybe_listed

    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    blocks = docs.sparkSession.sparkContext.broadcast(build_filter(wanted.select(name("low.id").alias("key")), 1 << 18))
    parts = [f.split() for f in fields.split(", ")]
    types = {"binary": pa.binary(), "long": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.filter(pa.array(maybe_listed(batch.column("_hash").to_numpy(), blocks.value))), text_col):
                sets = [x for x in shingle_sets(texts(part, text_col), shingle) if len(x)]
                made = list(zip(*(make(x) for x in sets), strict=True)) or [[] for _ in parts]
                yield pa.RecordBatch.from_pydict({"digest": pa.array(_digests(sets, seed), pa.binary())} | {c: pa.array(v, types[t]) for (c, t), v in zip(parts, made, strict=True)})

    found = docs.select(text_col, F.xxhash64(name(id_col)).alias("_hash")).mapInArrow(run, f"digest binary, {fields}")
    return wanted.select("node", "digest").join(found.dropDuplicates(["digest"]), "digest").drop("digest")


def _forest(bands: Bands):
    """Spanning forests of the passing pairs of each (key, tile pair)."""

    def small(node, tile, n, label, raw, refuted, cross: bool) -> list[tuple[int, int, int]]:
        """(slack, i, j) of the pairs that pass, for a few texts."""
        bits = [int.from_bytes(x, "little") for x in raw]
        out = []
        for i in range(1, len(bits)):
            for j in range(i):
                if label[i] == label[j] or (cross and tile[i] == tile[j]) or (refuted[i] is not None and node[j] in refuted[i]):
                    continue
                slack = bands.allowed(n[i] + n[j]) - (bits[i] ^ bits[j]).bit_count()
                if slack >= 0:
                    out.append((slack, i, j))
        return out

    def large(node, tile, n, label, raw, refuted, cross: bool) -> list[tuple[int, int, int]]:
        """The same for up to a pair of tiles."""
        wide = -(-len(raw[0]) // 8) * 8
        sketched = np.frombuffer(b"".join(x.ljust(wide, b"\0") for x in raw), "<u8").reshape(len(raw), -1)
        node, tile, n, label = (np.array(x) for x in (node, tile, n, label))
        out = []
        for i in range(1, len(raw)):
            apart = label[:i] != label[i]
            if cross:
                apart &= tile[:i] != tile[i]
            if refuted[i] is not None:
                apart &= ~np.isin(node[:i], refuted[i])
            at = np.flatnonzero(apart)
            slack = (bands.den - bands.num) * (n[at] + n[i]) // (bands.den + bands.num) - np.bitwise_count(sketched[at] ^ sketched[i]).sum(axis=1).astype(np.int64)
            ok = slack >= 0
            out += [(int(x), i, int(j)) for x, j in zip(slack[ok], at[ok], strict=True)]
        return out

    def group(node, tile, n, label, raw, refuted, fresh) -> list[tuple[int, int]]:
        """Closest pairs first, those that join two trees; all pairs of newly refuted texts."""
        cross = len(set(tile)) > 1
        passing = (small if len(node) <= 12 else large)(node, tile, n, label, raw, refuted, cross)
        root = {x: x for x in label}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out = []
        for _, i, j in sorted(passing, key=lambda p: (-p[0], p[1], p[2])):
            x, y = find(label[i]), find(label[j])
            if x != y or fresh[i] or fresh[j]:
                out.append((min(node[i], node[j]), max(node[i], node[j])))
                root[x] = y
        return out

    columns = ("node", "tile", "n", "label", "folded", "refuted", "fresh")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in columns]
        here = None
        for batch in batches:
            spot = np.stack([batch.column(c).to_numpy() for c in ("key", "lo", "hi")], axis=1)
            if not len(spot):
                continue
            rows = [batch.column(c).to_pylist() for c in columns]
            cuts = [0, *(np.flatnonzero((np.diff(spot, axis=0) != 0).any(axis=1)) + 1).tolist(), len(spot)]
            found: list[tuple[int, int]] = []
            if here is not None and tuple(spot[0]) != here:
                found += group(*held) if len(held[0]) > 1 else []
                held = [[] for _ in columns]
            for a, b in zip(cuts, cuts[1:], strict=False):
                part = [x[a:b] for x in rows]
                if held[0]:  # the group began in an earlier batch
                    part = [x + y for x, y in zip(held, part, strict=True)]
                    held = [[] for _ in columns]
                if b == len(spot):
                    held = part
                elif len(part[0]) > 1:
                    found += group(*part)
            here = tuple(spot[-1])
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})
        if len(held[0]) > 1:
            found = group(*held)
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return run


def leader_pairs(keys: DataFrame, reps: DataFrame, bands: Bands) -> DataFrame:
    """Pairs (a < b) of the leader and each other text of a key that more than ``TILE`` texts hold, if they pass."""
    sketched = _sketched(keys.where(F.col("held") > TILE), reps)
    leaders = sketched.where(F.col("node") == F.col("leader")).groupBy("key").agg(F.min("n").alias("n1"), F.min("folded").alias("folded1"))
    met = sketched.where(F.col("node") != F.col("leader")).join(leaders, "key").select("leader", "node", "n", "n1", "folded", "folded1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leader, node, n, n1, x, y = (batch.column(c).to_pylist() for c in ("leader", "node", "n", "n1", "folded", "folded1"))
            found = [(min(p), max(p)) for p, size, r, q in zip(zip(leader, node, strict=True), map(sum, zip(n, n1, strict=True)), x, y, strict=True) if bits_apart(r, q) <= bands.allowed(size)]
            yield pa.RecordBatch.from_pydict({"a": pa.array([p for p, _ in found], pa.int64()), "b": pa.array([q for _, q in found], pa.int64())})

    return met.mapInArrow(run, "a long, b long").distinct()


def _sketched(keys: DataFrame, reps: DataFrame) -> DataFrame:
    """Keys' rows with the size and the sketch of the key's band."""
    rows = keys.join(reps.select("node", "n", F.col("own").alias("_own"), F.col("next").alias("_next")), "node")
    return rows.select("key", "node", "leader", "held", "n", F.when(F.col("own"), F.col("_own")).otherwise(F.col("_next")).alias("folded"))


def tiled(keys: DataFrame, marks: DataFrame) -> DataFrame:
    """The texts of keys with the places (lo, hi) where they meet: pairs of tiles of about ``TILE`` texts.

    ``marks`` has node, label and fresh of every text.  Up to ``TILE`` texts
    that hold a key are one tile and need none of that.  Where more do, its
    leader has met them all and stays out, and the texts of its largest
    component (``most`` of ``held``) meet the tiles of the others alone.
    """
    few = keys.where(F.col("held") <= TILE).select("key", "node", "own", *(F.lit(0).alias(c) for c in ("tile", "lo", "hi")))
    rows = materialise(keys.where((F.col("held") > TILE) & (F.col("node") != F.col("leader"))).join(marks, "node"), "large")
    by_label = rows.groupBy("key", "label").agg(F.count("*").alias("n"))
    largest = by_label.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("giant"), F.max("n").alias("most"))
    rows = rows.join(largest, "key")
    inside = (F.col("label") == F.col("giant")) & (F.col("most") > TILE) & ~F.col("fresh")
    rest = F.when(F.col("most") > TILE, F.col("held") - F.col("most")).otherwise(F.col("held"))
    tiles, giants = (F.greatest(F.lit(1), F.ceil(c / TILE)).cast("int") for c in (rest, F.col("most")))
    at = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    # Places: (lo, hi) two tiles of the rest; (-1 - giant tile, tile) a tile of the giant and one of the rest.
    each = lambda n: F.sequence(F.lit(0), n - 1)
    own = F.transform(each(tiles), lambda x: F.struct(F.least(at(tiles), x).alias("lo"), F.greatest(at(tiles), x).alias("hi")))
    of_giant = F.transform(each(tiles), lambda x: F.struct((-1 - at(giants)).alias("lo"), x.alias("hi")))
    to_giant = F.transform(each(giants), lambda x: F.struct((-1 - x).alias("lo"), at(tiles).alias("hi")))
    places = F.when(inside, of_giant).when(F.col("most") > TILE, F.concat(own, to_giant)).otherwise(own)
    rows = rows.withColumn("tile", F.when(inside, -1).otherwise(at(tiles))).withColumn("_at", F.explode(places))
    return few.unionByName(rows.select("key", "node", "own", "tile", "_at.lo", "_at.hi"))


def tile_pairs(keys: DataFrame, reps: DataFrame, bands: Bands, labels: DataFrame | None = None, refuted: DataFrame | None = None) -> DataFrame:
    """Forest pairs (a < b) of the texts that meet in ``tiled``; sketches join them last."""
    known = reps.select("node", "n", F.col("own").alias("_own"), F.col("next").alias("_next"))
    # Components and refuted partners join the texts, not their many keys.
    if labels is None:
        known = known.withColumn("label", F.col("node"))
    else:
        known = known.join(labels.select(F.col("id").alias("node"), F.col("component").alias("label")), "node", "left").withColumn("label", F.coalesce("label", "node"))
    if refuted is None:
        known = known.withColumn("refuted", F.lit(None).cast("array<long>")).withColumn("fresh", F.lit(False))
    else:
        known = known.join(refuted.select("node", "refuted", "fresh"), "node", "left").withColumn("fresh", F.coalesce("fresh", F.lit(False)))
    if labels is not None or refuted is not None:
        known = materialise(known, "known")
    rows = tiled(keys, known.select("node", "label", "fresh")).join(known, "node").withColumn("folded", F.when(F.col("own"), F.col("_own")).otherwise(F.col("_next")))
    met = rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "node").select("key", "lo", "hi", "node", "tile", "n", "label", "folded", "refuted", "fresh")
    return met.mapInArrow(_forest(bands), "a long, b long").distinct()


def refuted_partners(tested: DataFrame, open_pairs: DataFrame) -> DataFrame:
    """(node, refuted, fresh): all refuted partners of every text that has any.

    Texts of ``open_pairs`` are fresh.  An old refuted pair has to stay out of
    a forest as well: its edge would stand in for an untested one.
    """
    both = lambda pairs: pairs.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("node"), F.col("a").alias("other")))
    partners = both(tested.where(~F.col("linked"))).groupBy("node").agg(F.collect_set("other").alias("refuted"))
    ends = both(open_pairs).select("node").distinct().withColumn("_new", F.lit(True))
    return partners.join(ends, "node", "left").select("node", "refuted", F.coalesce("_new", F.lit(False)).alias("fresh"))


def verify(pairs: DataFrame, reps: DataFrame, read, num: int, den: int) -> DataFrame:
    """(a, b, linked): the exact test on whole sets, which ``read`` supplies.

    Each pair's second set travels to the first; a text with very many pairs
    is met in several places.
    """
    asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct().join(reps.select("node", "digest", "low"), "node")
    sets = read(asked, lambda x: (x.tobytes(),), "elements binary")
    spread = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.ceil(F.count("*").over(Window.partitionBy("a")) / 4096)))
    places = spread.select(F.col("b").alias("node"), "a", "salt", F.lit(1).alias("role")).unionByName(spread.select(F.col("a").alias("node"), "a", "salt", F.lit(0).alias("role")).distinct())
    met = sets.join(places, "node").repartition("a", "salt").sortWithinPartitions("a", "salt", "role", "node").select("a", "role", "node", "elements")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, mine = None, None
        for batch in batches:
            a, b, linked = [], [], []
            for first, role, node, raw in zip(*(batch.column(c).to_pylist() for c in ("a", "role", "node", "elements")), strict=True):
                other = np.frombuffer(raw, np.uint64)
                if role == 0:
                    here, mine = first, other
                    continue
                if here != first:
                    raise RuntimeError("a set is missing")
                same = len(np.intersect1d(mine, other, assume_unique=True))
                a.append(first)
                b.append(node)
                linked.append(den * same >= num * (len(mine) + len(other) - same))
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "linked": pa.array(linked, pa.bool_())})

    return met.mapInArrow(compare, "a long, b long, linked boolean").distinct()


def joined(labels: DataFrame | None, pairs: DataFrame) -> DataFrame:
    """The components of ``labels``, if any, after the linked ones of ``pairs``: stars stand for the links so far."""
    clear_driver(pairs.sparkSession)
    links = pairs.where("linked").select("a", "b")
    return connected_components(links if labels is None else links.unionByName(labels.select(F.col("id").alias("a"), F.col("component").alias("b"))), "a", "b")


def count_open(pairs: DataFrame) -> tuple[int, int]:
    """How many of the tested pairs are linked and how many are refuted."""
    return tuple(pairs.agg(F.count_if("linked"), F.count_if(~F.col("linked"))).first())


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, ``keep``, n_shingles and component_id of every row of ``docs``.

    With ``keep`` there is also ``first``: whether the row's id and ``keep``
    are the least of its component (null for empty sets and null ids).
    """
    num, den = similarity
    bands = Bands(num, den)
    sets, reps, seed = distinct_sets(docs, id_col=id_col, text_col=text_col, shingle=shingle, keep=keep)
    keys = join_keys(docs, bands, text_col=text_col, shingle=shingle, seed=seed)
    read = lambda wanted, make, fields: read_sets(docs, wanted, make, fields, id_col=id_col, text_col=text_col, shingle=shingle, seed=seed)

    def sketches(x: np.ndarray) -> tuple[int, bytes, bytes | None]:
        band = bands.of(len(x))
        own, following = (fold_sketch(sketch(x, bands.blocks(band + k)[0])) if not k or bands.reaches(len(x)) else None for k in (0, 1))
        return len(x), own, following

    involved = reps.join(keys.select("node").distinct(), "node", "left_semi")
    sketched = materialise(read(involved, sketches, "n long, own binary, next binary"), "sketches")
    exact = lambda pairs: materialise(verify(pairs, reps, read, num, den), "verified")
    labels, led = None, None
    if keys.where(F.col("held") > TILE).limit(1).count():
        led = exact(materialise(leader_pairs(keys, sketched, bands), "led"))
        labels = joined(None, led)
    tested = exact(materialise(tile_pairs(keys, sketched, bands, labels), "forest"))
    open_pairs = tested.where(~F.col("linked"))
    labels, broken = joined(labels, tested), count_open(tested)[1]
    if led is not None:
        tested = materialise(tested.unionByName(led).distinct(), "verified")
    while broken:
        # A forest lost an edge: its keys look for other pairs between components.
        partners = refuted_partners(tested, open_pairs)
        again = materialise(broken_rows(keys, open_pairs, labels), "again")
        fresh = materialise(tile_pairs(again, sketched, bands, labels, partners).join(tested, ["a", "b"], "left_anti"), "forest")
        if not fresh.limit(1).count():
            break  # no key has an untested pair between components
        more = exact(fresh)
        found, broken = count_open(more)
        labels = joined(labels, more) if found else labels
        if broken:
            tested = materialise(tested.unionByName(more), "verified")
            open_pairs = more.where(~F.col("linked"))
    named = reps.join(labels.select(F.col("id").alias("node"), "component"), "node", "left").select("digest", "low", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("low").alias("least"))
    found = named.join(least, "component").select("digest", F.col("least"))
    out = sets.join(found, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col(id_col)).otherwise(F.col("least.id")).alias("component_id")
    named_by = F.struct(F.col(id_col).alias("id"), *keep) == F.col("least")
    first = [F.when(F.col("digest").isNotNull() & F.col(id_col).isNotNull(), named_by).alias("first")] if keep else []
    return out.select(id_col, *keep, "n_shingles", component, *first)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: three-word shingles at 0.9 over all documents."""
    small_batches(spark)
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
