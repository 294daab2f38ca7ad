"""Best-fit packing of token sequences by bin completion.

Texts become token ids once, in a narrow Arrow job, and leave as pieces
(document, piece number, start, length, checksum); only lengths matter from
then on.  Lengths are at most ``capacity``, so the count of pieces per length
is a table of bounded size however large the corpus is.  Bin completion
(Fukunaga & Korf, "Bin completion algorithms for multicontainer packing",
2007) plans on that table: it takes the largest length left, branches on the
undominated fillings around it, prunes by lower bounds against the incumbent,
best fit at first, and uses a filling as often as the counts allow.  The plan is
a list of (filling, times), whose size does not depend on the number of
documents.

Pieces then find their places in Spark without ordering a whole length in one
task: rows are numbered inside hash buckets of a length, bucket counts are
turned into offsets, and the global number of a piece within its length picks
its slot from the plan by a range lookup.

Defined results: null text counts as empty (one token, the end mark); very long
texts are encoded whole and cut into full pieces and a rest; pieces of equal
length are placed in the order of hash buckets, then id; repeated rows are
packed one by one; an empty table gives no pieces.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession, Window

from kindred.llm.arrowtext import slices, small_batches, texts
from kindred.storage import materialise

CAPACITY = 4096
END_ID = 1
STEPS = 20_000  # fillings and nodes of the search
BOUNDS = 8  # lower bounds a node is held against
STARTS = 32
BUCKET_ROWS = 1_000
CACHED_WORDS = 150_000
JOINED, ENCODED_RUNS = 64, 64  # words a call of the library gets as one text, texts of a call
MARK = "\x01"


class WordIds:
    """Token ids by the library, computed once per distinct word.

    The tokenizer's pre-tokens never span white space, so the ids of a text
    are those of its white-space separated words, one after another.  Words
    seen twice in a batch are remembered, up to ``CACHED_WORDS``.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        (self.mark,) = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.clear()

    def clear(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.flat, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their numbers, ``JOINED`` words a call with a one-token mark between them."""
        apart = pc.any(pc.match_substring(words, MARK)).as_py()
        ends = np.append(np.arange(0, len(words), 1 if apart else JOINED), len(words))
        runs = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words), pa.scalar(f" {MARK} ", pa.large_string())).to_pylist()
        flat, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for at in range(0, len(runs), ENCODED_RUNS):
            coded = [x.ids for x in self.tokenizer.encode_batch_fast(runs[at : at + ENCODED_RUNS], add_special_tokens=False)]
            if apart:
                flat.append(np.array(list(chain.from_iterable(coded)), np.uint32))
                sizes.append(np.array([len(x) for x in coded], np.int64))
                continue
            for x in coded:
                x.append(self.mark)  # every word has one behind it
            ids = np.array(list(chain.from_iterable(coded)), np.uint32)
            cuts = ids == self.mark
            sizes.append(np.diff(np.flatnonzero(cuts), prepend=-1) - 1)
            flat.append(ids[~cuts])
        return np.concatenate(flat), np.concatenate(sizes)

    def ids(self, values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a batch of texts and the offsets of each text's ids."""
        parts = pc.ascii_split_whitespace(values)
        coded = parts.flatten().dictionary_encode()
        index, listed = coded.indices.to_numpy(), coded.dictionary
        place = pc.fill_null(pc.index_in(listed, value_set=self.known), -1).to_numpy().astype(np.int64)
        fresh = np.flatnonzero(place < 0)
        words = listed.take(pa.array(fresh))
        flat, size = self._encode(words)
        place[fresh] = len(self.sizes) + np.arange(len(fresh))
        flat, size = np.concatenate((self.flat, flat)), np.concatenate((self.sizes, size))
        start = np.cumsum(size) - size
        word = place[index]
        many = size[word]
        ends = np.concatenate(([0], np.cumsum(many)))
        ids = flat[np.repeat(start[word] - ends[:-1], many) + np.arange(ends[-1])]
        self._remember(words, np.bincount(index, minlength=len(listed))[fresh] > 1, flat[len(self.flat) :], size[len(self.sizes) :])
        return ids, ends[parts.offsets.to_numpy()]

    def _remember(self, fresh: pa.Array, often: np.ndarray, flat: np.ndarray, size: np.ndarray) -> None:
        often &= np.cumsum(often) + len(self.known) <= CACHED_WORDS
        self.known = pa.concat_arrays([self.known, fresh.filter(pa.array(often))])
        self.flat = np.concatenate((self.flat, flat[np.repeat(often, size)]))
        self.sizes = np.concatenate((self.sizes, size[often]))


_CODERS: dict[str, WordIds] = {}


def coder(path: str) -> WordIds:
    """The cached coder of this worker process."""
    if path not in _CODERS:
        _CODERS[path] = WordIds(path)
    return _CODERS[path]


def pieces(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Cut each document's ids plus ``end_id`` into pieces of at most ``capacity``.

    ``with_ids`` adds the ids themselves as an array column.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = coder(tokenizer_path)
        for batch in batches:
            for part in slices(batch, text_col):
                ids, ends = words.ids(texts(part, text_col))
                rows, number, start, length, crc, kept = [], [], [], [], [], []
                for r in range(len(part)):
                    own = np.append(ids[ends[r] : ends[r + 1]], np.uint32(end_id)).astype("<u4")
                    for p, at in enumerate(range(0, len(own), capacity)):
                        piece = own[at : at + capacity]
                        rows.append(r)
                        number.append(p)
                        start.append(at)
                        length.append(len(piece))
                        crc.append(zlib.crc32(piece.tobytes()))
                        if with_ids:
                            kept.append(piece)
                made = {
                    id_col: part.column(id_col).take(pa.array(rows, pa.int64())),
                    "piece": pa.array(number, pa.int32()),
                    "start": pa.array(start, pa.int64()),
                    "length": pa.array(length, pa.int64()),
                    "ids_crc32": pa.array(crc, pa.int64()),
                }
                yield pa.RecordBatch.from_pydict(made | ({"ids": pa.array(kept, pa.list_(pa.int64()))} if with_ids else {}))

    used = docs.select(id_col, text_col)
    kind = used.schema[id_col].dataType.simpleString()
    return used.mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids)


Filling = tuple[tuple[int, int], ...]  # (length, pieces of it), longest first


def fillings(room: int, sizes: list[int], most: dict[int, int]) -> Iterator[tuple[int, Filling]]:
    """All undominated fillings of ``room``, lazily, with their sums: fullest first, of equal sums the one of longer pieces.

    ``sizes`` ascends, ``most`` tells how many pieces of each there are.  Bit t
    of ``reach[k]`` says that pieces of the first k sizes can sum to t, so no
    branch is a dead end.  A filling with room for another piece is dominated
    by the one that holds it and left out.
    """
    sizes = sizes[: bisect_right(sizes, room)]
    most = {s: most[s] for s in sizes}  # the caller's counts change before the next filling is asked for
    inside, reach = (1 << room + 1) - 1, [1]
    for s in sizes:
        sums, left, step = reach[-1], min(most[s], room // s), 1
        while left > 0:
            sums |= sums << s * min(step, left) & inside
            left, step = left - step, 2 * step
        reach.append(sums)
    open_sums = reach[-1]
    while open_sums:
        total = open_sums.bit_length() - 1
        open_sums ^= 1 << total
        # (number of sizes still to choose from, what they must sum to, what was chosen)
        branches: list[tuple[int, int, Filling]] = [(len(sizes), total, ())]
        while branches:
            k, rest, chosen = branches.pop()
            if not rest:
                used = dict(chosen)
                spare = next((s for s in sizes if most[s] > used.get(s, 0)), room + 1)
                if spare > room - total:
                    yield total, chosen
                continue
            k = bisect_right(sizes, rest, 0, k)
            s = sizes[k - 1]
            for n in range(min(most[s], rest // s) + 1):
                if reach[k - 1] >> rest - s * n & 1:
                    branches.append((k - 1, rest - s * n, (*chosen, (s, n)) if n else chosen))


def bins(plan: list[tuple[Filling, int]]) -> int:
    return sum(times for _, times in plan)


def _weights(s: int, capacity: int) -> list[int]:
    """What a piece counts for in each lower bound: its length, and dual feasible functions (Fekete & Schepers, 2001)."""
    return [s] + [s * k if (k + 1) * s % capacity == 0 else (k + 1) * s // capacity * capacity for k in range(1, BOUNDS)]


def _least(rest: list[int], capacity: int) -> int:
    """Bins that pieces of these summed weights need at least."""
    return max(-(-x // (max(k, 1) * capacity)) for k, x in enumerate(rest))


def _summed(pieces: Iterable[tuple[int, int]], capacity: int) -> list[int]:
    out = [0] * BOUNDS
    for s, n in pieces:
        for k, x in enumerate(_weights(s, capacity)):
            out[k] += n * x
    return out


def least_bins(counts: dict[int, int], capacity: int = CAPACITY) -> int:
    """A lower bound of the number of bins, the waste bound ceil(tokens / capacity) among others."""
    return _least(_summed(counts.items(), capacity), capacity)


class _Table:
    """Pieces left, by length."""

    def __init__(self, counts: dict[int, int]):
        self.left, self.sizes = dict(counts), sorted(counts)

    def use(self, filling: Filling, times: int) -> None:
        for s, n in filling:
            self.left[s] -= n * times
            if not self.left[s]:
                del self.left[s], self.sizes[bisect_left(self.sizes, s)]

    def give_back(self, filling: Filling, times: int) -> None:
        for s, n in filling:
            if s not in self.left:
                insort(self.sizes, s)
                self.left[s] = 0
            self.left[s] += n * times

    def times(self, filling: Filling) -> int:
        """How often a filling can be used."""
        return min(self.left[s] // n for s, n in filling)


def best_fit(counts: dict[int, int], capacity: int = CAPACITY, above: int = 0) -> list[tuple[Filling, int]]:
    """Each bin takes the longest piece that still fits, until none does; around pieces of at most ``above`` the fullest filling."""
    table, plan = _Table(counts), []
    while table.sizes:
        first = table.sizes[-1]
        filling = _longest(table, capacity) if first > above else next(_around(first, table, capacity))
        times = table.times(filling)
        table.use(filling, times)
        plan.append((filling, times))
    return plan


def _longest(table: _Table, capacity: int) -> Filling:
    filling, room, at = [], capacity, len(table.sizes)
    while at := bisect_right(table.sizes, room, 0, at):
        s = table.sizes[at - 1]
        filling.append((s, min(table.left[s], room // s)))
        room -= s * filling[-1][1]
        at -= 1
    return tuple(filling)


def _around(first: int, table: _Table, capacity: int) -> Iterator[Filling]:
    """The undominated fillings of a bin that holds a piece of length ``first``."""
    left = dict(table.left)
    left[first] -= 1
    for _, chosen in fillings(capacity - first, table.sizes if left[first] else table.sizes[:-1], left):
        whole = dict(chosen)
        whole[first] = whole.get(first, 0) + 1
        yield tuple(sorted(whole.items(), reverse=True))


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY, steps: int = STEPS) -> list[tuple[Filling, int]]:
    """Fillings and how often each is used; ``counts[n]`` pieces have length n.

    Branch and bound.  The first incumbent is the best of the best-fit plans,
    which differ in the length from which on they complete bins.  A node takes the
    longest piece left and branches on the undominated fillings around it, used
    as often as the counts allow or once; choices are undone and the next
    filling tried, and what cannot beat the incumbent by the lower bounds is
    pruned.  Passes allow 0, 1, 2, ... departures from the fullest filling on a
    path (limited discrepancy search, Harvey & Ginsberg, 1995).  The search ends
    with the best possible number when the incumbent meets the lower bound or a
    pass left nothing out, and with the incumbent after ``steps`` fillings and
    nodes.  More steps go on with the same search, so they never give more bins.
    """
    best, bound, sizes = best_fit(counts, capacity), least_bins(counts, capacity), sorted(counts)
    for k in range(STARTS if bins(best) > bound else 0):
        best = min(best, best_fit(counts, capacity, sizes[-1 - len(sizes) * k // STARTS]), key=bins)
        if bins(best) <= bound:
            break
    fewest = bins(best)
    table, rest, taken = _Table(counts), _summed(counts.items(), capacity), 0

    def options() -> Iterator[tuple[Filling, int]]:
        nonlocal taken
        for filling in _around(table.sizes[-1], table, capacity):
            taken += 1
            times = table.times(filling)  # nodes below have given back what they used
            yield filling, times
            if times > 1:
                yield filling, 1

    departures, cut = 0, fewest > bound
    while cut and fewest > bound and taken < steps:
        cut = False
        path: list[tuple[Filling, int, list[int]]] = []
        nodes = [(enumerate(options()), 0)]
        made = 0
        while nodes and taken < steps and fewest > bound:
            choices, departed = nodes[-1]
            for k, (filling, times) in choices:
                if departed + k > departures:
                    cut = True
                    break
                after = [x - times * y for x, y in zip(rest, _summed(filling, capacity), strict=True)]
                if made + times + _least(after, capacity) >= fewest:
                    continue
                path.append((filling, times, rest))
                table.use(filling, times)
                rest, made = after, made + times
                if table.sizes:
                    taken += 1
                    nodes.append((enumerate(options()), departed + k))
                else:
                    best, fewest = [(f, n) for f, n, _ in path], made
                    nodes.append((iter(()), 0))
                break
            if nodes[-1][0] is choices:  # nothing left to try here
                nodes.pop()
                if path:
                    filling, times, rest = path.pop()
                    table.give_back(filling, times)
                    made -= times
        table, rest = _Table(counts), _summed(counts.items(), capacity)
        departures += 1
    return best


def _slots(plan: list[tuple[Filling, int]]) -> dict[str, np.ndarray]:
    """The plan as ranges, sorted by (length, low).

    Number n of a length, low <= n, lies in sequence + (n - low) // per, at
    offset + length * ((n - low) % per).
    """
    rows, taken, sequence = [], {}, 0
    for filling, times in plan:
        offset = 0
        for s, per in filling:
            low = taken.get(s, 0)
            taken[s] = low + times * per
            rows.append((s, low, per, sequence, offset))
            offset += s * per
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "low", "per", "sequence", "offset"), table.T, strict=True))


def pack(cut: DataFrame, *, capacity: int = CAPACITY, id_col: str = "doc_id", steps: int = STEPS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Add sequence_id and offset to the stored pieces of ``pieces``.

    ``cut`` is read twice, so it must be a stored table.  ``steps`` bounds the search of ``plan_bins``.  The plan that is
    broadcast has at most a few rows per length, whatever the row count.
    """
    spark = cut.sparkSession
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    plan = spark.sparkContext.broadcast(_slots(plan_bins(counts, capacity, steps)))
    # A bucket holds about ``bucket_rows`` pieces, so each length has as many as its pieces ask for.
    # An Arrow table, as rows would start Python workers that stay beside those of the operators.
    dealt = pa.table({"length": pa.array(list(counts), pa.int64()), "_buckets": pa.array([-(-n // bucket_rows) for n in counts.values()], pa.int64())})
    buckets = F.broadcast(spark.createDataFrame(dealt))  # at most ``capacity`` rows
    spread = cut.join(buckets, "length").withColumn("_bucket", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), "_buckets")).drop("_buckets")
    sizes = spread.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy("length", "_bucket").orderBy(F.col(id_col), "piece", "ids_crc32")
    numbered = spread.withColumn("_row", F.row_number().over(inside)).join(shift, ["length", "_bucket"]).withColumn("_number", F.col("_shift") + F.col("_row") - 1).drop("_bucket", "_row", "_shift")
    columns = cut.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = plan.value
        key = slots["length"] << 40 | slots["low"]
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "_number"))
            at = np.searchsorted(key, length << 40 | number, side="right") - 1
            inside = number - slots["low"][at]
            per = slots["per"][at]
            made = {
                "sequence_id": pa.array(slots["sequence"][at] + inside // per),
                "offset": pa.array(slots["offset"][at] + length * (inside % per)),
            }
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in columns} | made)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    return numbered.select(*columns, "_number").mapInArrow(run, f"{kept}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents with their places."""
    cut = materialise(pieces(docs, tokenizer_path, id_col=id_col, text_col=text_col, capacity=capacity, end_id=end_id), "pieces")
    return pack(cut, capacity=capacity, id_col=id_col)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: word_bpe_49k pieces of all documents in sequences of 4096."""
    import public_tokenizers

    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
