"""Benchmark decontamination with one Aho-Corasick automaton.

Items (test questions and answers) are normalised to words; every window of
``window`` consecutive words becomes a pattern of one automaton.  Each text is
normalised the same way and scanned once; matches are mapped back to words and
to character offsets of the original text.

Windows are gathered and measured in Spark.  Up to ``max_patterns_bytes`` they
travel to the executors as one broadcast and the scan is one narrow pass.
Beyond that they are dealt by hash into parts of about half that size; each
part is one automaton and one pass over the stored texts, whose few matches
are written before the next part is fetched, and a last pass puts the matches
of a text together.  So the driver and a worker hold one part at a time,
nothing is dropped and both ways give the same rows.

Defined results: null or empty texts have no words and no hits; items without
words have no window; items with a null id are ignored; repeated items count
once; repeated document rows each give a row; extra columns are not touched.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from kindred.llm.arrowtext import slices, small_batches
from kindred.storage import materialise

WINDOW = 10
MAX_PATTERNS_BYTES = 32 << 20


def _table() -> bytes:
    """Byte map: A-Z lower-cased, all ASCII but letters and digits to spaces; other bytes stay."""
    word = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
    low = [c + 32 if 0x41 <= c <= 0x5A else c for c in range(256)]
    return bytes(c if c in word else 0x20 for c in low)


_NORMAL = _table()


def item_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_NORMAL).split()


def windows(text: str | None, size: int) -> set[bytes]:
    """The windows of an item as space-joined words."""
    found = item_words(text)
    return {b" ".join(found[i : i + size]) for i in range(max(1, len(found) - size + 1))} if found else set()


def _automaton(patterns: dict[bytes, tuple[str, ...]]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for text, ids in patterns.items():
        out.add_word(f" {text.decode('latin-1')} ", (text.count(b" ") + 1, ids))
    out.make_automaton()
    return out


_BUILT: OrderedDict = OrderedDict()


def _cached(key: str, patterns) -> ahocorasick.Automaton:
    """The last automaton built in this worker process; one at a time."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = _automaton(patterns.value)
    return _BUILT[key]


class Scan:
    """One normalised text: its words, which of them are hit and by which items."""

    def __init__(self, text: str | None):
        self.raw = (text or "").encode()
        plain = self.raw.translate(_NORMAL)
        found = plain.split()
        self.n_words = len(found)
        self.plain = plain
        self.joined = b" " + b" ".join(found) + b" "
        self.items: set[str] = set()
        self.spans: list[tuple[int, int]] = []

    def run(self, automaton: ahocorasick.Automaton) -> None:
        if not self.n_words or not len(automaton):
            return
        place = None
        for end, (size, ids) in automaton.iter(self.joined.decode("latin-1")):
            if place is None:
                place = np.cumsum(np.frombuffer(self.joined, np.uint8) == 0x20)
            last = int(place[end]) - 1
            self.spans.append((last - size, last))
            self.items.update(ids)

    def hit(self) -> np.ndarray:
        """A flag for each word."""
        edge = np.zeros(self.n_words + 1, np.int64)
        for a, b in self.spans:
            edge[a] += 1
            edge[b] -= 1
        return np.cumsum(edge[:-1]) > 0

    def original_spans(self) -> list[list[int]]:
        """Maximal hit stretches as [start, end) in characters of the original text."""
        hit = self.hit()
        if not hit.any():
            return []
        space = np.frombuffer(b" " + self.plain + b" ", np.uint8) == 0x20
        starts = np.flatnonzero(space[:-1] & ~space[1:])
        ends = np.flatnonzero(~space[:-1] & space[1:])
        raw = np.frombuffer(self.raw, np.uint8)
        chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
        edge = np.diff(np.concatenate(([False], hit, [False])).astype(np.int8))
        return [[int(chars[starts[a]]), int(chars[ends[b - 1]])] for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]


def window_table(items: DataFrame, *, item_id: str, item_text: str, size: int) -> DataFrame:
    """(window, ids, cost): every window once, with its items' ids and its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(*(batch.column(c).to_pylist() for c in ("name", "text")), strict=True):
                found = list(windows(text, size))
                yield pa.RecordBatch.from_pydict({"window": pa.array(found, pa.binary()), "name": pa.array([name] * len(found), pa.string())})

    named = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("string").alias("name"), F.col(item_text).alias("text"))
    grouped = named.mapInArrow(run, "window binary, name string").groupBy("window").agg(F.sort_array(F.collect_set("name")).alias("ids"))
    return grouped.withColumn("cost", F.length("window") + F.lit(16) * F.size("ids"))


def _patterns(table: DataFrame) -> dict[bytes, tuple[str, ...]]:
    return {bytes(r["window"]): tuple(r["ids"]) for r in table.select("window", "ids").toLocalIterator()}


RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hit_spans array<array<int>>, items array<string>"


def _result(rows: list[Scan]) -> dict[str, pa.Array]:
    """The ``RESULT`` columns of scanned texts."""
    hits = [int(r.hit().sum()) if r.spans else 0 for r in rows]
    named = [sorted(r.items) for r in rows]
    return {
        "n_words": pa.array([r.n_words for r in rows], pa.int64()),
        "n_hit": pa.array(hits, pa.int64()),
        "n_items": pa.array([len(x) for x in named], pa.int64()),
        "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in named], pa.string()),
        "contaminated": pa.array([h > 0 for h in hits], pa.bool_()),
        "hit_spans": pa.array([r.original_spans() for r in rows], pa.list_(pa.list_(pa.int32()))),
        "items": pa.array(named, pa.list_(pa.string())),
    }


def _matches(docs: DataFrame, part: DataFrame, text_col: str) -> DataFrame:
    """(_row, spans, items) of the texts that hold windows of one part, stored."""
    key, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(_patterns(part))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, text_col):
                found = []
                for at, text in zip(some.column("_row").to_pylist(), some.column(text_col).to_pylist(), strict=True):
                    one = Scan(text)
                    one.run(_cached(key, shared))
                    if one.spans:
                        found.append((at, [list(x) for x in one.spans], sorted(one.items)))
                yield pa.RecordBatch.from_pydict({"_row": pa.array([x for x, _, _ in found], pa.int64()), "spans": pa.array([x for _, x, _ in found], pa.list_(pa.list_(pa.int64()))), "items": pa.array([x for _, _, x in found], pa.list_(pa.string()))})

    out = materialise(docs.select("_row", text_col).mapInArrow(run, "_row long, spans array<array<long>>, items array<string>"), "matches")
    shared.destroy()
    return out


def scan(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, max_patterns_bytes: int = MAX_PATTERNS_BYTES, keep: tuple[str, ...] = ()) -> DataFrame:
    """Scan every text for the items' windows; a row per document row.

    ``keep`` names further columns of ``docs`` to hand through.
    """
    columns = list(dict.fromkeys((id_col, *keep)))
    used = docs.select(*dict.fromkeys((*columns, text_col)))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in used.select(*columns).schema)
    listed = materialise(window_table(items, item_id=item_id, item_text=item_text, size=window), "windows")
    total = listed.agg(F.sum("cost")).first()[0] or 0
    if total <= max_patterns_bytes:
        key, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(_patterns(listed))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for some in slices(batch, text_col):
                    rows = [Scan(x) for x in some.column(text_col).to_pylist()]
                    for row in rows:
                        row.run(_cached(key, shared))
                    yield pa.RecordBatch.from_pydict({c: some.column(c) for c in columns} | _result(rows))

        return used.mapInArrow(run, f"{kept}, {RESULT}")

    parts = -(-2 * total // max_patterns_bytes)
    numbered = materialise(used.withColumn("_row", F.monotonically_increasing_id()), "texts")
    dealt = listed.withColumn("part", F.pmod(F.xxhash64("window"), F.lit(parts)))
    found = [_matches(numbered, dealt.where(F.col("part") == k), text_col) for k in range(parts)]
    every = reduce(DataFrame.unionByName, found)
    by_row = every.groupBy("_row").agg(F.flatten(F.collect_list("spans")).alias("_spans"), F.flatten(F.collect_list("items")).alias("_items"))
    joined = numbered.join(by_row, "_row", "left").drop("_row")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, text_col):
                rows = [Scan(x) for x in some.column(text_col).to_pylist()]
                for row, spans, names in zip(rows, some.column("_spans").to_pylist(), some.column("_items").to_pylist(), strict=True):
                    row.spans, row.items = [tuple(x) for x in spans or ()], set(names or ())
                yield pa.RecordBatch.from_pydict({c: some.column(c) for c in columns} | _result(rows))

    return joined.mapInArrow(finish, f"{kept}, {RESULT}")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: 10-word windows of all benchmark items over all documents."""
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return scan(docs, items).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans")


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents without any hit, with their own columns."""
    columns = docs.columns
    marked = scan(docs, items, keep=tuple(columns), **options)
    return marked.where(~F.col("contaminated")).select(*columns)
