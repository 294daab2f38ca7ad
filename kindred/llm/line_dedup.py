"""Line deduplication with two Bloom filters.

First pass: every task hashes the distinct line keys of its documents and
fills two blocked Bloom filters, one for hashes seen once and one for hashes
seen at least twice.  The tasks' filters merge segment by segment in Spark;
what two tasks have both seen once moves into the twice filter.  A filter has
no false negatives, so every key of two documents or more is in the twice
filter, whose size is a fixed parameter (and so is the broadcast).

Second pass: only lines in the twice filter, the suspected repeats, leave
their document as (digest, id).  The exact count of documents per digest
(SHA-256 of the key) confirms them and picks the document that keeps the line.

Third pass: documents drop their confirmed lines.  Up to ``broadcast_keys``
confirmed keys are broadcast and the pass is narrow; beyond that, the drops
are joined to the documents.

A filter too full for the corpus passes more suspects; results do not change.

Defined results: null text is one empty line; a line's key is stripped of
ASCII white space and its A-Z lower-cased; keys below ``min_chars`` code
points are never dropped; repeated rows with one id count as one document and
all keep the line if theirs is the largest id; rows with a null id do not
count as documents and lose confirmed lines.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.functions as F
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession

from kindred.llm.arrowtext import hash_strings, slices, small_batches, texts
from kindred.storage import materialise

MIN_CHARS = 20
MIN_DOCS = 3
FILTER_WORDS = 1 << 21  # 64-bit blocks of a filter: 16 MB
SEGMENT_WORDS = 1 << 13
BROADCAST_KEYS = 300_000
PARTIAL = "segment int, salt int, place binary, once binary, twice binary"


class Lines:
    """The lines of a batch of texts: their texts, owners, keys and key hashes."""

    def __init__(self, values: pa.Array, min_chars: int):
        parts = pc.split_pattern(values, "\n")
        self.ends = parts.offsets.to_numpy()
        self.lines = parts.flatten()
        self.keys = pc.ascii_lower(pc.ascii_trim_whitespace(self.lines))
        self.owner = np.repeat(np.arange(len(values)), np.diff(self.ends))
        self.long = np.flatnonzero(np.asarray(pc.utf8_length(self.keys)) >= min_chars)
        self.hashes = hash_strings(self.keys.take(pa.array(self.long)))

    def suspects(self, twice: np.ndarray) -> np.ndarray:
        """Numbers of the lines whose key may be in two documents."""
        at, bits = places(self.hashes, len(twice))
        return self.long[(twice[at] & bits) == bits]

    def digests(self, which: np.ndarray) -> list[bytes]:
        return [hashlib.sha256(k).digest() for k in self.keys.take(pa.array(which)).cast(pa.large_binary()).to_pylist()]


def places(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each hash and its three bits in there."""
    one, low = np.uint64(1), np.uint64(63)
    bits = one << (h & low) | one << (h >> np.uint64(6) & low) | one << (h >> np.uint64(12) & low)
    return ((h >> np.uint64(18)) % np.uint64(size)).astype(np.int64), bits


class Filters:
    """A pair of filters over ``size`` blocks: hashes seen once and twice."""

    def __init__(self, size: int):
        self.once, self.twice = np.zeros(size, np.uint64), np.zeros(size, np.uint64)

    def add(self, hashes: np.ndarray) -> None:
        """Hashes of distinct (document, key) pairs."""
        h, n = np.unique(hashes, return_counts=True)
        at, bits = places(h, len(self.once))
        again = (n > 1) | ((self.once[at] & bits) == bits)
        np.bitwise_or.at(self.twice, at[again], bits[again])
        np.bitwise_or.at(self.once, at, bits)

    def merge(self, at: np.ndarray, once: np.ndarray, twice: np.ndarray) -> None:
        """Another pair's non-empty blocks."""
        self.twice[at] |= twice | (self.once[at] & once)
        self.once[at] |= once

    def rows(self, salt: int) -> pa.RecordBatch:
        """Non-empty blocks by segment, as ``PARTIAL`` rows."""
        at = np.flatnonzero(self.once)
        cuts = np.searchsorted(at, np.arange(0, len(self.once) + SEGMENT_WORDS, SEGMENT_WORDS))
        parts = [(k, at[a:b]) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
        return pa.RecordBatch.from_pydict(
            {
                "segment": pa.array([k for k, _ in parts], pa.int32()),
                "salt": pa.array([salt] * len(parts), pa.int32()),
                "place": pa.array([p.astype("<i4").tobytes() for _, p in parts], pa.binary()),
                "once": pa.array([self.once[p].tobytes() for _, p in parts], pa.binary()),
                "twice": pa.array([self.twice[p].tobytes() for _, p in parts], pa.binary()),
            }
        )


def twice_filter(docs: DataFrame, text_col: str = "text", min_chars: int = MIN_CHARS, size: int = FILTER_WORDS) -> np.ndarray:
    """The blocks of the twice filter over all documents' line keys."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pair = Filters(size)
        for batch in batches:
            for part in slices(batch, text_col):
                found = Lines(texts(part, text_col), min_chars)
                own = np.unique(np.stack((found.owner[found.long].astype(np.uint64), found.hashes)), axis=1)[1] if len(found.long) else found.hashes
                pair.add(own)
        yield pair.rows(TaskContext.get().partitionId() % 64)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = None
        for batch in batches:
            pair = pair or Filters(size)
            for place, once, twice in zip(*(batch.column(c).to_pylist() for c in ("place", "once", "twice")), strict=True):
                pair.merge(np.frombuffer(place, "<i4"), np.frombuffer(once, np.uint64), np.frombuffer(twice, np.uint64))
        if pair:
            yield pair.rows(0)

    partial = docs.select(text_col).mapInArrow(fill, PARTIAL)
    merged = partial.repartition("segment", "salt").mapInArrow(merge, PARTIAL).repartition("segment").mapInArrow(merge, PARTIAL)
    out = np.zeros(size, np.uint64)
    for row in merged.select("place", "twice").collect():  # at most the filter's size
        out[np.frombuffer(row["place"], "<i4")] = np.frombuffer(row["twice"], np.uint64)
    return out


def confirmed_lines(docs: DataFrame, shared: Broadcast, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """(confirmed digests with the id that keeps them, suspects as (digest, id)); ``shared`` is the broadcast twice filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                found = Lines(texts(part, text_col), min_chars)
                which = found.suspects(shared.value)
                pairs = dict.fromkeys(zip(found.owner[which].tolist(), found.digests(which), strict=True))
                rows = pa.array([r for r, _ in pairs], pa.int64())
                yield pa.RecordBatch.from_pydict({"digest": pa.array([d for _, d in pairs], pa.binary()), id_col: part.column(id_col).take(rows)})

    used = docs.select(id_col, text_col)
    suspects = used.mapInArrow(run, f"digest binary, `{id_col}` {used.schema[id_col].dataType.simpleString()}")
    confirmed = suspects.groupBy("digest").agg(F.count_distinct(id_col).alias("n_docs"), F.max(id_col).alias("keeper")).where(F.col("n_docs") >= min_docs)
    return confirmed.select("digest", "keeper"), suspects


RESULT = "n_lines long, n_dropped long, kept_sha256 string, kept_text string"


def _cleaner(shared, confirmed, *, id_col: str, text_col: str, keep: list[str], min_chars: int):
    """The third pass; ``confirmed`` is a broadcast {digest: keeper} or None for column ``_drops``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                values = texts(part, text_col)
                found = Lines(values, min_chars)
                which = found.suspects(shared.value)
                ids = part.column(id_col).to_pylist()
                gone = np.zeros(len(found.lines), bool)
                digests = found.digests(which)
                if confirmed is not None:
                    keeper = confirmed.value
                    for line, digest in zip(which.tolist(), digests, strict=True):
                        gone[line] = digest in keeper and keeper[digest] != ids[found.owner[line]]
                else:
                    drops = [set(x or ()) for x in part.column("_drops").to_pylist()]
                    for line, digest in zip(which.tolist(), digests, strict=True):
                        gone[line] = digest in drops[found.owner[line]]
                total = np.concatenate(([0], np.cumsum(gone)))
                dropped = total[found.ends[1:]] - total[found.ends[:-1]]
                kept = values.to_pylist()
                for i in np.flatnonzero(dropped):
                    a, b = found.ends[i], found.ends[i + 1]
                    kept[i] = "\n".join(found.lines.slice(a, b - a).filter(pa.array(~gone[a:b])).to_pylist())
                made = {
                    "n_lines": pa.array(np.diff(found.ends).astype(np.int64)),
                    "n_dropped": pa.array(dropped.astype(np.int64)),
                    "kept_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in kept], pa.string()),
                    "kept_text": pa.array(kept, pa.string()),
                }
                yield pa.RecordBatch.from_pydict({c: part.column(c) for c in keep} | made)

    return run


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, filter_words: int = FILTER_WORDS, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """One row per document row: its id, ``keep`` columns, counts and the kept text."""
    spark = docs.sparkSession
    columns = list(dict.fromkeys((id_col, *keep)))
    shared = spark.sparkContext.broadcast(twice_filter(docs, text_col, min_chars, filter_words))
    confirmed, suspects = confirmed_lines(docs, shared, id_col=id_col, text_col=text_col, min_chars=min_chars, min_docs=min_docs)
    confirmed = materialise(confirmed, "lines")
    used = docs.select(*dict.fromkeys((*columns, text_col)))
    few = None
    if confirmed.count() <= broadcast_keys:
        few = spark.sparkContext.broadcast({bytes(r["digest"]): r["keeper"] for r in confirmed.collect()})
    else:
        lost = suspects.join(confirmed, "digest").where(~F.col(id_col).eqNullSafe(F.col("keeper")))
        drops = lost.groupBy(F.col(id_col).alias("_id")).agg(F.collect_set("digest").alias("_drops"))
        used = used.join(drops, F.col(id_col).eqNullSafe(F.col("_id")), "left").drop("_id")
    run = _cleaner(shared, few, id_col=id_col, text_col=text_col, keep=columns, min_chars=min_chars)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)
    return used.mapInArrow(run, f"{kept}, {RESULT}")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: keys of 20 code points or more in three documents or more."""
    small_batches(spark)
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


OP2_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS n, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), split AS (
  SELECT n, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM docs
), keyed AS (
  SELECT n, doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM split
), repeated AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.*, r.key IS NOT NULL AND k.doc_id IS DISTINCT FROM r.keeper AS gone FROM keyed k LEFT JOIN repeated r ON k.key = r.key
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY n
"""
