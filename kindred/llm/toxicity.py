"""Toxicity: FTRL-proximal logistic regression over hashed word features.

A text's features are its distinct words, their stems (first 4, 5 and 6 code
points), neighbouring pairs and pairs with one word between, hashed into
``2 ** HASH_BITS`` coordinates.  FTRL-proximal
(McMahan et al., "Ad click prediction: a view from the trenches", 2013) keeps
a learning rate per coordinate and its L1 term leaves most weights at zero.

At most ``max_labelled`` labelled rows with at most ``max_features``
coordinates together, chosen by hash, fit the model: these bounds are the only
sample in the operator.  Their features are extracted in parallel and stored,
two bytes a coordinate; the fit itself, which is sequential by nature, is one
task whose input has those bounds.  The weights fit in ``2 ** HASH_BITS`` numbers, most of
them zero, so their broadcast is bounded too; scoring is one narrow pass over
whole texts.

Defined results: null or empty texts have no features and score the model's
base rate; labels that are null or have no document are ignored; without any
usable label all scores are 0; repeated rows each give a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from kindred.llm.arrowtext import PLAIN, give_back, hash_strings, mix, slices, small_batches, texts, translate, words
from kindred.storage import discard, materialise

HASH_BITS = 20
STEMS = (4, 5, 6)
MAX_LABELLED = 16_000
MAX_FEATURES = 80_000_000
EPOCHS = 4
MIN_EXAMPLES = 5
POSITIVE_WEIGHT = 4.0
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 1.0
CUT = 0.7


def features(values: pa.Array, weights: np.ndarray | None = None) -> np.ndarray:
    """Every word, stem, pair and skip pair as text number * 2 ** HASH_BITS + coordinate, unsorted and repeated.

    With ``weights``, those whose weight is zero are left out.
    """
    index, listed, ends = words(translate(values, PLAIN))
    owner = np.repeat(np.arange(len(values), dtype=np.int32), np.diff(ends))
    coordinate = lambda h: (h >> np.uint64(64 - HASH_BITS)).astype(np.int32)
    parts: list[np.ndarray] = []

    def add(rows: np.ndarray, at: np.ndarray) -> None:
        if weights is not None:
            hit = weights[at] != 0
            rows, at = rows[hit], at[hit]
        parts.append(rows.astype(np.int64) << HASH_BITS | at)

    coded = hash_strings(listed)
    add(owner, coordinate(mix(coded))[index])
    length = np.asarray(pc.utf8_length(listed))
    for size in STEMS:
        stem = coordinate(mix(hash_strings(pc.utf8_slice_codeunits(listed, 0, size)) + np.uint64(size)))
        longer = (length > size)[index]
        add(owner[longer], stem[index[longer]])
    h = coded[index]
    for gap, seed in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        same = owner[gap:] == owner[:-gap]
        add(owner[gap:][same], coordinate(mix(h[:-gap] * np.uint64(seed) + h[gap:])[same]))
    return np.concatenate(parts)


class Coordinates:
    """A sorted set of coordinates in two bytes each: low halves, and how many each high half has."""

    def __init__(self, at: np.ndarray):
        self.low = (at & 0xFFFF).astype("<u2")
        self.high = np.bincount(at >> 16, minlength=1 << (HASH_BITS - 16)).astype("<i4")

    @classmethod
    def read(cls, raw: bytes) -> Coordinates:
        out = cls.__new__(cls)
        wide = 4 << (HASH_BITS - 16)
        out.high, out.low = np.frombuffer(raw[:wide], "<i4"), np.frombuffer(raw[wide:], "<u2")
        return out

    def raw(self) -> bytes:
        return self.high.tobytes() + self.low.tobytes()

    def array(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.high), dtype=np.int32) << 16, self.high) + self.low


def fit(examples: list[Coordinates], labels: np.ndarray, *, min_examples: int = MIN_EXAMPLES, positive_weight: float = POSITIVE_WEIGHT, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> tuple[np.ndarray, float]:
    """FTRL-proximal over examples, which are thinned in place: (weights, intercept)."""
    z, n = np.zeros(1 << HASH_BITS), np.zeros(1 << HASH_BITS)
    z0 = n0 = w0 = 0.0
    seen = np.zeros(1 << HASH_BITS, np.int64)
    for x in examples:
        seen[x.array()] += 1
    for i, x in enumerate(examples):
        at = x.array()
        examples[i] = Coordinates(at[seen[at] >= min_examples])

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(examples)):
            at = examples[i].array()
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            g = (1 / (1 + np.exp(-np.clip(w.sum() + w0, -30, 30))) - labels[i]) * (positive_weight if labels[i] else 1.0)
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[at] = ni + g * g
            z0 += g - (np.sqrt(n0 + g * g) - np.sqrt(n0)) / alpha * w0
            n0 += g * g
            w0 = -z0 / ((beta + np.sqrt(n0)) / alpha)
    return weights(z, n), w0


def distinct(values: pa.Array) -> list[np.ndarray]:
    """Each text's distinct coordinates."""
    key = np.unique(features(values))
    cuts = np.searchsorted(key >> HASH_BITS, np.arange(len(values) + 1))
    return [(key[a:b] & ((1 << HASH_BITS) - 1)).astype("<i4") for a, b in zip(cuts, cuts[1:], strict=False)]


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", 1 << 20):
            found = distinct(texts(part))
            yield pa.RecordBatch.from_pydict({"id": part.column("id"), "label": part.column("label"), "n": pa.array([len(x) for x in found], pa.int64()), "at": pa.array([Coordinates(x).raw() for x in found], pa.binary())})


def _fit_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted((r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("id", "label", "at")), strict=True)), reverse=True)
    examples, labels = [], []
    while rows:  # in the order of ids; each row's bytes go as it is read
        _, y, raw = rows.pop()
        examples.append(Coordinates.read(raw))
        labels.append(float(y))
    if examples:
        w, intercept = fit(examples, np.array(labels))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.append(at, -1).astype(np.int32)), "weight": pa.array(np.append(w[at], intercept))})
    del examples
    give_back()


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED, max_features: int = MAX_FEATURES) -> tuple[np.ndarray, float]:
    """Weights and intercept from the labelled documents."""
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    chosen = lambda share: F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(7)), F.lit(1 << 30)) < int((1 << 30) * share)
    known = usable.count()
    if known > max_labelled:
        usable = usable.where(chosen(max_labelled / known))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(usable, "id")
    kind = rows.schema["id"].dataType.simpleString()
    found = materialise(rows.select("id", "label", "text").mapInArrow(_extract, f"id {kind}, label int, n long, at binary"), "features")
    total = found.agg(F.sum("n")).first()[0] or 0
    kept = found.where(chosen(min(1, max_labelled / max(1, known)) * max_features / total)) if total > max_features else found
    model = kept.select("id", "label", "at").repartition(1).mapInArrow(_fit_all, "at int, weight double").toPandas()  # at most 2 ** HASH_BITS rows
    discard(found)
    weights = np.zeros(1 << HASH_BITS, np.float32)
    weights[model["at"][:-1]] = model["weight"][:-1]
    return weights, float(model["weight"].iloc[-1]) if len(model) else -np.inf


def score(docs: DataFrame, weights: np.ndarray, intercept: float, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and the probability of label 1 for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    columns = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            for part in slices(batch, text_col, 1 << 20):
                key = np.unique(features(texts(part, text_col), w))
                total = np.bincount(key >> HASH_BITS, w[key & ((1 << HASH_BITS) - 1)], minlength=len(part)) + intercept
                yield pa.RecordBatch.from_pydict({c: part.column(c) for c in columns} | {"score": pa.array(np.where(np.isneginf(total), 0.0, 1 / (1 + np.exp(-np.clip(total, -700, 700)))))})

    used = docs.select(*dict.fromkeys((*columns, text_col)))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)
    return used.mapInArrow(run, f"{kept}, score double")


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: fitted on rows outside fold 1 of 3, scoring all documents."""
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold("doc_id", 3) != 1)
    scored = score(docs, *train(docs, labels))
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
