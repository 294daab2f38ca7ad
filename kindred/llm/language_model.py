"""Language-model scoring by deleted interpolation.

P(w | h) = a2 * c(h w) / c(h) + a1 * c(w) / N + a0 / (V + 1)

The maximum-likelihood estimates come from the counts of all words and all
word pairs of the training corpus, whatever their number.  The mixture weights
depend on the bucket of c(h) (a power of two) and are learned by
expectation-maximisation (Jelinek & Mercer, 1980) on held-out counts: one part
of the training documents, marked ``deleted``, is taken out of the counts and
predicted by the rest.  Only the ratios between the estimates matter to the
EM, so Spark sums the held-out pairs into a table of (bucket, ratio, ratio)
cells on a log scale, whose size is bounded, and the driver iterates on that.
All training documents then supply the final counts.

Words and pairs are hashed to 64 bits.  A token is a context once for each time
it is a word (the end token stands before each text), so contexts need no
counts of their own.  Counting is one pre-aggregated shuffle for words and one
for pairs.  Of the pairs only those are stored that somebody can ask for: seen
twice or more in training, or once there and again in a text to be scored only.
A pair of a training text that is not stored occurs once, so no count is lost.

Scoring reads the texts with broadcast tables of bounded size: the ``frequent``
most frequent words, the ``max_pairs`` most frequent pairs, and Bloom filters.
One holds the other pairs seen twice or more; a pair of a training text that is
in neither occurs once.  The counts of the other words are spelt in a filter of
their binary digits (``Spelt``).  A filter may add digits, so every counted
word is read back through it, and those that come out wrong go into a second
filter, the doubts: a word of a training text that is not in doubt has the
count it spells.  What is left, words in doubt and unlisted words of texts
to be scored only, gets its counts by joins with the whole tables, as do the
repeated pairs that are not listed; they leave their text as (row, pair).  The
bounds decide which way a count is fetched, never its value; what is hot is
broadcast, so the joins meet no hot key.

Defined results: null text is empty and holds the end token alone; a context
is the word before, the end token at the start of a text; words unknown to the
training share one place of the V + 1; repeated rows count and score one by
one; a corpus without training rows scores every token a0 / 1 = 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession, Window

from kindred.llm.arrowtext import give_back, hash_strings, mix, slices, small_batches, texts, words
from kindred.llm.toxicity import fold
from kindred.llm.url_filter import _bits, maybe_listed
from kindred.storage import discard, materialise

END = np.uint64(0x5851F42D4C957F2D)  # the end token's hash
FREQUENT = 1 << 20
MAX_PAIRS = 2_000_000
WORD_BLOCKS = 1 << 19  # 64-bit blocks of each of the words' two filters: 4 MB
PAIR_BLOCKS = 1 << 21  # of the pairs' filter: 16 MB
BUCKETS = 24
STEP = 3  # cells per doubling of a ratio
EM_ROUNDS = 60
ROWS_OUT = 1 << 15  # of a batch that leaves Python, which the JVM holds as a whole
SCORED_BYTES = 1 << 20  # of text scored at a time; sums are by text, so slices need not be large
ADD = 0.1


def tokens(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, the end of each text included, and the texts' offsets."""
    index, listed, ends = words(values)
    h = hash_strings(listed)[index]
    stop = np.cumsum(np.diff(ends) + 1) - 1
    out = np.full(len(h) + len(values), END)
    body = np.ones(len(out), bool)
    body[stop] = False
    out[body] = h
    return out, np.concatenate(([0], stop + 1))


def pair_keys(ctx: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(ctx * np.uint64(0x9E3779B97F4A7C15) + word)


def before(h: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Each token's context."""
    out = np.concatenate((h[-1:], h[:-1]))
    out[ends[:-1]] = END
    return out


class Counted:
    """Broadcast counts by hash: the most frequent keys, and a filter over the others."""

    def __init__(self, listed: pa.Table, repeated: np.ndarray):
        key = listed.column("key").to_numpy()
        order = np.argsort(key)
        self.keys, self.repeated = key[order], repeated
        # One more place, for every other key; pairs have no ``main``.
        column = lambda c: np.append(listed.column(c).to_numpy()[order], 0) if c in listed.column_names else np.zeros(len(key) + 1, np.int8)
        self.main, self.total = column("main"), column("total")

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places of the keys, the last for those that are not listed."""
        if not len(self.keys):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.keys, h.view(np.int64)), len(self.keys) - 1)
        return np.where(self.keys[at] == h.view(np.int64), at, len(self.keys))

    def counts(self, h: np.ndarray, training: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(main, total, open) of keys: ``open`` where only a join can tell, the counts then 0.

        A key of a training text that is neither listed nor repeated occurs
        once, there.  ``main`` is right for texts of the deleted part only.
        """
        keys, back = np.unique(h, return_inverse=True)
        at = self.find(keys)
        other = at == len(self.keys)
        maybe = maybe_listed(keys.view(np.int64), self.repeated)
        at, other, maybe = at[back], other[back], maybe[back]
        single = other & training & ~maybe
        return self.main[at], self.total[at] + single, other & ~single


class Spelt(Counted):
    """Counts of words: the most frequent ones listed, the digits of the others' in a filter.

    A digit is a key of its own, the word's hash XOR a number for the digit's
    place.  Spelt are total - 1 and, as ``main`` is asked for in texts of the
    deleted part only, held - 1, so that words seen once take no room.
    """

    def __init__(self, listed: pa.Table, digits: np.ndarray, places: int, doubts: np.ndarray | None = None):
        super().__init__(listed, digits)
        self.places, self.doubts = places, doubts

    def spell(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(total, held) of words that are not listed, as the filter has them."""
        total, held = np.ones(len(keys), np.int64), np.ones(len(keys), np.int64)
        for k in range(self.places):
            total += maybe_listed(keys ^ digit_place(k, False), self.repeated).astype(np.int64) << k
            held += maybe_listed(keys ^ digit_place(k, True), self.repeated).astype(np.int64) << k
        return total, held

    def counts(self, h: np.ndarray, training: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, back = np.unique(h, return_inverse=True)
        at = self.find(keys)
        main, total, doubt = self.main[at], self.total[at], np.zeros(len(keys), bool)
        other = np.flatnonzero(at == len(self.keys))
        spelt, held = self.spell(keys[other].view(np.int64))
        main[other], total[other] = spelt - held, spelt
        doubt[other] = maybe_listed(keys[other].view(np.int64), self.doubts)
        # The spelt count stands for counted words only, which those of other texts need not be.
        unlisted = np.zeros(len(keys), bool)
        unlisted[other] = True
        left = np.where(training, doubt[back], unlisted[back])
        return np.where(left, 0, main[back]), np.where(left, 0, total[back]), left


def digit_place(k: int, held: bool) -> np.int64:
    """The number that stands for a digit's place in the key of the filter."""
    return mix(np.array([2 * k + held + 1], np.uint64)).view(np.int64)[0]


class Tokens:
    """The tokens of texts: pairs, and the counts of words and contexts."""

    def __init__(self, values: pa.Array, training: np.ndarray, vocabulary: Spelt):
        self.word, self.ends = tokens(values)
        self.ctx = before(self.word, self.ends)
        self.pair = pair_keys(self.ctx, self.word)
        self.size = np.diff(self.ends)
        self.training = np.repeat(training, self.size)
        self.main, self.total, self.open = vocabulary.counts(self.word, self.training)
        end_main, end_total, end_open = vocabulary.counts(np.array([END]), np.array([False]))
        shifted = lambda x, end: np.where(np.isin(np.arange(len(x)), self.ends[:-1]), end[0], np.concatenate((x[-1:], x[:-1])))
        self.ctx_main, self.ctx_total, self.ctx_open = shifted(self.main, end_main), shifted(self.total, end_total), shifted(self.open, end_open)


def in_rows(made: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of bounded length."""
    return (made.slice(a, ROWS_OUT) for a in range(0, len(made), ROWS_OUT))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            h, ends = tokens(texts(part))
            yield from in_rows(_sums(h, held=np.repeat(np.asarray(part.column("held")), np.diff(ends))))


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            h, ends = tokens(texts(part))
            training, held = (np.repeat(np.asarray(part.column(c)), np.diff(ends)) for c in ("training", "held"))
            yield from in_rows(_sums(pair_keys(before(h, ends), h), held=held, asked=~training))


def _sums(keys: np.ndarray, **marks: np.ndarray) -> pa.RecordBatch:
    """Each key once, with how often it has each mark, and none of them (``main``)."""
    key, inverse = np.unique(keys, return_inverse=True)
    found = {c: np.bincount(inverse, x, len(key)).astype(np.int64) for c, x in marks.items()}
    main = np.bincount(inverse, minlength=len(key)) - sum(found.values())
    return pa.RecordBatch.from_pydict({"key": pa.array(key.view(np.int64)), "main": pa.array(main)} | {c: pa.array(x) for c, x in found.items()})


def bucket_of(total: np.ndarray) -> np.ndarray:
    """0 for unseen contexts, else one more than the power of two below the count."""
    return np.where(total > 0, np.minimum(BUCKETS - 1, np.floor(np.log2(np.maximum(total, 1))).astype(np.int64) + 1), 0)


def bucket_column(total: Column) -> Column:
    return F.when(total > 0, F.least(F.lit(BUCKETS - 1), F.floor(F.log2(total)).cast("int") + 1)).otherwise(0)


def ratio_column(part: Column, whole: Column, places: int) -> Column:
    """An estimate against the uniform one, in cells; null where it is zero."""
    return F.when((part > 0) & (whole > 0), F.round(F.log2(part / whole * places) * STEP).cast("int"))


def learn_weights(cells: list[tuple[int, int | None, int | None, int]], rounds: int = EM_ROUNDS) -> np.ndarray:
    """EM over (bucket, pair ratio, word ratio, times): weights (buckets, 3) of pair, word and uniform estimates."""
    if not cells:
        return np.tile([0.0, 0.0, 1.0], (BUCKETS, 1))
    b = np.array([c[0] for c in cells])
    n = np.array([c[3] for c in cells], float)
    p = np.stack([np.array([0.0 if c[i] is None else 2.0 ** (c[i] / STEP) for c in cells]) for i in (1, 2)] + [np.ones(len(cells))], axis=1)

    def em(where: np.ndarray, start: np.ndarray) -> np.ndarray:
        a = start
        for _ in range(rounds):
            post = p[where] * a
            a = (n[where, None] * post / post.sum(axis=1, keepdims=True)).sum(axis=0) / n[where].sum()
            a = np.maximum(a, 1e-9) / np.maximum(a, 1e-9).sum()
        return a

    overall = em(np.arange(len(b)), np.full(3, 1 / 3))
    out = np.stack([em(at, overall) if len(at := np.flatnonzero(b == k)) else overall for k in range(BUCKETS)])
    unseen = out[:, 1:] / out[:, 1:].sum(axis=1, keepdims=True)
    out[0] = [0.0, *unseen[0]]  # a context without pairs has no pair estimate
    return out


def repeated_filter(keys: DataFrame, blocks: int) -> np.ndarray:
    """Blocks of a Bloom filter over column ``key``, hashes themselves; at most ``blocks`` rows reach the driver."""
    coded = keys.select(F.pmod("key", F.lit(blocks)).cast("int").alias("block"), _bits("key").alias("bits"))
    listed = coded.groupBy("block").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(blocks, np.int64)
    out[listed.column("block").to_numpy()] = listed.column("bits").to_numpy()
    return out


def least_listed(table: DataFrame, most: int) -> int:
    """The count from which on keys are listed, ``most`` of them at most (ties at the edge stay out)."""
    counts = table.groupBy("total").agg(F.count("*").alias("n"))
    reached = counts.withColumn("sofar", F.sum("n").over(Window.orderBy(F.desc("total"))))  # a row for each count there is
    least = reached.where(F.col("sofar") <= most).agg(F.min("total")).first()[0]
    return least if least is not None else 1 << 62


def counted(pairs: DataFrame, most: int, blocks: int) -> Counted:
    """The ``most`` most frequent pairs and a filter of the other repeated ones."""
    least = least_listed(pairs, most)
    repeated = repeated_filter(pairs.where((F.col("total") > 1) & (F.col("total") < least)), blocks)
    out = Counted(pairs.where((F.col("total") >= least) & (F.col("total") > 0)).select("key", "total").toArrow(), repeated)
    give_back()
    return out


def spelt(table: DataFrame, most: int, blocks: int) -> Spelt:
    """The ``most`` most frequent words, the digits of the others' counts, and the words these are wrong for."""
    least = least_listed(table, most)
    others = table.where(F.col("total") < least).select("key", "total", (F.col("total") - F.col("main")).alias("held"))
    places = int((others.agg(F.max("total")).first()[0] or 1) - 1).bit_length()
    listed = table.where(F.col("total") >= least).select("key", "main", "total").toArrow()
    digit = lambda c, k: F.when(F.col(c) > 0, F.shiftright(F.col(c) - 1, k).bitwiseAND(1) == 1)
    digits = [F.when(digit(c, k), F.col("key").bitwiseXOR(F.lit(int(digit_place(k, c == "held"))))) for k in range(places) for c in ("total", "held")]
    set_digits = others.where("total > 1").select(F.explode(F.array_compact(F.array(*digits))).alias("key")) if digits else others.select("key").limit(0)
    out = Spelt(listed, repeated_filter(set_digits, blocks), places)
    give_back()
    shared = table.sparkSession.sparkContext.broadcast(out)

    def wrong(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, total, held = (batch.column(c).to_numpy() for c in ("key", "total", "held"))
            told, told_held = shared.value.spell(key)
            at = np.flatnonzero((told != total) | ((held > 0) & (told_held != held)))
            yield pa.RecordBatch.from_pydict({"key": pa.array(key[at])})

    out.doubts = repeated_filter(others.mapInArrow(wrong, "key long"), blocks)
    shared.destroy()
    give_back()
    return out


def lm_scores(docs: DataFrame, training: Column, deleted: Column, *, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """``id_col``, counts, train_tokens and both scores of every row.

    ``training`` marks the rows to learn from; those of them that ``deleted``
    marks are held out from the counts while the weights are learned.
    """
    spark = docs.sparkSession
    marked = docs.select(id_col, F.col(text_col).alias("text"), F.coalesce(training, F.lit(False)).alias("training"), (F.coalesce(training, F.lit(False)) & F.coalesce(deleted, F.lit(False))).alias("held"))
    used = marked.select("text", "training", "held")
    total = (F.col("main") + F.col("held")).alias("total")
    sums = [F.sum(c).alias(c) for c in ("main", "held")]
    word_counts = used.where("training").mapInArrow(_count_words, "key long, main long, held long").groupBy("key").agg(*sums)
    word_table = materialise(word_counts.select("key", "main", total), "words")
    v, n_main, n = word_table.agg(F.count("*"), F.coalesce(F.sum("main"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    pair_counts = used.mapInArrow(_count_pairs, "key long, main long, held long, asked long").groupBy("key").agg(*sums, F.max("asked").alias("asked"))
    stored = pair_counts.select("key", "main", total, "asked").where((F.col("total") > 1) | ((F.col("total") > 0) & (F.col("asked") > 0)))
    pairs = materialise(stored.drop("asked"), "pairs")
    vocabulary = spark.sparkContext.broadcast(spelt(word_table, frequent, WORD_BLOCKS))
    listed = spark.sparkContext.broadcast(counted(pairs, max_pairs, PAIR_BLOCKS))
    give_back()

    def seldom(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs with a word or context whose count only a join can tell; null stands for one that is known."""
        for batch in batches:
            for part in slices(batch, "text"):
                t = Tokens(texts(part), np.asarray(part.column("training")), vocabulary.value)
                at = np.flatnonzero(t.open | t.ctx_open)
                at = at[np.unique(t.pair[at] ^ (t.open[at] * np.uint64(1) + t.ctx_open[at] * np.uint64(2)), return_index=True)[1]]
                asked = {c: pa.array(h[at].view(np.int64), mask=~o[at]) for c, h, o in (("word", t.word, t.open), ("ctx", t.ctx, t.ctx_open))}
                yield from in_rows(pa.RecordBatch.from_pydict({"key": pa.array(t.pair[at].view(np.int64))} | asked))

    def heldout(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                t = Tokens(texts(part), np.asarray(part.column("training")), vocabulary.value)
                _, at, times = np.unique(t.pair, return_index=True, return_counts=True)
                yield from in_rows(pa.RecordBatch.from_pydict({"key": pa.array(t.pair[at].view(np.int64)), "held": pa.array(times.astype(np.int64)), "c1": pa.array(t.main[at]), "c2": pa.array(t.ctx_main[at])}))

    by = lambda name, tag: word_table.select(F.col("key").alias(name), F.col("main").alias(f"main{tag}"), F.col("total").alias(f"total{tag}"))
    asked = used.select("text", "training").mapInArrow(seldom, "key long, word long, ctx long").groupBy("key").agg(F.max("word").alias("word"), F.max("ctx").alias("ctx"))
    asked = asked.select("key", *(F.coalesce(c, "key").alias(c) for c in ("word", "ctx")))  # the pair's hash spreads what needs no join
    asked = asked.join(by("word", 1), "word", "left").join(by("ctx", 2), "ctx", "left")
    rare = materialise(asked.select("key", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("main1", "total1", "main2", "total2"))), "rare")
    discard(word_table)

    out_of = used.where("held").mapInArrow(heldout, "key long, held long, c1 long, c2 long")
    out_of = out_of.join(pairs.select("key", "main"), "key", "left").join(rare.select("key", "main1", "main2"), "key", "left")
    sofar = lambda own, found: F.greatest(F.col(own), F.coalesce(found, F.lit(0)))  # noqa: E731  what a join must tell is 0 before it
    cells = out_of.select("held", F.coalesce("main", F.lit(0)).alias("main"), sofar("c1", "main1").alias("c1"), sofar("c2", "main2").alias("c2"))
    weights = learn_weights(_cells(cells, n_main, v))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SCORED_BYTES):
                made, more = _score(Tokens(texts(part), np.asarray(part.column("training")), vocabulary.value), listed.value, weights, n, v)
                none = len(more["key"])
                at = pa.array(np.concatenate((np.arange(len(part)), more.pop("text"))))
                own = {"key": mix(part.column("_row").to_numpy().view(np.uint64)).view(np.int64)}
                pad = {c: pa.array(np.concatenate((x, np.zeros(none, x.dtype)))) for c, x in made.items()}
                pad |= {c: pa.array(np.concatenate((own.get(c, np.zeros(len(part), x.dtype)), x))) for c, x in more.items()}
                ids = part.column(id_col).take(pa.array(np.concatenate((np.arange(len(part)), np.zeros(none, np.int64))), mask=np.arange(len(part) + none) >= len(part)))
                yield from in_rows(pa.RecordBatch.from_pydict({id_col: ids, "_row": part.column("_row").take(at)} | pad))

    rows = marked.drop("held").withColumn("_row", F.monotonically_increasing_id())
    kind = rows.schema[id_col].dataType.simpleString()
    scored = rows.mapInArrow(run, f"`{id_col}` {kind}, _row long, n_tokens long, n_known long, base_score double, score double, key long, times int, n long, c1 long, c2 long, late boolean")
    # Rows of texts have no times; their keys are random and their sums final.
    found = scored.join(pairs.select("key", F.col("total").alias("_n")), "key", "left").join(rare.select("key", "total1", "total2"), "key", "left")
    # A pair that is not stored occurs once for a training text (n = -1), never for another (-2).
    pair = F.when(F.col("n") >= 0, F.col("n")).otherwise(F.coalesce("_n", F.col("n") + 2))
    found = found.select(id_col, "_row", "n_tokens", "n_known", "base_score", "score", "late", "times", pair.alias("n"), sofar("c1", "total1").alias("c1"), sofar("c2", "total2").alias("c2"))
    mixed = [F.element_at(F.array(*[F.lit(float(x)) for x in weights[:, i]]), bucket_column(F.col("c2")) + 1) for i in range(3)]
    chance = mixed[0] * F.col("n") / F.greatest(F.col("c2"), F.lit(1)) + mixed[1] * F.col("c1") / F.lit(max(n, 1)) + mixed[2] / F.lit(v + 1)
    base = F.log10((F.col("c1") + ADD) / F.lit(n + ADD * (v + 1)))
    out = found.groupBy("_row").agg(
        F.max(id_col).alias(id_col),
        F.max("n_tokens").alias("n_tokens"),
        F.sum(F.when(F.col("late") & (F.col("c1") > 0), F.col("times")).otherwise(F.col("n_known"))).alias("n_known"),
        F.sum(F.when(F.col("late"), F.col("times") * base).otherwise(F.col("base_score"))).alias("base_score"),
        F.sum(F.when(F.col("times") > 0, F.col("times") * F.log10(chance)).otherwise(F.col("score"))).alias("score"),
    )
    return out.drop("_row").withColumn("train_tokens", F.lit(n).cast("long"))


def _score(t: Tokens, listed: Counted, weights: np.ndarray, n: int, v: int) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Sums over settled tokens by text; the other tokens, equal ones of a text as one."""
    _, pair, open_pair = listed.counts(t.pair, t.training)
    a = weights[bucket_of(t.ctx_total)]
    chance = a[:, 0] * pair / np.maximum(t.ctx_total, 1) + a[:, 1] * t.total / max(n, 1) + a[:, 2] / (v + 1)
    base = np.log10((t.total + ADD) / (n + ADD * (v + 1)))
    settled = ~(t.open | t.ctx_open | open_pair)
    each = lambda x: np.add.reduceat(x, t.ends[:-1]) if len(t.size) else np.zeros(0)
    sums = {"n_tokens": t.size.astype(np.int64), "n_known": each((t.total > 0).astype(np.int64)).astype(np.int64), "base_score": each(np.where(t.open, 0, base)), "score": each(np.where(settled, np.log10(np.where(settled, chance, 1)), 0))}
    rest = np.flatnonzero(~settled)
    row = np.repeat(np.arange(len(t.size)), t.size)[rest]
    _, first, times = np.unique(mix(t.pair[rest] + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True, return_counts=True)
    at = rest[first]
    known = np.where(open_pair[at], np.where(t.training[at], -1, -2), pair[at])
    return sums, {"text": row[first], "key": t.pair[at].view(np.int64), "times": times.astype(np.int32), "n": known, "c1": t.total[at], "c2": t.ctx_total[at], "late": t.open[at]}


def _cells(asked: DataFrame, n_main: int, v: int) -> list[tuple[int, int | None, int | None, int]]:
    """Held-out pairs as EM cells; ``asked`` has main, held, c1 and c2."""
    cells = asked.select(
        bucket_column(F.col("c2")).alias("bucket"),
        ratio_column(F.col("main"), F.col("c2"), v + 1).alias("r2"),
        ratio_column(F.col("c1"), F.lit(n_main), v + 1).alias("r1"),
        "held",
    )
    table = materialise(cells.groupBy("bucket", "r2", "r1").agg(F.sum("held").alias("n")), "cells")  # buckets x cells x cells
    found = [tuple(r) for r in table.collect()]
    discard(table)
    return found


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: learns from fold 1-9 of 10, with fold 1 deleted for the weights; scores all."""
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    part = fold("doc_id", 10)
    scored = lm_scores(docs, part != 0, part == 1)
    return scored.select("doc_id", (part == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
