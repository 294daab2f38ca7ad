"""Neighbours, language model, toxicity, packing, token counts."""

import math
import random
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyspark.sql.functions as F
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kindred.llm import language_model, neighbours, packing, registry, token_counts, toxicity
from tests.helpers import SF

DOC = "doc_id long, text string"
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PARTS = ["a", "b", " ", "  ", "the", "ing", "\n", "é", "日", "🙂", "1", "23", "{", "▁", "er", "<s>", "<|endoftext|>", "==", "\t", "'s", "'RE", "\x1c", "\xa0", "İ", "Σ", "́", "\x00"]


# --- neighbours -------------------------------------------------------------


def brute_neighbours(rows, k=5):
    x = np.array([v for _, v in rows], float)
    ids = np.array([i for i, _ in rows])
    norm = np.sqrt((x * x).sum(axis=1))
    out = {}
    for i in np.flatnonzero(ids % 50 == 0):
        score = (x * x[i]).sum(axis=1) / (norm * norm[i])
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [int(ids[j]) for j in order]
    return out


def found(frame):
    out = {}
    for r in frame.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["vec_id"])
    return out


def test_recall_on_the_embeddings(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    expected = brute_neighbours([tuple(r) for r in vectors.collect()])
    for options, bar in (({}, 0.9), ({"window": 0.03, "least": 1, "block": 16}, 0.9)):
        got = found(neighbours.search(vectors, F.col("vec_id") % 50 == 0, **options))
        assert got.keys() == expected.keys()
        assert np.mean([len(set(got[q]) & set(expected[q])) / 5 for q in expected]) >= bar


def test_vectors_as_bytes():
    x = np.random.default_rng(3).normal(size=(500, 64)) * np.logspace(-30, 30, 500)[:, None]
    near = neighbours.from_bytes(neighbours.to_bytes(x))
    exact = neighbours.unit(x)
    assert np.abs(near @ near.T - exact @ exact.T).max() < 0.02


def test_ties_bad_vectors_and_small_tables(spark):
    rows = [(i, [1.0, 0.0]) for i in range(0, 40)] + [(50, [0.0, 1.0]), (51, [0.0, 2.0]), (52, None), (53, [0.0, 0.0]), (54, [1.0, None]), (55, [float("nan"), 1.0]), (56, [float("inf"), 1.0]), (57, [1.0]), (None, [1.0, 1.0]), (51, [0.0, 2.0]), (100, [0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = found(neighbours.search(vectors, F.col("vec_id") % 50 == 0))
    assert got == {0: [1, 2, 3, 4, 5], 50: [51, 0, 1, 2, 3]}
    few = found(neighbours.search(vectors.where("vec_id in (0, 50)"), F.col("vec_id") % 50 == 0))
    assert few == {0: [50], 50: [0]}
    assert neighbours.search(vectors.limit(0), F.lit(True)).count() == 0


def test_hilbert_curve_visits_neighbours():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    keys = neighbours.hilbert_keys(grid, 3)
    assert sorted(keys) == list(range(512))
    path = grid[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


# --- language model -----------------------------------------------------------


def split(text):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def test_language_model_counts_and_gain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(900001, None), (900002, ""), (900003, "zzz-unseen " * 5), (0, "the the")], DOC)).withColumn("score", F.lit("clash"))
    part = toxicity.fold("doc_id", 10)
    runs = [language_model.lm_scores(docs, part != 0, part == 1, **o).toPandas() for o in ({}, {"max_pairs": 0}, {"frequent": 50})]
    rows = docs.collect()
    train = Counter(w for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 10 for w in split(r["text"]))
    n, v = sum(train.values()), len(train)
    expected = sorted((r["doc_id"], len(t := split(r["text"])), sum(train[w] > 0 for w in t), round(sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 6)) for r in rows)
    for got in runs:
        assert sorted((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got.itertuples()) == expected
        assert (got["train_tokens"] == n).all()
        assert (got["score"] < 0).all()
    order = ["doc_id", "n_tokens", "base_score"]
    a, *others = (x.sort_values(order, ignore_index=True) for x in runs)
    assert all(np.allclose(a["score"], b["score"]) for b in others)
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in a["doc_id"]]
    assert a["score"][held].sum() > a["base_score"][held].sum()


def test_language_model_counts_all_pairs(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(["a b c", "a b d", "c d x", "x y", "a b c y", "b a", "d c b a b", "q r q r", None, "x y z a b"] * 3)] + [(99, "a new b c r q"), (98, "a b " * 9)]
    docs = spark.createDataFrame(rows, DOC)
    training, deleted = F.col("doc_id") < 98, F.col("doc_id") % 5 == 1
    train = [split(t) for i, t in rows if i < 98]
    word, pair = Counter(w for t in train for w in t), Counter(p for t in train for p in zip([None, *t], t))
    main = [split(t) for i, t in rows if i < 98 and i % 5 != 1]
    word_main, pair_main = Counter(w for t in main for w in t), Counter(p for t in main for p in zip([None, *t], t))
    n, v, n_main = sum(word.values()), len(word), sum(word_main.values())
    cell = lambda part, whole: round(math.log2(part / whole * (v + 1)) * language_model.STEP) if part and whole else None
    bucket = lambda c: int(language_model.bucket_of(np.array([c]))[0])
    held = Counter((bucket(word_main[h]), cell(pair_main[h, w], word_main[h]), cell(word_main[w], n_main)) for i, t in rows if i < 98 and i % 5 == 1 for h, w in zip([None, *split(t)], split(t)))
    a = language_model.learn_weights([(*k, times) for k, times in held.items()])
    expected = {}
    for i, t in rows:
        mixed = [a[bucket(word[h])] @ [pair[h, w] / max(word[h], 1), word[w] / n, 1 / (v + 1)] for h, w in zip([None, *split(t)], split(t))]
        expected[i] = sum(map(math.log10, mixed))
    for o in ({}, {"frequent": 3}, {"max_pairs": 3}, {"frequent": 0, "max_pairs": 0}):
        got = {r["doc_id"]: r["score"] for r in language_model.lm_scores(docs, training, deleted, **o).collect()}
        assert got.keys() == expected.keys()
        assert all(math.isclose(got[i], expected[i], rel_tol=1e-9) for i in got), o
    for blocks in (1, 2):  # digits by chance: doubts and joins settle them
        monkeypatch.setattr(language_model, "WORD_BLOCKS", blocks)
        got = {r["doc_id"]: r["score"] for r in language_model.lm_scores(docs, training, deleted, frequent=2).collect()}
        assert all(math.isclose(got[i], expected[i], rel_tol=1e-9) for i in expected), blocks


def test_language_model_spelt_counts(spark):
    rng = np.random.default_rng(3)
    key = rng.integers(-(1 << 62), 1 << 62, 3000)
    total = rng.geometric(0.2, 3000) ** 2
    held = rng.binomial(total, 0.3)
    table = spark.createDataFrame(list(zip(key.tolist(), (total - held).tolist(), total.tolist(), strict=True)), "key long, main long, total long")
    open_words = {}
    for blocks in (1 << 13, 1 << 8, 8):
        found = language_model.spelt(table, 200, blocks)
        main, counted, left = found.counts(key.view(np.uint64), np.ones(3000, bool))
        assert (counted[~left] == total[~left]).all()
        assert (main[~left & (held > 0)] == (total - held)[~left & (held > 0)]).all()
        assert not counted[left].any()
        assert len(found.keys) <= 200
        open_words[blocks] = left.mean()
        assert found.counts(key.view(np.uint64), np.zeros(3000, bool))[2].sum() == 3000 - len(found.keys)
    assert open_words[1 << 13] < 0.02 < open_words[8]
    assert not language_model.spelt(table.where("total = 1"), 5, 8).doubts.any()


def test_language_model_is_a_distribution():
    weights = language_model.learn_weights([(0, None, 3, 5), (1, 12, 2, 7), (1, None, None, 2), (3, 6, 6, 1)])
    assert np.allclose(weights.sum(axis=1), 1)
    assert weights[0, 0] == 0
    assert np.allclose(language_model.learn_weights([])[:, 2], 1)


def test_language_model_without_training(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], DOC)
    got = language_model.lm_scores(docs, F.lit(False), F.lit(False)).toPandas()
    assert (got["n_known"] == 0).all()
    assert (got["train_tokens"] == 0).all()
    assert language_model.lm_scores(docs.limit(0), F.lit(True), F.lit(False)).count() == 0


# --- toxicity -----------------------------------------------------------------


def test_toxicity_holds_out_and_separates(spark):
    draw = random.Random(2)
    words = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(900):
        text = [draw.choice(words) for _ in range(60)]
        if i % 6 == 0:
            text[draw.randrange(60)] = draw.choice(["Vilest", "vilesque", "rotten!"])
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame([*rows, (5000, None), (5001, ""), (7, "again rotten")], DOC).withColumn("score", F.lit("clash")).withColumn("label", F.lit(0))
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(900)] + [(None, 1), (8, None), (99999, 1)], "doc_id long, toxic int")
    weights, intercept = toxicity.train(docs, labels.where(toxicity.fold("doc_id", 3) != 1))
    got = toxicity.score(docs, weights, intercept).toPandas()
    assert len(got) == 903
    held = got[[zlib.crc32(str(i).encode()) % 3 == 1 and i < 900 for i in got["doc_id"]]]
    bad = held["doc_id"] % 6 == 0
    assert (held[bad]["score"] >= 0.7).mean() > 0.9
    assert (held[~bad]["score"] < 0.7).mean() > 0.98
    assert (weights != 0).mean() < 0.01
    assert got[got["doc_id"].isin([5000, 5001])]["score"].nunique() == 1


def test_toxicity_without_labels_and_documents(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], DOC)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score(docs, *toxicity.train(docs, none)).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), *toxicity.train(docs, none)).count() == 0


# --- packing ------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_plans_hold_every_piece_once(lengths):
    plan = packing.plan_bins(dict(Counter(lengths)), 40)
    used = Counter()
    for filling, times in plan:
        assert sum(s * n for s, n in filling) <= 40
        for s, n in filling:
            used[s] += n * times
    assert used == Counter(lengths)
    best = packing.bins(packing.best_fit(dict(Counter(lengths)), 40))
    assert -(-sum(lengths) // 40) <= packing.least_bins(dict(Counter(lengths)), 40) <= packing.bins(plan) <= best


def test_bin_completion_beats_best_fit():
    lengths = Counter([6, 5, 4, 3, 2])  # best fit opens 6+4, 5+3+2 in tens
    assert packing.bins(packing.plan_bins(dict(lengths), 10)) == 2
    assert packing.bins(packing.plan_bins({1: 100_000, 5: 3}, 4096)) == 25


def fewest_bins(items, capacity):
    """The optimum by trying every bin for every item."""
    items, best = sorted(items, reverse=True), len(items)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for room in set(rooms):
            if room >= items[i]:
                rest = list(rooms)
                rest.remove(room)
                place(i + 1, [*rest, room - items[i]])
        place(i + 1, [*rooms, capacity - items[i]])

    place(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.sampled_from([10, 20, 50, 100]).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(max(1, c // 8), c), max_size=9))))
def test_bin_completion_equals_the_exhaustive_optimum(case):
    capacity, lengths = case
    assert packing.bins(packing.plan_bins(dict(Counter(lengths)), capacity)) == fewest_bins(lengths, capacity)


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 30), st.lists(st.integers(1, 9), max_size=5, unique=True), st.integers(1, 3))
def test_fillings_are_all_undominated_ones_fullest_first(room, sizes, copies):
    sizes, most = sorted(sizes), {s: copies for s in sizes}
    found = list(packing.fillings(room, sizes, most))
    expected = set()
    for many in product(range(copies + 1), repeat=len(sizes)):
        total = sum(s * n for s, n in zip(sizes, many, strict=True))
        if total <= room and all(n == copies or total + s > room for s, n in zip(sizes, many, strict=True)):
            expected.add((total, tuple((s, n) for s, n in zip(sizes[::-1], many[::-1], strict=True) if n)))
    assert len(found) == len(set(found)) and set(found) == expected
    assert [t for t, _ in found] == sorted((t for t, _ in found), reverse=True)


@pytest.mark.parametrize(("low", "high", "gap"), [(800, 1500, 2), (700, 1300, 8), (1000, 2000, 24), (1, 4096, 5)])
def test_more_steps_never_need_more_bins(low, high, gap):
    """1,500 lengths; ``gap``: bins above the lower bound."""
    rng = np.random.default_rng(5)
    counts = dict(Counter(rng.integers(low, high + 1, 1500).tolist()))
    made = [packing.bins(packing.plan_bins(counts, 4096, steps)) for steps in (0, 300, 3000)]
    print(low, high, made, packing.least_bins(counts))
    assert made == sorted(made, reverse=True)
    assert made[-1] - packing.least_bins(counts) <= gap


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    draw = random.Random(4)
    rows = [(i % 25, "".join(draw.choice(PARTS) for _ in range(draw.randint(0, 60)))) for i in range(50)] + [(30, None), (31, ""), (32, "word salad " * 3000)]
    docs = spark.createDataFrame(rows, DOC).withColumn("offset", F.lit("clash")).repartition(3)
    cut = packing.pieces(docs, WORDS, capacity=64, with_ids=True)
    expected = Counter()
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        for p, at in enumerate(range(0, len(ids), 64)):
            part = ids[at : at + 64]
            expected[i, p, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
            assert len(part) == 64 or at + 64 >= len(ids)
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in cut.collect()) == expected
    placed = packing.pack_documents(docs, WORDS, capacity=64).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in placed) == expected
    sequences = {}
    for r in placed:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(sequences) <= 1.02 * sum(r["length"] for r in placed) / 64 + 1
    assert packing.pack_documents(docs.limit(0), WORDS).count() == 0


def test_hot_lengths_are_numbered_in_buckets(spark):
    cut = spark.range(1000).selectExpr("id as doc_id", "0 as piece", "0L as start", "if(id % 3 = 0, 7L, 3L) as length", "id as ids_crc32")
    cut.write.mode("overwrite").parquet(spark.conf.get("spark.checkpoint.dir") + "/cut")
    stored = spark.read.parquet(spark.conf.get("spark.checkpoint.dir") + "/cut")
    placed = packing.pack(stored, capacity=10, bucket_rows=50).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in placed}) == 1000
    assert len({r["sequence_id"] for r in placed}) == 334 + 111


# --- token counts ---------------------------------------------------------------


@pytest.fixture(scope="module")
def counter():
    return token_counts.machine(PIECES)


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=40), st.text(max_size=30))
def test_counts_equal_the_library(parts, more):
    machine, model = token_counts.machine(PIECES), sp_model()
    text = "".join(parts) + more
    if any(0xD800 <= ord(c) < 0xE000 for c in text):
        return
    values = pa.array([text], pa.large_string())
    assert token_counts.count_batch(values, machine)[0] == len(model.encode(text))
    if text:
        run = token_counts.SPACE + text.replace(" ", token_counts.SPACE)
        assert {machine.count_chunks(run, size) for size in (1, 3, 17, 4096)} == {len(model.encode(text))}


_MODEL = []


def sp_model():
    import sentencepiece

    if not _MODEL:
        _MODEL.append(sentencepiece.SentencePieceProcessor(model_file=PIECES))
    return _MODEL[0]


def test_forgetting_states_changes_nothing(library):
    small = token_counts.Transducer(token_counts.load_pieces(PIECES), max_states=50)
    for text in ("the quick brown fox " * 9, "antidisestablishment" * 40, "====" * 33):
        assert small.count_chunks("▁" + text.replace(" ", "▁")) == len(library.encode(text))
    assert len(small.states) < 2000


def test_token_counts_of_documents(spark, library):
    rows = [(1, None), (2, ""), (3, " x"), (4, "a" * 30000), (5, "tok en " * 5000), (1, "dup")]
    docs = spark.createDataFrame(rows, DOC).withColumn("n_tokens", F.lit("clash"))
    got = sorted((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.token_counts(docs, PIECES).collect())
    assert got == sorted((i, len((t or "").encode()), n := len(library.encode(t or "")), n > 4096) for i, t in rows)
    sample = registry.queries()["op10_token_counts"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), "doc_id").collect()
    assert all(r["n_tokens"] == len(library.encode(r["text"])) for r in sample)


def test_packing_plan_starts_no_rdd_workers(spark, monkeypatch):
    """Rows made on the driver would go through Python workers of their own, which stay for a minute."""
    docs = spark.createDataFrame([(i, "word " * (i % 50)) for i in range(300)], "doc_id long, text string").localCheckpoint()
    monkeypatch.setattr(type(spark), "_createFromLocal", lambda *a, **b: pytest.fail("rows go through an RDD"))
    path = public_tokenizers.path("word_bpe_49k.json")
    packed = packing.pack_documents(docs, path).collect()
    assert len(packed) == 300 and len({r["doc_id"] for r in packed}) == 300
    assert packing.pack_documents(docs.limit(0), path).count() == 0


def test_words_met_before_are_looked_up_in_arrow():
    """Every word used to become a Python string, the known ones as well."""
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    library, words = Tokenizer.from_file(path), packing.WordIds(path)
    for batch in (["one two one", "", " \n", "one \u00e9t\u00e9 123"], ["one six", "six"], ["a \x01 b\x01 one six", "b\x01"], [""]):
        ids, ends = words.ids(pa.array(batch, pa.large_string()))
        for k, text in enumerate(batch):
            assert ids[ends[k] : ends[k + 1]].tolist() == [i for w in text.split() for i in library.encode(w, add_special_tokens=False).ids]
    assert isinstance(words.known, pa.Array) and words.known.to_pylist() == ["one", "", "six", "b\x01"]
