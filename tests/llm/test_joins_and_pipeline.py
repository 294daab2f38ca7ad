"""The Jaccard join against brute force, and the pipeline's stages."""

import random
import re

import numpy as np
import pyspark.sql.functions as F
import pytest

from kindred.llm import parity_join, stages
from kindred.llm.parity_join import Bands, bits_apart, block_keys, fold_sketch, sketch
from tests.helpers import SF

DOC = "doc_id long, text string"


def shingles(text, size):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(w) < size:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def brute_components(rows, size, num, den):
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and find(i) != find(j) and den * (n := len(a & b)) >= num * (len(a) + len(b) - n):
                parent[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(sets[k]), least.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)), key=str)


def corpus(seed, spread):
    """Random texts with groups of edited copies, one of them large and dense."""
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []

    def edited(text, share):
        return [draw.choice(vocabulary) if draw.random() < share else w for w in text]

    for size in (1, 2, 3, 5, 8, 20, 60, 150):
        for _ in range(4):
            base = [draw.choice(vocabulary) for _ in range(size)]
            rows += [base] + [edited(base, draw.choice(spread)) for _ in range(draw.randint(0, 6))]
    centre = [draw.choice(vocabulary) for _ in range(120)]
    rows += [edited(centre, draw.choice(spread)) for _ in range(60)]
    draw.shuffle(rows)
    out = [(i, " ".join(r)) for i, r in enumerate(rows)]
    return [*out, (0, out[5][1]), (900, out[5][1].upper()), (901, None), (902, ""), (903, " \n"), (None, out[6][1])]


@pytest.mark.parametrize(("seed", "size", "similarity", "tile"), [(1, 3, (90, 100), 1024), (2, 3, (90, 100), 7), (3, 5, (80, 100), 1024), (4, 5, (80, 100), 5), (5, 1, (70, 100), 16)])
def test_components_equal_brute_force(spark, monkeypatch, seed, size, similarity, tile):
    monkeypatch.setattr(parity_join, "TILE", tile)
    rows = corpus(seed, (0.0, 0.005, 0.01, 0.02, 0.03, 0.05))
    docs = spark.createDataFrame(rows, DOC).withColumn("n_shingles", F.lit("clash")).withColumn("node", F.lit(1)).repartition(3)
    got = parity_join.jaccard_components(docs, shingle=size, similarity=similarity)
    assert sorted(map(tuple, got.collect()), key=str) == brute_components(rows, size, *similarity)


def test_join_of_nothing(spark):
    docs = spark.createDataFrame([], DOC)
    assert parity_join.jaccard_components(docs).count() == 0
    only = spark.createDataFrame([(1, None), (2, "a b c d")], DOC)
    assert sorted(map(tuple, parity_join.jaccard_components(only).collect())) == [(1, 0, 1), (2, 2, 2)]


def test_sketch_distance_is_a_lower_bound_and_blocks_meet():
    draw = np.random.default_rng(0)
    bands = Bands(90, 100)
    for size in (5, 30, 200, 2000):
        a = np.unique(draw.integers(0, 1 << 63, size).astype(np.uint64) * np.uint64(2))
        for changes in (0, 1, bands.allowed(2 * size) // 2):
            b = np.unique(np.concatenate((a[changes:], draw.integers(0, 1 << 63, changes).astype(np.uint64) * np.uint64(2))))
            apart = len(np.setxor1d(a, b))
            for band in {bands.of(len(a)), bands.of(len(b))}:
                blocks, leave = bands.blocks(band)
                x, y = sketch(a, blocks), sketch(b, blocks)
                assert np.bitwise_count(x ^ y).sum() <= apart
                assert bits_apart(fold_sketch(x), fold_sketch(y)) <= apart
                if apart <= bands.allowed(len(a) + len(b)):
                    assert len(np.intersect1d(block_keys(a, blocks, band, leave), block_keys(b, blocks, band, leave)))


# --- stages -----------------------------------------------------------------

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept_text string, contaminated boolean"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", None, len(t or ""), 0.5, "mine", True) for i, t in texts], COLUMNS)


def test_stages_keep_columns_and_clean_documents(spark):
    line = "this very line stands in many documents"
    rows = [(i, f"{line}\nbut this one is only in document {i} " + " ".join(f"x{i}y{k}" for k in range(30))) for i in range(6)]
    rows += [(6, rows[0][1] + " z"), (7, None), (8, ""), (9, "some other words and then an item of ten words in a row is here")]
    docs = documents(spark, rows)
    lines = stages.drop_repeated_lines(docs)
    assert lines.columns == docs.columns
    got = {r["doc_id"]: r for r in lines.collect()}
    assert len(got) == 10
    assert sum(line in got[i]["text"] for i in range(7)) == 1
    assert all(got[i]["n_chars"] == len(got[i]["text"]) for i in got)
    assert got[3]["kept_text"] == "mine"
    near = stages.drop_near_copies(docs)
    assert near.columns == docs.columns
    assert sorted(r["doc_id"] for r in near.collect()) == [0, 1, 2, 3, 4, 5, 7, 8, 9]
    items = spark.createDataFrame([(1, "an item of ten words in a row is here")], "item_id long, text string")
    clean = stages.drop_leaks(docs, items)
    assert clean.columns == docs.columns
    assert sorted(r["doc_id"] for r in clean.collect()) == list(range(9))
    assert {r["contaminated"] for r in clean.collect()} == {True}


def test_near_copies_keep_one_of_repeated_rows_and_null_ids(spark):
    text = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text + " more"), (None, "a b"), (None, "a b"), (3, "")], DOC)
    kept = sorted((r["doc_id"] for r in stages.drop_near_copies(docs).collect()), key=str)
    assert kept == [1, 3, None, None]


def test_near_copies_judge_texts_not_ids(spark):
    words = lambda c: " ".join(f"{c}{k}" for k in range(40))
    rows = [(0, words("a")), (1, words("a")), (1, words("b")), (2, words("b") + " more"), (3, words("c")), (3, words("c") + " tail")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, _text long")
    kept = stages.drop_near_copies(docs)
    assert kept.columns == docs.columns
    got = [tuple(r) for r in kept.collect()]
    assert sorted(i for i, _, _ in got) == [0, 1, 3]
    assert {t[0] for _, t, _ in got} == {"a", "b", "c"}
    assert stages.drop_near_copies(docs.limit(0)).count() == 0


def test_a_large_group_is_compared_in_about_its_size(spark, monkeypatch):
    monkeypatch.setattr(parity_join, "TILE", 32)
    base = [f"w{k}" for k in range(300)]
    texts = [" ".join(f"new{i}" if k == i % 300 else w for k, w in enumerate(base)) for i in range(1000)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(5000, texts[0] + " tail")], DOC)
    placed = []
    tiled = parity_join.tiled
    monkeypatch.setattr(parity_join, "tiled", lambda keys, *a: placed.append((keys.count(), tiled(keys, *a).count())) or tiled(keys, *a))
    got = parity_join.jaccard_components(docs)
    assert {r["component_id"] for r in got.collect()} == {0}
    assert all(met <= 2 * rows + 32 for rows, met in placed)


def test_toxic_stage_keeps_unscored_columns(spark):
    docs = documents(spark, [(i, ("vile " if i % 5 == 0 else "kind ") + " ".join(f"w{(i * 7 + k) % 90}" for k in range(20))) for i in range(400)] + [(999, None)])
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)], "doc_id long, toxic int")
    kept = stages.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids == {i for i in range(400) if i % 5} | {999}


def test_pipeline_runs_and_every_stage_shrinks_or_keeps(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in pipeline.STAGES[:-1]:
        path = f"{spark.conf.get('spark.checkpoint.dir')}/stage-{name}"
        stage(spark, docs, SF).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns
        assert 0 < docs.count() <= before
        before = docs.count()
    packed = pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.where("piece = 0").count() == before


def test_old_refuted_pair_does_not_hide_an_untested_one(spark):
    """1-2 was refuted in an earlier round, 5-6 in the last; 3-4 alone can join the components {1, 3} and {2, 4}."""
    bits = {1: 0b111111, 2: 0b111111, 3: 0b111111 << 8, 4: 0b1111111 << 8, 5: 0xFFFFFFFF << 24, 6: 0xFFFFFFFF << 24}
    reps = spark.createDataFrame([(i, 100, bytearray(b.to_bytes(8, "little")), None) for i, b in bits.items()], "node long, n long, own binary, next binary")
    keys = spark.createDataFrame([(7, i, True, 1, 6) for i in bits], "key long, node long, own boolean, leader long, held long")
    labels = spark.createDataFrame([(1, 1), (3, 1), (2, 2), (4, 2)], "id long, component long")
    tested = spark.createDataFrame([(1, 3, True), (2, 4, True), (1, 2, False), (5, 6, False)], "a long, b long, linked boolean")
    partners = parity_join.refuted_partners(tested, tested.where("a = 5"))
    got = parity_join.tile_pairs(keys, reps, Bands(90, 100), labels, partners).collect()
    assert [tuple(r) for r in got] == [(3, 4)]


def held_rows(keys):
    """Rows of ``one_of_equal`` for {key: (nodes, spare, stands)}."""
    return [(k, n, True, spare, len(nodes), stands) for k, (nodes, spare, stands) in keys.items() for n in nodes]


def test_sets_spare_their_hottest_keys_and_never_more_than_they_may(spark):
    keys = {1: (range(100), 2, 1), 2: (range(50), 2, 1), 3: (range(10), 2, 1), 4: ((0, 1), 2, 1), 5: ((8, 9), 2, 3)}
    rows = spark.createDataFrame(held_rows(keys), "key long, node long, own boolean, spare int, held long, stands long")
    left = {}
    for r in parity_join.without_hot(rows).collect():
        left.setdefault(r["node"], set()).add(r["key"])
    assert left[0] == {3, 4} and left[8] == {3, 5} and left[5] == {3}
    assert not any(n in left for n in range(10, 100))


def test_repair_takes_keys_of_both_texts_and_what_is_linked_to_them(spark):
    """One refuted pair used to bring every text of every key of either end."""
    keys = [(1, n) for n in range(100)] + [(2, n) for n in (0, 1, 50)] + [(3, n) for n in (0, *range(60, 90))] + [(4, n) for n in (1, 50)]
    keys = spark.createDataFrame(keys, "key long, node long")
    pairs = spark.createDataFrame([(0, 1)], "a long, b long")
    labels = spark.createDataFrame([(0, 0), (50, 0), (60, 60), (61, 60)], "id long, component long")
    got = sorted((r["key"], r["node"]) for r in parity_join.broken_rows(keys, pairs, labels).collect())
    assert got == [(1, 0), (1, 1), (1, 50), (2, 0), (2, 1), (2, 50)]


def test_unrelated_texts_with_common_passages_hardly_share_keys(spark):
    """Blocks of one common shingle used to join texts that share nothing else."""
    draw = random.Random(7)
    phrases = [" ".join(f"p{k}x{j}" for j in range(3)) for k in range(40)]
    rows = []
    for i in range(120):
        parts = [" ".join(f"d{i}w{k}n{j}" for j in range(4)) for k in range(50)]
        for phrase in draw.sample(phrases, 12):
            parts.insert(draw.randrange(len(parts)), phrase)
        rows.append((i, " ".join(parts)))
    docs = spark.createDataFrame(rows, DOC)
    sets, reps, seed = parity_join.distinct_sets(docs, id_col="doc_id", text_col="text", shingle=3)
    keys = parity_join.join_keys(docs, Bands(80, 100), text_col="text", shingle=3, seed=seed)
    assert keys.count() <= 30


def left_of(plan, join):
    """The lines below each ``join`` of a plan that belong to its left side."""
    lines = [(len(x) - len(x.lstrip(" :+-")), x) for x in plan.splitlines()]
    for at, (depth, line) in enumerate(lines):
        if join in line:
            below = lines[at + 1 :]
            right = next(k for k, (d, x) in enumerate(below) if d == depth + 3 and x.lstrip(" :").startswith("+-"))
            yield [x for _, x in below[:right]]


def test_components_join_texts_and_not_their_keys(spark, monkeypatch):
    """With labels known, every row of every key used to be joined with them, and again with the refuted partners."""
    reps = spark.createDataFrame([(i, 100, bytearray(8), None) for i in range(6)], "node long, n long, own binary, next binary")
    keys = spark.createDataFrame([(k, i, True, 0, 6) for i in range(6) for k in range(9)], "key long, node long, own boolean, leader long, held long")
    labels = spark.createDataFrame([(1, 0), (2, 0)], "id long, component long")
    tested = spark.createDataFrame([(3, 4, False)], "a long, b long, linked boolean")
    plans, store = [], parity_join.materialise
    monkeypatch.setattr(parity_join, "materialise", lambda df, name: plans.append(df) or store(df, name))
    plans.append(parity_join.tile_pairs(keys, reps, Bands(90, 100), labels, parity_join.refuted_partners(tested, tested)))
    lefts = [x for df in plans for x in left_of(df._jdf.queryExecution().optimizedPlan().toString(), "LeftOuter")]
    assert lefts and not any("key#" in x for left in lefts for x in left)
