"""Golden cases of Hamming search, merging, components and clustering."""

import random

import numpy as np
import pyspark.sql.functions as F
import pytest

from kindred.operators import clustering, hamming, merge
from kindred.operators.components import connected_components
from kindred.operators import components
from kindred.operators.hashing import from_hex, hex_hash

ZEROS, NEAR, ONES = "0" * 16, "0" * 15 + "f", "f" * 16


def groups_of(frame, key="label"):
    out = {}
    for r in frame.collect():
        out.setdefault(r[key], set()).add(r["id"])
    return sorted(map(sorted, out.values()))


def hashed(spark, items):
    rows = spark.createDataFrame(items, "id string, hex string")
    return rows.select("id", from_hex(F.col("hex")).alias("h"))


@pytest.mark.parametrize(
    ("items", "distance", "expected"),
    [
        ([("a", ZEROS), ("b", NEAR), ("c", ONES)], 8, [["a", "b"]]),
        ([("a", ZEROS), ("b", ZEROS), ("c", ONES)], 0, [["a", "b"]]),
        ([("a", ZEROS), ("b", NEAR)], 0, []),
        ([("a", ZEROS)], 8, []),
        ([], 8, []),
    ],
)
def test_groups_within_distance(spark, items, distance, expected):
    labels = hamming.hash_groups(hashed(spark, items), "id", "h", distance)
    assert groups_of(merge.at_least_two(labels)) == expected


def test_hex_round_trip(spark):
    rows = hashed(spark, [("a", ZEROS), ("b", "8000000000000001"), ("c", ONES)])
    assert {r["x"] for r in rows.select(hex_hash(F.col("h")).alias("x")).collect()} == {ZEROS, "8000000000000001", ONES}


@pytest.mark.parametrize("few", [0, hamming.FEW])
@pytest.mark.parametrize("distance", [0, 3, 4, 8, 11])
def test_pairs_equal_brute_force(spark, distance, few):
    draw = random.Random(distance)
    base = [draw.getrandbits(64) for _ in range(40)]
    values = base + [b ^ sum(1 << i for i in draw.sample(range(64), draw.randint(0, 12))) for b in base for _ in range(3)]
    signed = [int(np.uint64(v).view(np.int64)) for v in values]
    rows = spark.createDataFrame(list(enumerate(signed)), "id long, h long")
    found = {(r["a"], r["b"], r["dist"]) for r in hamming.class_pairs(hamming.hash_classes(rows, "id", "h"), distance, few).collect()}
    first = {}
    for i, v in enumerate(values):
        first.setdefault(v, i)
    reps = sorted((i, v) for v, i in first.items())
    assert found == {(i, j, (v ^ w).bit_count()) for i, v in reps for j, w in reps if i < j and (v ^ w).bit_count() <= distance}


@pytest.mark.parametrize("few", [0, hamming.FEW])
def test_tiles_lose_and_repeat_no_pair(spark, monkeypatch, few):
    monkeypatch.setattr(hamming, "LEAST_TILE", 30)
    monkeypatch.setattr(hamming, "AT_ONCE", 500)  # candidates come in several parts
    draw = random.Random(9)
    values = list({b ^ sum(1 << i for i in draw.sample(range(64), draw.randint(0, 9))) for b in (0, (1 << 63) + 77) for _ in range(100)})
    rows = spark.createDataFrame([(i, int(np.uint64(v).view(np.int64))) for i, v in enumerate(values)], "id long, h long")
    classes = hamming.hash_classes(rows, "id", "h")
    found = sorted(tuple(r) for r in hamming.class_pairs(classes, 8, few).collect())
    pairs = sorted((i, j, (v ^ w).bit_count()) for i, v in enumerate(values) for j, w in enumerate(values) if i < j and (v ^ w).bit_count() <= 8)
    assert found == pairs
    root = list(range(len(values)))
    for a, b, _ in pairs:
        x, y = sorted((root[a], root[b]))
        root = [x if r == y else r for r in root]
    labels = {r["id"]: r["component"] for r in connected_components(hamming.class_forest(classes, 8, few)).collect()}
    assert [labels.get(i, i) for i in range(len(values))] == root


def test_groups_write_forests_instead_of_all_pairs(spark):
    """The links of a large group are not written, as they are with its square."""
    rows = spark.createDataFrame([(i, sum(1 << (8 * k + d) for k, d in enumerate((i % 8, i // 8 % 8, i // 64)))) for i in range(512)], "id long, h long")
    assert hamming.class_pairs(hamming.hash_classes(rows, "id", "h"), 8).count() == 512 * 511 // 2
    edges = hamming.hash_edges(rows, "id", "h", 8)
    assert edges.count() == 511
    assert {r["component"] for r in connected_components(edges).collect()} == {0}


@pytest.mark.parametrize("least", [20, hamming.LEAST_TILE])
def test_union_edges_join_what_any_hash_links(spark, monkeypatch, least):
    """With copies, one hash or both unknown, and a value that fills one column."""
    monkeypatch.setattr(hamming, "LEAST_TILE", least)
    draw = random.Random(2)
    near = lambda b, n: b ^ sum(1 << i for i in draw.sample(range(60), draw.randint(0, n)))
    rows = [(i, near(draw.choice((0, (1 << 60) - 1, 0xF0F0F0F0F0F0)), 12), near(draw.getrandbits(60), 0) if i % 4 else 7) for i in range(150)]
    rows += [(200 + i, rows[i][1] if i % 3 else None, rows[i][2] if i % 5 else None) for i in range(30)]
    distances = {"x": 5, "y": 3}
    root = {i: i for i, _, _ in rows}
    for i, x, y in rows:
        for j, u, v in rows:
            if any(a is not None and b is not None and (a ^ b).bit_count() <= d for a, b, d in ((x, u, 5), (y, v, 3))):
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    edges = hamming.union_edges(spark.createDataFrame(rows, "id long, x long, y long"), "id", distances)
    found = {r["id"]: r["component"] for r in connected_components(edges).collect()}
    assert len(set(root.values())) > 3 and {i: found.get(i, i) for i in root} == root


def test_classes_of_one_label_do_not_meet(monkeypatch):
    draw, n = np.random.default_rng(8), 12_000
    h = draw.integers(0, 1 << 20, n, dtype=np.uint64) | (draw.integers(0, 16, n, dtype=np.uint64) // 15 << 40) * np.uint64((1 << 20) - 1)
    met, real = [], hamming.near_pairs
    monkeypatch.setattr(hamming, "near_pairs", lambda a, b, *more: met.append(len(a) * len(b)) or real(a, b, *more))
    rows = np.arange(n)
    root = hamming._linked(h, rows, rows, rows, rows.copy(), 5, hamming.FEW)
    plain = hamming._joined(rows.copy(), ((i, j) for i, j, _ in hamming._all_pairs(h, h, 5)))
    assert (root == plain).all() and len(np.unique(root)) > 1 and sum(met) < 0.4 * n * n / 2


def labelled(spark, groups, universe="abcde"):
    label = {x: min(g) for g in groups for x in g}
    return spark.createDataFrame([(x, label.get(x, x)) for x in universe], "id string, label string")


@pytest.mark.parametrize(
    ("a", "b", "strategy", "expected"),
    [
        (["ab", "de"], ["bc", "de"], "union", ["abc", "de"]),
        (["ab"], ["cd"], "union", ["ab", "cd"]),
        (["abc", "de"], ["ab", "cde"], "intersection", ["ab", "de"]),
        (["ab"], ["cd"], "intersection", []),
        (["abc"], ["abc"], "intersection", ["abc"]),
        (["abc"], ["ac"], "intersection", ["ac"]),
    ],
)
def test_merging(spark, a, b, strategy, expected):
    merged = merge.merge_groups([labelled(spark, a), labelled(spark, b)], strategy)
    assert groups_of(merged) == [sorted(g) for g in expected]


def test_one_set_and_none(spark):
    assert groups_of(merge.merge_groups([labelled(spark, ["ab"])], "union")) == [["a", "b"]]
    with pytest.raises(ValueError, match="no groups"):
        merge.merge_groups([], "union")


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_union_find(spark, seed):
    draw = random.Random(seed)
    edges = [(draw.randrange(80), draw.randrange(80)) for _ in range(20 + 40 * seed)] + [(i, i + 1) for i in range(200, 240)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        return x if parent[x] == x else find(parent[x])

    for a, b in edges:
        if a != b:
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    found = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert found == {x: find(x) for x in parent}


def test_components_of_nothing_and_loops(spark):
    assert connected_components(spark.createDataFrame([(1, 1), (None, 2)], "src long, dst long")).count() == 0


def brute_first_fit(order, accepts):
    clusters = []
    for x in order:
        for c in clusters:
            if all(accepts(y, x) for y in c):
                c.append(x)
                break
        else:
            clusters.append([x])
    return sorted(map(tuple, clusters))


def test_greedy_clusters_follow_input_order(spark):
    draw = random.Random(5)
    linked = {(g, i, j) for g in range(6) for i in range(8) for j in range(i + 1, 8) if draw.random() < 0.6}
    members = spark.createDataFrame([(g, i) for g in range(6) for i in range(8)], "group_id long, seq long")
    pairs = spark.createDataFrame(sorted(linked), "group_id long, i long, j long")
    got = {}
    for r in clustering.greedy_clusters(members, pairs, ["group_id"]).collect():
        got.setdefault(r["group_id"], {}).setdefault(r["cluster"], []).append(r["seq"])
    for g in range(6):
        expected = brute_first_fit(range(8), lambda a, b, g=g: (g, a, b) in linked)
        assert sorted(tuple(sorted(c)) for c in got[g].values()) == expected


def test_components_that_are_stars_take_no_round(spark, monkeypatch):
    """A whole round of joins used to confirm that nothing was left to do."""
    stored = []
    store = components.materialise
    monkeypatch.setattr(components, "materialise", lambda df, name: stored.append(name) or store(df, name))
    edges = [(v, 10 * (v // 10)) for v in range(100)]
    found = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert found == {v: 10 * (v // 10) for v in range(100)}
    assert len(stored) == 1
