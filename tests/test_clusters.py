"""Rounds of first fit, bounds of scores and whole scans against plain loops."""

import random

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import pytest

from kindred.operators import bounds, clustering, firstfit, hashing
from kindred.queries import similarity
from tests.helpers import SF


def first_fit(order, linked):
    """The sequential rule: cluster numbers of items in order."""
    clusters, out = [], {}
    for x in order:
        home = next((k for k, c in enumerate(clusters) if all((y, x) in linked for y in c)), len(clusters))
        if home == len(clusters):
            clusters.append([])
        clusters[home].append(x)
        out[x] = home
    return out


def found_clusters(spark, items, links, small):
    members = spark.createDataFrame(items, "g string, seq long")
    accepted = spark.createDataFrame(links, "g string, i long, j long")
    return {(r.g, r.seq): r.cluster for r in clustering.greedy_clusters(members, accepted, ["g"], small=small).collect()}


@pytest.mark.parametrize("small", [0, 25])
def test_rounds_and_fold_equal_first_fit_on_random_graphs(spark, small):
    draw = random.Random(11)
    items, links, expected = [], [], {}
    for g, (n, p) in enumerate([(1, 0), (2, 1), (20, 0.2), (20, 0.5), (30, 0.8), (30, 0.95), (40, 0.3), (26, 1)]):
        order = sorted(draw.sample(range(1000), n))
        linked = {(a, b) for a in order for b in order if a < b and draw.random() < p}
        items += [(f"g{g}", x) for x in order]
        links += [(f"g{g}", a, b) for a, b in linked]
        expected |= {(f"g{g}", x): c for x, c in first_fit(order, linked).items()}
    assert found_clusters(spark, items, links, small) == expected


def test_a_chain_waits_for_itself(spark):
    linked = {(i, i + 1) for i in range(7)}
    expected = {("a", x): c for x, c in first_fit(range(8), linked).items()}
    assert found_clusters(spark, [("a", i) for i in range(8)], [("a", *x) for x in linked], 0) == expected


def test_no_members_no_clusters(spark):
    assert found_clusters(spark, [], [], 0) == {}


def test_one_group_of_a_hundred_thousand_members(spark):
    # Cliques of four strung together by one link each: no task sees the group.
    n = 100_000
    members = spark.range(n).select(F.lit(1).alias("g"), F.col("id").alias("seq"))
    inside = spark.range(n).select(F.col("id").alias("i"), F.explode(F.sequence(F.col("id") + 1, F.floor(F.col("id") / 4) * 4 + 3)).alias("j")).where("j > i and j <= floor(i / 4) * 4 + 3")
    across = spark.range(0, n - 8, 8).select((F.col("id") + 3).alias("i"), (F.col("id") + 4).alias("j"))
    found = clustering.greedy_clusters(members, inside.unionByName(across).withColumn("g", F.lit(1)), ["g"])
    assert found.where(F.col("cluster") == F.floor(F.col("seq") / 4)).count() == n


def rasters(side, n, seed):
    """Rasters of many kinds: smooth ones, noise of several strengths, near copies, flat ones."""
    draw = np.random.default_rng(seed)
    x, y = np.meshgrid(np.arange(side), np.arange(side))
    out = []
    for k in range(n):
        base = draw.integers(0, 256) + draw.normal(0, draw.choice([0, 2, 10, 60]), (side, side)) + draw.choice([0, 3]) * (x - y)
        if k % 3 == 2:
            base = out[-1] + draw.normal(0, 3, (side, side))
        if k % 11 == 10:
            base = out[-2]
        out.append(base.clip(0, 255).astype(int))
    return out


def plain_ssim(a, b):
    scores = []
    for r in range(0, a.shape[0] - 7, 8):
        for c in range(0, a.shape[1] - 7, 8):
            u, v = a[r : r + 8, c : c + 8].astype(float), b[r : r + 8, c : c + 8].astype(float)
            cov = (u * v).mean() - u.mean() * v.mean()
            scores.append((2 * u.mean() * v.mean() + 6.5025) * (2 * cov + 58.5225) / ((u.mean() ** 2 + v.mean() ** 2 + 6.5025) * (u.var() + v.var() + 58.5225)))
    return float(np.mean(scores))


def plain_nmse(a, b):
    return float(((a - b) ** 2).mean() / 255**2)


@pytest.mark.parametrize(("side", "limit", "kind", "share"), [(8, 0.82, "ssim", 0.35), (16, 0.5, "ssim", 0.45), (24, 0.9, "ssim", 0.35), (16, 0.004, "nmse", 0.35), (8, 0.0, "nmse", 0.02)])
def test_bounds_lose_no_pair_and_spare_scores(spark, side, limit, kind, share):
    images = rasters(side, 60, side)
    items = spark.createDataFrame([(1, i, g.ravel().tolist()) for i, g in enumerate(images)], "group_id long, seq long, grey array<int>")
    verifier = bounds.ssim_verifier(limit) if kind == "ssim" else bounds.nmse_verifier(limit)
    passes = (lambda a, b: plain_ssim(a, b) >= limit) if kind == "ssim" else (lambda a, b: plain_nmse(a, b) <= limit)
    linked = {(i, j) for i in range(60) for j in range(i + 1, 60) if passes(images[i], images[j])}
    candidates = {(r.i, r.j) for r in clustering.candidate_pairs(items, verifier, ["group_id"]).collect()}
    assert linked <= candidates and len(candidates) < share * 60 * 59 / 2
    assert {(r.i, r.j) for r in clustering.linked_pairs(items, verifier, ["group_id"]).collect()} == linked
    found = {r.seq: r.cluster for r in clustering.clustered(items, verifier, ["group_id"]).collect()}
    assert found == first_fit(range(60), linked)


def test_copies_are_one_class_unless_they_fail_the_test(spark):
    rows = [(1, i, [i % 3 * 40] * 64) for i in range(3000)]
    items = spark.createDataFrame(rows, "group_id long, seq long, grey array<int>")
    known = clustering.classes(items, bounds.ssim_verifier(0.9), ["group_id"])
    assert known.select("first").distinct().count() == 3
    assert {r.seq: r.cluster for r in clustering.clustered(items, bounds.ssim_verifier(0.9), ["group_id"]).collect()} == {i: i % 3 for i in range(3000)}
    never = clustering.Verifier(hashing.nmse, lambda s: s < 0)
    few = items.where("seq < 9")
    assert {r.seq: r.cluster for r in clustering.clustered(few, never, ["group_id"]).collect()} == {i: i for i in range(9)}


def test_reach_is_where_the_bound_meets_the_threshold():
    assert bounds.reach(0.01, 3.0) is None and bounds.reach(1.0, 3.0) < 1e-6
    draw = random.Random(2)
    for _ in range(2000):
        top, n = draw.uniform(0.5, 6), draw.randint(1, 6)
        gaps = [draw.choice([0, draw.uniform(0, top), top]) for _ in range(n)]
        limit = sum(1 / np.cosh(g) for g in gaps) / n
        far = bounds.reach(limit, top)
        assert far is None or sum(gaps) / n <= far + 1e-6


def test_raster_scan_equals_plain_loops(spark):
    got = {(r.group_id, r.member, r.is_master) for r in similarity.scan_rasters_balanced(spark, SF).collect()}
    grey = {r.seq: np.array(r.grey) for r in similarity._grey(spark, SF).collect()}
    hashes = [{r.seq: r.h for r in similarity.QUERIES[q](spark, SF).collect()} for q in ("phash_8x8", "dhash_8x8")]
    quality = {r.seq: r.quality for r in similarity.laplacian_quality(spark, SF).collect()}
    ids = sorted(grey)
    parent = {x: x for x in ids}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for h in hashes:
        for i in ids:
            for j in ids:
                if i < j and ((h[i] ^ h[j]) & (1 << 64) - 1).bit_count() <= 14:
                    a, b = sorted((top(i), top(j)))
                    parent[b] = a
    expected = set()
    for root in {top(x) for x in ids}:
        group = [x for x in ids if top(x) == root]
        linked = {(a, b) for a in group for b in group if a < b and plain_ssim(grey[a].reshape(8, 8), grey[b].reshape(8, 8)) >= 0.1}
        homes = first_fit(group, linked)
        for c in set(homes.values()):
            members = [x for x in group if homes[x] == c]
            best = min(members, key=lambda x: (-quality[x], x))
            expected |= {(members[0], x, x == best) for x in members if len(members) >= 2}
    assert expected and got == expected


@pytest.mark.parametrize(("keep", "threshold"), [(2, 0.3), (64, 0.05)])
def test_blocks_of_a_large_group_equal_first_fit(spark, monkeypatch, keep, threshold):
    """Groups above the bound go block by block and their links, a square of the members, are never asked for."""
    monkeypatch.setattr(firstfit, "BLOCK", 20)
    monkeypatch.setattr(firstfit, "KEEP", keep)
    draw = np.random.default_rng(3)
    grey = draw.integers(90, 160, (90, 64))
    grey[40:60] = grey[:20] + draw.integers(-9, 9, (20, 64))
    rows = [(g, 2 * i + g, grey[(i * (g + 1)) % 90].tolist()) for g in (0, 1) for i in range(90 if not g else 45)]
    members = spark.createDataFrame(rows, "group_id long, seq long, grey array<int>")
    verifier = bounds.ssim_verifier(threshold)
    asked = []
    real = clustering.linked_pairs
    monkeypatch.setattr(clustering, "linked_pairs", lambda *a: asked.append(real(*a)) or asked[-1])
    got = {(r.group_id, r.seq): r.cluster for r in clustering.clustered(members, verifier, ["group_id"], small=50).collect()}
    assert asked[0].where("group_id = 0").isEmpty()
    scores = {g: bounds.ssim_matrix(*[np.array([r[2] for r in rows if r[0] == g], float)] * 2) for g in (0, 1)}
    plain = {(r.group_id, r.i, r.j): r.score for r in clustering.group_pairs(members, hashing.ssim, ["group_id"]).collect()}
    for g in (0, 1):
        order = [r[1] for r in rows if r[0] == g]
        assert all(scores[g][a, b] == plain[g, x, y] for a, x in enumerate(order) for b, y in enumerate(order) if a < b)
        linked = {(x, y) for h, x, y in plain if h == g and plain[h, x, y] >= threshold}
        assert {s: c for (h, s), c in got.items() if h == g} == first_fit(order, linked)


@pytest.mark.parametrize("threshold", [0.0, 0.05, 0.1, 0.5, 0.9, 1.0, None])
def test_links_by_one_product_are_the_scores_test(threshold):
    """Also where a score is the threshold, and in pairs of very unlike brightness."""
    draw = np.random.default_rng(9)
    grey = np.array([x.ravel() for x in rasters(8, 150, 4)] + [draw.integers(110, 146, 64) for _ in range(150)], np.int32)
    scores = bounds.ssim_matrix(grey.astype(float), grey.astype(float))
    for at in [threshold] if threshold is not None else scores[160, 170:180].clip(0, 1):
        links = bounds.ssim_links(float(at))
        ready = links.ready(grey)
        assert len(ready) > 1
        for i, j in ((slice(0, 300), slice(0, 300)), (slice(150, 300), np.arange(150, 300)), (np.arange(0, 300, 7), slice(140, 190)), (np.arange(0), slice(0, 9))):
            assert (links.linked(ready, i, ready, j) == (scores[i][:, j] >= at)).all()
    sides = [firstfit._Side(bounds.ssim_links(0.1), pa.chunked_array([pa.array([x.ravel().tolist() for x in given], pa.list_(pa.int32()))])) for given in (rasters(8, 5, 1) + rasters(16, 4, 2), rasters(16, 3, 2))]
    got = sides[0].linked(slice(0, 9), sides[1], np.arange(3))
    wide = [np.array([x.ravel() for x in rasters(16, n, 2)], float) for n in (4, 3)]
    assert not got[:5].any() and (got[5:] == (bounds.ssim_matrix(*wide) >= 0.1)).all()


def test_most_members_of_large_clusters_are_not_met():
    """Items are shut out early, and a block's items fill known clusters without meeting each other all."""
    draw = np.random.default_rng(5)
    grey = np.floor(draw.normal(0, 8, (6000, 64)) + 128).astype(np.int32)
    links, met = bounds.ssim_links(0.1), []

    def linked(a, i, b, j):
        out = links.linked(a, i, b, j)
        met.append(out.size)
        return out

    side = firstfit._Side(firstfit.Links(links.ready, linked), pa.chunked_array([pa.array(grey.tolist(), pa.list_(pa.int32()))]))
    none = np.zeros(0, np.int64)
    homes, places, decided = firstfit._in_turn(np.arange(6000), (none, none, none), side, 64)
    assert decided == 6000 and sum(met) < 0.6 * 6000 * 6000 / 2
    found = ~bounds.ssim_links(0.1).linked(*(side.ready[64], slice(0, 6000)) * 2)
    for seed in np.unique(homes):
        members = np.flatnonzero(homes == seed)
        assert members[0] == seed and (places[members] == np.arange(len(members))).all() and not np.triu(found[np.ix_(members, members)], 1).any()
        later = np.flatnonzero((homes > seed) & (np.arange(6000) > seed))  # each was shut out by an earlier member
        assert (found[np.ix_(later, members)] & (members < later[:, None])).any(axis=1).all()


def test_a_group_of_nine_thousand_takes_one_turn(spark, monkeypatch):
    draw = np.random.default_rng(6)
    grey = np.floor(draw.normal(0, 8, (9000, 64)) + 128).astype(int)
    items = spark.createDataFrame([(1, i, x.tolist()) for i, x in enumerate(grey)], "_g int, seq long, grey array<int>")
    stored, real = [], firstfit.materialise
    monkeypatch.setattr(firstfit, "materialise", lambda df, name: stored.append(name) or real(df, name))
    assert firstfit.first_fit(items, bounds.ssim_links(0.1)).count() == 9000 and stored.count("placed") == 1
