"""Image kernels: metamorphic relations and direct formulas."""

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
import pytest

from kindred.operators import clustering, hashing
from kindred.plans import scan as scans

DRAW = np.random.default_rng(7)
NOISE = DRAW.integers(0, 256, (6, 64))
GRADIENT = np.tile(np.round(np.arange(8) / 7 * 200), 8).astype(int)
CHECKER = np.array([[255 * ((r + c) % 2) for c in range(8)] for r in range(8)]).reshape(-1)
FLAT = np.full(64, 100)


def frame(spark, images):
    return spark.createDataFrame([(i, [int(v) for v in x]) for i, x in enumerate(images)], "seq long, grey array<int>")


def pairs(spark, images, score):
    rows = frame(spark, images).withColumn("group_id", F.lit(0))
    return {(r["i"], r["j"]): r["score"] for r in clustering.group_pairs(rows, score, ["group_id"]).collect()}


def test_dct_of_ones_and_inverse():
    out = hashing.dct(np.ones((1, 4, 4)))[0]
    assert out[0, 0] == pytest.approx(4)
    assert np.abs(out).sum() == pytest.approx(out[0, 0], abs=1e-9)
    c = hashing.dct_matrix(8)
    assert np.allclose(c @ c.T, np.eye(8))


def test_hashes_are_stable_and_near_for_brighter_images(spark):
    brighter = [np.minimum(255, np.round(x * 1.03)).astype(int) for x in NOISE]
    rows = frame(spark, [*NOISE, *brighter]).select("seq", hashing.difference_hash(F.col("grey")).alias("d"), hashing.perceptual_hash("grey").alias("p")).toPandas().set_index("seq")
    for column, most in (("d", 9), ("p", 8)):
        bits = [(int(rows[column][i]) ^ int(rows[column][i + 6])).bit_count() for i in range(6)]
        assert max(bits) <= most


def test_difference_hash_bits(spark):
    rising = frame(spark, [GRADIENT, GRADIENT[::-1]]).select(hashing.difference_hash(F.col("grey")).alias("h")).toPandas()["h"]
    assert sorted(rising) == [0, (1 << 56) - 1]


def test_kernels_take_whole_image_rasters(spark):
    draw = np.random.default_rng(3)
    square = draw.integers(0, 256, (3, 32 * 32))
    got = frame(spark, [*square, NOISE[0]]).select(hashing.perceptual_hash("grey").alias("h"), hashing.dct_coefficients("grey").alias("c")).toPandas()
    for h, c, x in zip(got["h"], got["c"], [*square, NOISE[0]], strict=True):
        n = int(len(x) ** 0.5)
        k, at = np.arange(8)[:, None], np.arange(n)[None, :]
        cos = np.cos((2 * at + 1) * k * np.pi / (2 * n)) * np.where(k == 0, np.sqrt(1 / n), np.sqrt(2 / n))
        low = (cos @ x.reshape(n, n) @ cos.T).reshape(-1)
        assert np.allclose(c, low, atol=1e-5)
        assert h == int("".join("01"[int(v > low[1:].mean())] for v in low[1:]), 2)
    wide = draw.integers(0, 256, (2, 72))
    hashed = frame(spark, wide).select(hashing.difference_hash(F.col("grey"), 9, 8).alias("h")).toPandas()["h"]
    for h, x in zip(hashed, wide.reshape(2, 8, 9), strict=True):
        assert int(h) % (1 << 64) == int("".join("01"[v] for v in (x[:, :-1] < x[:, 1:]).reshape(-1).astype(int)), 2)
    a, b = (draw.integers(0, 256, 256 * 256) // 2 + np.arange(256 * 256) // 600 for _ in range(2))
    each = []
    for x, y in zip(*(v.reshape(32, 8, 32, 8).swapaxes(1, 2).reshape(-1, 64) for v in (a, b)), strict=True):
        cov = (x * y).mean() - x.mean() * y.mean()
        each.append((2 * x.mean() * y.mean() + 6.5025) * (2 * cov + 58.5225) / ((x.mean() ** 2 + y.mean() ** 2 + 6.5025) * (x.var() + y.var() + 58.5225)))
    assert pairs(spark, [a, b], hashing.ssim)[0, 1] == pytest.approx(np.mean(each))


def test_ssim_and_nmse(spark):
    near = np.minimum(255, NOISE[0] + 3)
    images = [NOISE[0], NOISE[0], near, GRADIENT]
    s, n = pairs(spark, images, hashing.ssim), pairs(spark, images, hashing.nmse)
    assert s[0, 1] == pytest.approx(1)
    assert s[0, 2] > 0.8
    assert s[0, 3] < 0.5
    assert n[0, 1] == 0
    assert n[0, 3] == pytest.approx(((NOISE[0] - GRADIENT) ** 2).mean() / 255**2)


def test_quality(spark):
    rows = frame(spark, [CHECKER, GRADIENT, FLAT, NOISE[0]]).select(hashing.quality(F.col("grey")).alias("q")).toPandas()["q"]
    g = NOISE[0].reshape(8, 8)
    lap = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]
    assert rows[3] == pytest.approx(round(100 * (1 - np.exp(-lap.var() / 500)), 2))
    assert rows[0] > rows[1]
    assert rows[2] == 0
    assert rows.between(0, 100).all()


def test_scan_finds_copies_and_picks_the_first_best(spark):
    images = [NOISE[0], NOISE[1], NOISE[0], np.minimum(255, NOISE[1] + 2), NOISE[2], CHECKER]
    rows = frame(spark, images).unionByName(spark.createDataFrame([(99, None)], "seq long, grey array<int>"))
    for preset in scans.PRESETS.values():
        found = scans.scan(rows, preset).toPandas()
        groups = {g: sorted(x["member"]) for g, x in found.groupby("group_id")}
        assert groups == {0: [0, 2], 1: [1, 3]}
        assert found[found["is_master"]].groupby("group_id").size().eq(1).all()
        assert set(found[found["is_master"] & (found["group_id"] == 0)]["member"]) == {0}


def test_presets_and_registry():
    assert all(scans.detect_preset(p) == n for n, p in scans.PRESETS.items())
    assert scans.detect_preset(scans.Preset((), {}, "union", (), {})) == "custom"
    assert [a.id for a in scans.resolve(("dhash", "nope"), scans.HASHES)] == ["dhash"]
    with pytest.raises(ValueError, match="no hash"):
        scans.scan(None, scans.Preset(("nope",), {}, "union", (), {}))


def test_verifier_chain_drops_small_clusters(spark):
    images = [NOISE[0], NOISE[0], NOISE[0] // 2, CHECKER]
    rows = frame(spark, images).withColumn("group_id", F.lit(1))
    chain = [(hashing.ssim, lambda s: s >= 0.3), (hashing.nmse, lambda s: s <= 0.01)]
    found = clustering.verify(rows, chain).toPandas()
    assert isinstance(found, pd.DataFrame)
    assert sorted(found["seq"]) == [0, 1]
