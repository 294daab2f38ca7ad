"""What two rasters' scores can be at most, from a few numbers of each.

With the means m and deviations s of the 8 x 8 windows, a window's SSIM is at
most (2 m m' + c1)(2 s s' + c2) / ((m^2 + m'^2 + c1)(s^2 + s'^2 + c2)), as no
covariance exceeds s s'.  With A = asinh(s / sqrt(c2 / 2)) the second factor is
at most 1 / cosh(A - A'), and likewise the first for m and c1.  The least
concave curve above 1 / cosh turns a mean over windows into one of the mean
difference, so pairs at or above a threshold differ by at most ``reach`` in the
raster's mean A: a band join loses none of them.

The squared error of two rasters is at least that of their block means, and
that at least the squared difference of their means.
"""

from __future__ import annotations

from math import acosh, asinh, cosh, isqrt, sqrt, tanh

import numpy as np
import pyspark.sql.functions as F
from pyspark.sql import Column

from kindred.operators import hashing
from kindred.operators.clustering import Verifier
from kindred.operators.firstfit import Links, Rows
from kindred.operators.hamming import hits

C1, C2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
ROUNDING = 1e-9


def reach(threshold: float, top: float) -> float | None:
    """Largest mean difference at which a mean of 1 / cosh can be ``threshold``; differences are at most ``top``."""
    end = 1 / cosh(top)
    if threshold <= end:
        return None
    if threshold >= 1:
        return ROUNDING
    low, high = 0.0, top  # where the line to the end touches the curve
    for _ in range(80):
        mid = (low + high) / 2
        below = 1 / cosh(mid) - end < tanh(mid) / cosh(mid) * (top - mid)
        low, high = (low, mid) if below else (mid, high)
    at = 1 / cosh(low)
    return (acosh(1 / threshold) if threshold >= at else low + (at - threshold) / (tanh(low) / cosh(low))) + ROUNDING


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)


def window_statistics(grey: Column) -> Column:
    """mean and dev of every window, and the means of their inverse hyperbolic sines."""
    total = lambda w: F.aggregate(w, F.lit(0).cast("long"), lambda s, v: s + v.cast("long")).cast("double")
    squares = lambda w: F.aggregate(w, F.lit(0).cast("long"), lambda s, v: s + v.cast("long") * v.cast("long")).cast("double")
    pairs = F.transform(hashing.windows(grey), lambda w: F.struct((total(w) / F.size(w)).alias("m"), (squares(w) / F.size(w)).alias("q")))
    mean = F.transform(pairs, lambda p: p["m"])
    dev = F.transform(pairs, lambda p: F.sqrt(F.greatest(F.lit(0.0), p["q"] - p["m"] * p["m"])))
    return F.struct(mean.alias("mean"), dev.alias("dev"), _mean(F.transform(mean, lambda m: F.asinh(m / sqrt(C1 / 2)))).alias("light"), _mean(F.transform(dev, lambda s: F.asinh(s / sqrt(C2 / 2)))).alias("texture"))


def ssim_at_most(a: Column, b: Column) -> Column:
    """No less than the SSIM of the rasters with these statistics."""
    light = F.zip_with(a["mean"], b["mean"], lambda x, y: (2 * x * y + C1) / (x * x + y * y + C1))
    texture = F.zip_with(a["dev"], b["dev"], lambda x, y: (2 * x * y + C2) / (x * x + y * y + C2))
    return _mean(F.zip_with(light, texture, lambda x, y: x * y)) + ROUNDING


def ssim_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``hashing.ssim`` of all rasters of a with all of b, to the bit: sums are whole numbers, the rest in the same order."""
    side, one = isqrt(a.shape[1]), hashing.SIDE
    across, size = side // one, one * one
    total = np.zeros((len(a), len(b)))
    for k in range(across * across):
        y, x = k // across * one, k % across * one
        u, v = (w.reshape(-1, side, side)[:, y : y + one, x : x + one].reshape(-1, size) for w in (a, b))
        (mu, qu), (mv, qv) = ((w.sum(axis=1) / size, (w * w).sum(axis=1) / size) for w in (u, v))
        both = mu[:, None] * mv
        cov = u @ v.T / size - both
        light = (mu * mu)[:, None] + mv * mv + C1
        total += ((2 * mu[:, None] * mv + C1) * (2 * cov + C2)) / (light * ((qu - mu * mu)[:, None] + (qv - mv * mv) + C2))
    return total / (across * across)


def nmse_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``hashing.nmse`` of all rasters of a with all of b."""
    return ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)) / (a.shape[1] * (255.0 * 255.0))


def ssim_of_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``ssim_matrix`` of single windows, row by row."""
    n = a.shape[1]
    (mu, qu), (mv, qv) = ((w.sum(axis=1) / n, (w * w).sum(axis=1) / n) for w in (a, b))
    cov = (a * b).sum(axis=1) / n - mu * mv
    return ((2 * mu * mv + C1) * (2 * cov + C2)) / ((mu * mu + mv * mv + C1) * ((qu - mu * mu) + (qv - mv * mv) + C2))


def ssim_links(threshold: float) -> Links:
    """Exactly the pairs with an SSIM of at least ``threshold``.

    The factor of the means is 1 - (m - m')^2 / (m^2 + m'^2 + c1).  Without it
    the test of a window is linear in products of the rasters: one product of
    narrow matrices, in single precision, tells all pairs but those within its
    rounding and that factor's reach of the threshold, which are scored.
    """
    window = hashing.SIDE * hashing.SIDE

    def ready(grey: np.ndarray) -> tuple[np.ndarray, ...]:
        if grey.shape[1] != window or not 0 <= threshold <= 1:
            return (grey,)
        mean, spread = np.empty(len(grey)), np.empty(len(grey))
        left, right = np.empty((len(grey), window + 2), np.float32), np.empty((len(grey), window + 2), np.float32)
        for at in range(0, len(grey), 4096):
            r = slice(at, at + 4096)
            values = grey[r].astype(np.float64)
            mean[r] = values.sum(axis=1) / window
            spread[r] = (values * values).sum(axis=1) / window - mean[r] * mean[r]
            centred = (values - mean[r, None]) / hashing.SIDE
            left[r, :window], left[r, window], left[r, window + 1] = 2 * centred, C2 - threshold * (spread[r] + C2), 1
            right[r, :window], right[r, window], right[r, window + 1] = centred, 1, -threshold * spread[r]
        return grey, mean, spread, left, right

    def linked(a: tuple[np.ndarray, ...], i: Rows, b: tuple[np.ndarray, ...], j: Rows) -> np.ndarray:
        exact = lambda: ssim_matrix(a[0][i].astype(np.float64), b[0][j].astype(np.float64)) >= threshold
        if len(a) == 1:
            return exact()
        (mean, spread), (mean_b, spread_b) = ((x[1][r], x[2][r]) for x, r in ((a, i), (b, j)))
        if not len(mean) or not len(mean_b) or not min(low := np.fmin.reduce(mean), low_b := np.fmin.reduce(mean_b)) >= 0:
            return exact()
        size = np.fmax.reduce(spread) + np.fmax.reduce(spread_b)
        unsure = float(1e-5 * (2 * size + C2))  # more than twice what 66 products round
        gap = max(np.fmax.reduce(mean), np.fmax.reduce(mean_b)) - min(low, low_b)
        reached = float(unsure + min(1.0, gap * gap / (low * low + low_b * low_b + C1)) * (size + C2))
        over = a[3][i] @ b[4][j].T
        out = over > reached
        doubt = over >= -unsure
        doubt ^= out
        several = np.count_nonzero(doubt)
        if several > out.size // 16:
            return exact()
        if several:
            x, y = np.divmod(hits(doubt), out.shape[1])
            out[x, y] = ssim_of_pairs(*(v[0][np.arange(len(v[0]))[r][z]].astype(np.float64) for v, r, z in ((a, i, x), (b, j, y)))) >= threshold
        return out

    return Links(ready, linked)


def nmse_links(threshold: float) -> Links:
    return Links(lambda grey: (grey.astype(np.float64),), lambda a, i, b, j: nmse_matrix(a[0][i], b[0][j]) <= threshold)


def ssim_verifier(threshold: float) -> Verifier:
    """SSIM of at least ``threshold``."""
    tops = {"light": asinh(255 / sqrt(C1 / 2)), "texture": asinh(127.5 / sqrt(C2 / 2))}
    bands = tuple((lambda f, n=name: f[n], width) for name, top in tops.items() if (width := reach(threshold, top)) is not None)
    return Verifier(hashing.ssim, lambda s: s >= threshold, window_statistics, lambda a, b: ssim_at_most(a, b) >= threshold, bands, ssim_links(threshold))


def block_means(grey: Column) -> Column:
    """Means of the 8 x 8 blocks and of the whole raster."""
    blocks = F.transform(hashing.windows(grey), lambda w: F.aggregate(w, F.lit(0).cast("long"), lambda s, v: s + v.cast("long")) / F.size(w))
    return F.struct(blocks.alias("blocks"), _mean(blocks).alias("mean"))


def nmse_verifier(threshold: float) -> Verifier:
    """Mean squared error over 255 squared of at most ``threshold``."""
    least = lambda a, b: _mean(F.zip_with(a["blocks"], b["blocks"], lambda x, y: (x - y) * (x - y))) / (255.0 * 255.0)
    bands = ((lambda f: f["mean"], 255 * sqrt(threshold) + ROUNDING),) if threshold >= 0 else ()
    return Verifier(hashing.nmse, lambda s: s <= threshold, block_means, lambda a, b: least(a, b) <= threshold + ROUNDING, bands, nmse_links(threshold))
