"""Numpy kernels behind grouped maps: what iterates, or needs a Fourier transform."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: The range of profile indices that a mixture is made for, and the factor of the grid beyond the stamp in Fourier rendering.
LEAST_INDEX, MOST_INDEX = 0.29, 6.3
PAD = 2


def power_of_two(size: float) -> int:
    return 1 << max(0, math.ceil(math.log2(max(size, 1.0))))


def embedded(stamp: np.ndarray, size: int) -> np.ndarray:
    """A stamp in the middle of a square grid, padded or cropped about its centre."""
    out = np.zeros((size, size))
    h, w = stamp.shape
    y0, x0 = size // 2 - h // 2, size // 2 - w // 2
    ys, xs = slice(max(0, y0), min(size, y0 + h)), slice(max(0, x0), min(size, x0 + w))
    out[ys, xs] = stamp[ys.start - y0 : ys.stop - y0, xs.start - x0 : xs.stop - x0]
    return out


def transform(stamp: np.ndarray, size: int) -> np.ndarray:
    """Half-plane Fourier transform with the stamp's centre at the origin."""
    return np.fft.rfft2(np.fft.ifftshift(embedded(stamp, size)))


def _frequencies(size: int) -> tuple[np.ndarray, np.ndarray]:
    return np.fft.rfftfreq(size)[None, :], np.fft.fftfreq(size)[:, None]


def point_source(psf: np.ndarray, x: float, y: float, height: int, width: int, flux: float = 1.0) -> np.ndarray:
    """A stamp moved to a position by a phase, on a padded grid, so nothing wraps around."""
    size = power_of_two(PAD * max(height, width, *psf.shape))
    v, w = _frequencies(size)
    phase = np.exp(-2j * np.pi * (v * x + w * y))
    return flux * np.fft.irfft2(transform(psf, size) * phase, s=(size, size))[:height, :width]


def galaxy(psf: np.ndarray, amps: np.ndarray, covs: np.ndarray, x: float, y: float, height: int, width: int, flux: float = 1.0) -> np.ndarray:
    """The analytic transform of a mixture (amps, covs (k, 3) of xx, xy, yy in pixels) times the stamp's."""
    size = power_of_two(PAD * max(height, width, *psf.shape))
    v, w = _frequencies(size)
    shape = sum(a * np.exp(-2 * np.pi**2 * (c[0] * v * v + 2 * c[1] * v * w + c[2] * w * w)) for a, c in zip(amps, covs, strict=True))
    return flux * np.fft.irfft2(transform(psf, size) * shape * np.exp(-2j * np.pi * (v * x + w * y)), s=(size, size))[:height, :width]


def non_negative(a: np.ndarray, b: np.ndarray, rounds: int = 3000) -> np.ndarray:
    """Least squares with x >= 0, by accelerated projected gradients."""
    g, h = a.T @ a, a.T @ b
    step = 1.0 / max(np.linalg.eigvalsh(g).max(), 1e-300)
    x = z = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, z - step * (g @ z - h))
        t, before = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        z, x = new + (before - 1) / t * (new - x), new
    return x


@lru_cache(512)
def sersic_mixture(n: float, components: int = 8, core: float = 0.01, beyond: float = 0.0) -> tuple[tuple[float, float], ...]:
    """(amplitude, variance) of a profile of index n at unit effective radius.

    The rule: variances evenly spaced in the logarithm, amplitudes by non-negative
    least squares on the flux in rings out to eight radii; they sum to 1, less what
    lies beyond.  Above index 1 a core of variance 0 holds a share.
    """
    n = min(max(n, LEAST_INDEX), MOST_INDEX)
    r = np.linspace(0.0, 8.0, 1601)
    mid = (r[1:] + r[:-1]) / 2
    b = 2 * n - 1 / 3 + 4 / (405 * n)
    if n < 0.5:  # where the series fails: half the flux inside unit radius, by bisection
        lo, hi = 1e-3, 2.0
        for _ in range(60):
            b = (lo + hi) / 2
            f = np.exp(-b * mid ** (1 / n)) * mid
            lo, hi = (b, hi) if f[mid < 1].sum() < 0.5 * f.sum() else (lo, b)
    ring = np.exp(-b * (mid ** (1 / n) - 1)) * mid * np.diff(r)
    ring /= ring.sum()
    variances = np.geomspace(4e-4 if n > 1 else 2e-2, 0.9 if n < 0.5 else 2.5 if n < 1.5 else 9.0, components)
    share = np.exp(-r[:-1, None] ** 2 / (2 * variances)) - np.exp(-r[1:, None] ** 2 / (2 * variances))
    blocks = np.add.reduceat(np.column_stack([ring, share]), np.arange(0, 1600, 20), axis=0)
    amps = non_negative(blocks[:, 1:], blocks[:, 0])
    core = core if n > 1 else 0.0
    amps *= (1.0 - core - beyond) / amps.sum()
    out = [(float(a), float(v)) for a, v in zip(amps, variances, strict=True) if a > 0]
    return tuple([*out, (core, 0.0)] if core else out)


def sersic_mixtures(indices: DataFrame, kinds: dict[str, float]) -> DataFrame:
    """kind, n, k, amp, var: of each different index n, the mixture of each kind (its share beyond). Made where the indices are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(kind, n, k, a, v) for n in batch.n for kind, beyond in kinds.items() for k, (a, v) in enumerate(sersic_mixture(n, beyond=beyond))]
            yield pd.DataFrame(rows, columns=["kind", "n", "k", "amp", "var"])

    return indices.select("n").where("n is not null and not isnan(n)").distinct().mapInPandas(run, "kind string, n double, k int, amp double, var double")


def spline(x: np.ndarray, y: np.ndarray, at: float) -> float:
    """The not-a-knot cubic through the points (a lower degree through fewer than four)."""
    n = len(x)
    if n < 4:
        return float(np.polyval(np.polyfit(x - x[0], y, n - 1), at - x[0]))
    h, slope = np.diff(x), np.diff(y) / np.diff(x)
    m = np.zeros((n, n))
    m[0, :3], m[-1, -3:] = (h[1], -(h[0] + h[1]), h[0]), (h[-1], -(h[-2] + h[-1]), h[-2])
    side = np.zeros(n)
    for k in range(1, n - 1):
        m[k, k - 1 : k + 2], side[k] = (h[k - 1], 2 * (h[k - 1] + h[k]), h[k]), 6 * (slope[k] - slope[k - 1])
    c = np.linalg.solve(m, side)
    k = int(np.clip(np.searchsorted(x, at) - 1, 0, n - 2))
    t = at - x[k]
    return float(y[k] + t * (slope[k] - h[k] * (2 * c[k] + c[k + 1]) / 6) + t * t * c[k] / 2 + t**3 * (c[k + 1] - c[k]) / (6 * h[k]))


def tabled_mixture(n: float, table: list[tuple[list[float], list[list[float]], list[list[float]]]], core: float = 0.0, beyond: float = 0.0) -> list[tuple[float, float]]:
    """(amplitude, variance) of index n by a user's table: consecutive ranges, each of knots and, a component each, amplitudes and logarithms of variances at them.

    n stops at the table's ends; amplitudes add up to 1 less what lies beyond and, above index 1, the core, a component of variance 0.
    """
    n = min(max(n, table[0][0][0]), table[-1][0][-1])
    knots, amps, logs = next(x for x in table if n <= x[0][-1])
    a = np.array([spline(np.array(knots), np.array(x), n) for x in amps])
    v = np.exp([spline(np.array(knots), np.array(x), n) for x in logs])
    core = core if n > 1 else 0.0
    out = list(zip((a / a.sum() * (1.0 - core - beyond)).tolist(), v.tolist(), strict=True))
    return [*out, (core, 0.0)] if core else out


def fit_mixture(stamp: np.ndarray, components: int, rounds: int = 60) -> np.ndarray:
    """(k, 6): amp, mx, my, vxx, vxy, vyy about the stamp's centre, by expectation maximisation over its positive pixels."""
    h, w = stamp.shape
    y, x = (v.ravel().astype(float) for v in np.mgrid[:h, :w])
    x, y = x - w // 2, y - h // 2
    f = np.maximum(stamp.ravel(), 0.0)
    total = f.sum()
    if total <= 0:
        return np.tile([0.0, 0.0, 0.0, 1.0, 0.0, 1.0], (components, 1))
    f = f / total
    mx, my = f @ x, f @ y
    wide = max(f @ ((x - mx) ** 2 + (y - my) ** 2) / 2, 0.25)
    out = np.array([[1 / components, mx, my, wide * s, 0.0, wide * s] for s in np.geomspace(0.5, 2.0, components)])
    for _ in range(rounds):
        dx, dy = x - out[:, 1:2], y - out[:, 2:3]
        det = np.maximum(out[:, 3] * out[:, 5] - out[:, 4] ** 2, 1e-6)[:, None]
        q = (out[:, 5:6] * dx * dx - 2 * out[:, 4:5] * dx * dy + out[:, 3:4] * dy * dy) / det
        like = out[:, :1] * np.exp(-0.5 * q) / (2 * np.pi * np.sqrt(det))
        share = like / np.maximum(like.sum(0), 1e-300) * f
        amp = np.maximum(share.sum(1), 1e-12)
        out[:, 0], out[:, 1], out[:, 2] = amp, share @ x / amp, share @ y / amp
        dx, dy = x - out[:, 1:2], y - out[:, 2:3]
        out[:, 3] = np.maximum((share * dx * dx).sum(1) / amp, 0.05)
        out[:, 4] = (share * dx * dy).sum(1) / amp
        out[:, 5] = np.maximum((share * dy * dy).sum(1) / amp, 0.05)
    out[:, 0] *= total
    return out[np.lexsort((out[:, 3], -out[:, 0]))]


def _square(pdf: pd.DataFrame, size: int) -> np.ndarray:
    out = np.zeros((size, size))
    out[pdf.y.to_numpy(), pdf.x.to_numpy()] = pdf.value.to_numpy()
    return out


def rendered_points(points: DataFrame, stamps: DataFrame, key: str, stamp: int, height: int, width: int) -> DataFrame:
    """points: key, src_id, x0, y0, flux. src_id, y, x, value of every pixel of the grid."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts = []
        psf = _square(right, stamp)
        ys, xs = (v.ravel().astype(np.int32) for v in np.mgrid[:height, :width])
        for p in left.sort_values("src_id").itertuples():
            image = point_source(psf, p.x0, p.y0, height, width, p.flux)
            parts.append(pd.DataFrame({"src_id": p.src_id, "y": ys, "x": xs, "value": image.ravel()}))
        return pd.concat(parts) if parts else pd.DataFrame({"src_id": pd.Series(dtype="int64"), "y": pd.Series(dtype="int32"), "x": pd.Series(dtype="int32"), "value": pd.Series(dtype=float)})

    return points.groupBy(key).cogroup(stamps.groupBy(key)).applyInPandas(run, "src_id long, y int, x int, value double")


def rendered_galaxies(points: DataFrame, stamps: DataFrame, key: str, stamp: int, height: int, width: int) -> DataFrame:
    """As rendered_points, with sersic, vxx, vxy, vyy (covariance of a unit circle's image in pixels) of each source."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts = []
        psf = _square(right, stamp)
        ys, xs = (v.ravel().astype(np.int32) for v in np.mgrid[:height, :width])
        for p in left.sort_values("src_id").itertuples():
            mixture = np.array(sersic_mixture(round(p.sersic, 3)))
            covs = mixture[:, 1:] * np.array([[p.vxx, p.vxy, p.vyy]])
            image = galaxy(psf, mixture[:, 0], covs, p.x0, p.y0, height, width, p.flux)
            parts.append(pd.DataFrame({"src_id": p.src_id, "y": ys, "x": xs, "value": image.ravel()}))
        return pd.concat(parts) if parts else pd.DataFrame({"src_id": pd.Series(dtype="int64"), "y": pd.Series(dtype="int32"), "x": pd.Series(dtype="int32"), "value": pd.Series(dtype=float)})

    return points.groupBy(key).cogroup(stamps.groupBy(key)).applyInPandas(run, "src_id long, y int, x int, value double")


def fitted_mixtures(stamps: DataFrame, key: str, size: int, components: int) -> DataFrame:
    """key, k, amp, mx, my, vxx, vxy, vyy of each stamp."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fit = fit_mixture(_square(pdf, size), components)
        return pd.DataFrame({key: pdf[key].iloc[0], "k": np.arange(len(fit), dtype=np.int32), **dict(zip(("amp", "mx", "my", "vxx", "vxy", "vyy"), fit.T, strict=True))})

    kind = stamps.schema[key].dataType.simpleString()
    return stamps.groupBy(key).applyInPandas(run, f"{key} {kind}, k int, amp double, mx double, my double, vxx double, vxy double, vyy double")
