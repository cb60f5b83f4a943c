"""Mixtures of Gaussians in two dimensions, as arrays of components or as joined columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Amplitudes and variances of the exponential and the de Vaucouleurs profile at unit effective radius, and the share of the latter's core.
EXP_AMPLITUDES = (2.34853813e-03, 3.07995260e-02, 2.23364214e-01, 1.17949102e00, 4.33873750e00, 5.99820770e00)
EXP_VARIANCES = (1.20078965e-03, 8.84526493e-03, 3.91463084e-02, 1.39976817e-01, 4.60962500e-01, 1.50159566e00)
DEV_AMPLITUDES = (4.26347652e-02, 2.40127183e-01, 6.85907632e-01, 1.51937350e00, 2.83627243e00, 4.46467501e00, 5.72440830e00, 5.60989349e00)
DEV_VARIANCES = (2.23759216e-04, 1.00220099e-03, 4.18731126e-03, 1.69432589e-02, 6.84850479e-02, 2.87207080e-01, 1.33320254e00, 8.40215071e00)
DEV_CORE = 0.010233
#: Least determinant that a density is taken with.
LEAST_DETERMINANT = 1e-12


def profile(kind: str) -> list[tuple[float, float]]:
    """(amplitude, variance) of a profile, summing to 1; a core has variance 0."""
    if kind == "gauss":
        return [(1.0, 1.0)]
    amps, variances, core = (EXP_AMPLITUDES, EXP_VARIANCES, 0.0) if kind == "exp" else (DEV_AMPLITUDES, DEV_VARIANCES, DEV_CORE)
    total = math.fsum(amps)
    out = [(a / total * (1.0 - core), v) for a, v in zip(amps, variances, strict=True)]
    return [*out, (core, 0.0)] if core else out


def literal(kind: str) -> Column:
    """array<struct<amp,var>> of a profile."""
    return F.array(*(F.struct(F.lit(a).alias("amp"), F.lit(v).alias("var")) for a, v in profile(kind)))


def density(dx: Column, dy: Column, vxx: Column, vxy: Column, vyy: Column) -> Column:
    """Of a unit Gaussian at an offset from its mean; the determinant has a floor."""
    det = F.greatest(F.lit(LEAST_DETERMINANT), vxx * vyy - vxy * vxy)
    q = (vyy * dx * dx - 2.0 * vxy * dx * dy + vxx * dy * dy) / det
    return F.exp(-0.5 * q) / (2.0 * math.pi * F.sqrt(det))


def round_density(dx: Column, dy: Column, var: Column) -> Column:
    return F.exp(-0.5 * (dx * dx + dy * dy) / var) / (2.0 * math.pi * var)


def evaluate(mixture: Column, x: Column, y: Column) -> Column:
    """Density of array<struct<amp,mx,my,vxx,vxy,vyy>> at a point."""
    return F.aggregate(mixture, F.lit(0.0), lambda s, g: s + g["amp"] * density(x - g["mx"], y - g["my"], g["vxx"], g["vxy"], g["vyy"]))


def convolve(a: Column, b: Column) -> Column:
    """Each component of a with each of b: amplitudes multiply, means and variances add."""

    def pair(g: Column, h: Column) -> Column:
        return F.struct((g["amp"] * h["amp"]).alias("amp"), *((g[n] + h[n]).alias(n) for n in ("mx", "my", "vxx", "vxy", "vyy")))

    return F.flatten(F.transform(a, lambda g: F.transform(b, lambda h: pair(g, h))))


def split(mixture: Column, half: Column, inner: float = 3.0, outer: float = 4.0) -> tuple[Column, Column]:
    """The components to render as mixture, and those to render by Fourier transform, in a patch of this half size.

    A component whose half size counts fewer than ``outer`` widths would wrap around; one of more
    than ``inner`` is compact. Where some are both, amplitudes are shared out along a ramp.
    """
    wide = lambda g: g["vxx"] + g["vyy"]
    is_mixture, is_fourier = (lambda g: half * half < outer * outer * wide(g)), (lambda g: half * half > inner * inner * wide(g))
    ramp = F.exists(mixture, lambda g: is_mixture(g) & is_fourier(g))
    widths = lambda g: half / F.greatest(F.lit(1e-6), F.sqrt(wide(g)))

    def part(mine, share):
        return _with(F.filter(mixture, mine), amp=lambda g: g["amp"] * F.when(ramp, F.least(F.lit(1.0), share(g))).otherwise(1.0))

    return part(is_mixture, lambda g: (outer - widths(g)) / (outer - inner)), part(is_fourier, lambda g: (widths(g) - inner) / (outer - inner))


def prepared(kind: str, psf: list[tuple[float, ...]], covariance: tuple[Column, Column, Column], components: int) -> Column:
    """Of a profile under a covariance, seen through a mixture, all that doesn't depend on the offset: an array of four numbers (factor, and of dx * dx, dx * dy, dy * dy) a component, filled up to so many of the profile's."""
    out: list[Column] = []
    rows = profile(kind)
    for amp, var in [*rows, *[(0.0, 1.0)] * (components - len(rows))]:
        for own, _, _, pxx, pxy, pyy in psf:
            xx, xy, yy = (var * c + p for c, p in zip(covariance, (pxx, pxy, pyy), strict=True))
            det = F.greatest(F.lit(LEAST_DETERMINANT), xx * yy - xy * xy)
            out += [amp * own / (2.0 * math.pi * F.sqrt(det)), -0.5 * yy / det, xy / det, -0.5 * xx / det]
    return F.array(*out)


def prepared_density(numbers: Column, psf: list[tuple[float, ...]], components: int, dx: Column, dy: Column) -> Column:
    """The density at an offset: one expression, of an exponential a component."""
    out, at = F.lit(0.0), 0
    for _ in range(components):
        for _, mx, my, *_ in psf:
            x, y = dx - mx, dy - my
            f, xx, xy, yy = (F.get(numbers, F.lit(at + k)) for k in range(4))
            out, at = out + f * F.exp(xx * x * x + xy * x * y + yy * y * y), at + 4
    return out


def total(mixture: Column) -> Column:
    return F.aggregate(mixture, F.lit(0.0), lambda s, g: s + g["amp"])


def normalised(mixture: Column) -> Column:
    names = ("mx", "my", "vxx", "vxy", "vyy")
    return F.transform(mixture, lambda g: F.struct((g["amp"] / total(mixture)).alias("amp"), *(g[n].alias(n) for n in names)))


def _with(mixture: Column, **changes) -> Column:
    """Components with some fields changed; a change is a function of the component."""
    names = ("amp", "mx", "my", "vxx", "vxy", "vyy")
    return F.transform(mixture, lambda g: F.struct(*((changes[n](g) if n in changes else g[n]).alias(n) for n in names)))


def shifted(mixture: Column, dx: Column, dy: Column) -> Column:
    return _with(mixture, mx=lambda g: g["mx"] + dx, my=lambda g: g["my"] + dy)


def scaled(mixture: Column, factor: Column) -> Column:
    """To pixels of another size: positions by the factor, variances by its square."""
    square = factor * factor
    return _with(mixture, mx=lambda g: g["mx"] * factor, my=lambda g: g["my"] * factor, vxx=lambda g: g["vxx"] * square, vxy=lambda g: g["vxy"] * square, vyy=lambda g: g["vyy"] * square)


def blurred(mixture: Column, sigma: Column) -> Column:
    """Seen through a round Gaussian."""
    v = sigma * sigma
    return _with(mixture, vxx=lambda g: g["vxx"] + v, vyy=lambda g: g["vyy"] + v)


def gradient(mixture: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """Derivatives of evaluate() by x and by y."""

    def part(along: bool):
        def add(s: Column, g: Column) -> Column:
            dx, dy = x - g["mx"], y - g["my"]
            det = F.greatest(F.lit(LEAST_DETERMINANT), g["vxx"] * g["vyy"] - g["vxy"] * g["vxy"])
            slope = (g["vyy"] * dx - g["vxy"] * dy) / det if along else (g["vxx"] * dy - g["vxy"] * dx) / det
            return s - g["amp"] * density(dx, dy, g["vxx"], g["vxy"], g["vyy"]) * slope

        return F.aggregate(mixture, F.lit(0.0), add)

    return part(True), part(False)


def fourier(amp: Column, var: Column, mx: Column, my: Column, v: Column, w: Column) -> tuple[Column, Column]:
    """Real and imaginary part of a round component's transform at frequencies v, w in cycles a pixel."""
    size = amp * F.exp(-2.0 * math.pi**2 * var * (v * v + w * w))
    phase = -2.0 * math.pi * (mx * v + my * w)
    return size * F.cos(phase), size * F.sin(phase)


def lanczos(x: Column, order: int = 3) -> Column:
    a = math.pi * x
    inside = order * F.sin(a) * F.sin(a / order) / (a * a)
    return F.when(x == 0, 1.0).when(F.abs(x) >= order, 0.0).otherwise(inside)


def encircled_radius(sigma: Column, share: float) -> Column:
    """Radius that holds a share of a Gaussian's flux."""
    return sigma * math.sqrt(-2.0 * math.log(1.0 - share))
