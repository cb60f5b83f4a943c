"""Ellipse parametrisations and the matrices of galaxy shapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Smallest effective radius in arc seconds that a shape matrix is made for.
LEAST_RADIUS = 1.0 / 30.0
#: Fixed value: the ellipticity that conversions stop at.
GREATEST_ELLIPTICITY = 0.999999


def axis_ratio(e1: Column, e2: Column) -> Column:
    e = F.hypot(e1, e2)
    return (1.0 - e) / (1.0 + e)


def position_angle(e1: Column, e2: Column) -> Column:
    """Degrees in [0, 180)."""
    return F.pmod(0.5 * F.degrees(F.atan2(e2, e1)) + 180.0, F.lit(180.0))


def components(ab: Column, phi: Column) -> tuple[Column, Column]:
    """e1, e2 of an axis ratio and a position angle in degrees, which turns against the components' angle."""
    e, angle = (1.0 - ab) / (1.0 + ab), F.radians(-2.0 * phi)
    return e * F.cos(angle), e * F.sin(angle)


def _along(size: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """A vector of a size in the direction of another, which may be 0."""
    whole = F.hypot(x, y)
    return tuple(F.when(whole == 0, 0.0).otherwise(size * v / whole) for v in (x, y))


def hardened(ee1: Column, ee2: Column) -> tuple[Column, Column]:
    """e1, e2 of unbounded (softened) components; their size stays below 1."""
    return _along(F.least(F.lit(GREATEST_ELLIPTICITY), 1.0 - F.exp(-F.hypot(ee1, ee2))), ee1, ee2)


def softened(e1: Column, e2: Column) -> tuple[Column, Column]:
    """The other way."""
    e = F.least(F.lit(GREATEST_ELLIPTICITY), F.hypot(e1, e2))
    return tuple(F.when(e == 0, 0.0).otherwise(-F.log(1.0 - e) * v / e) for v in (e1, e2))


def covariance_components(vxx: Column, vxy: Column, vyy: Column) -> tuple[Column, Column]:
    """e1, e2 of a covariance of positions: x grows against the angle, so the first component has the other sign."""
    mid, half = 0.5 * (vxx + vyy), F.hypot(0.5 * (vxx - vyy), vxy)
    ab = F.sqrt((mid - half) / (mid + half))
    return _along((1.0 - ab) / (1.0 + ab), 0.5 * (vyy - vxx), vxy)


def tensor(re: Column, e1: Column, e2: Column, cd: tuple[Column, ...]) -> tuple[Column, Column, Column, Column]:
    """Pixels to units of the effective radius; cd takes pixels to degrees. Beyond an axis ratio of 1 : 1000 it counts as that."""
    e, theta = F.hypot(e1, e2), 0.5 * F.atan2(e2, e1)
    ab = F.when(e >= 1, 1000.0).otherwise(F.least(F.lit(1000.0), (1.0 + e) / (1.0 - e)))
    r, c, s = re / 3600.0, F.cos(theta), F.sin(theta)
    return product(inverse((r * c / ab, r * s, -r * s / ab, r * c)), cd)


def shape_matrix(re: Column, ab: Column, phi: Column) -> tuple[Column, Column, Column, Column]:
    """g11, g12, g21, g22 in degrees: the unit circle to the ellipse on the sky."""
    r = F.greatest(F.lit(LEAST_RADIUS), re) / 3600.0
    angle = F.radians(90.0 - phi)
    c, s = F.cos(angle), F.sin(angle)
    return r * c, r * s * ab, -r * s, r * c * ab


def product(a: tuple[Column, ...], b: tuple[Column, ...]) -> tuple[Column, Column, Column, Column]:
    """Of two 2x2 matrices, by rows."""
    return a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3]


def inverse(a: tuple[Column, ...]) -> tuple[Column, Column, Column, Column]:
    det = a[0] * a[3] - a[1] * a[2]
    return a[3] / det, -a[1] / det, -a[2] / det, a[0] / det


def transformed(t: tuple[Column, ...], vxx: Column, vxy: Column, vyy: Column) -> tuple[Column, Column, Column]:
    """T V T' of a symmetric V."""
    ax, ay = t[0] * vxx + t[1] * vxy, t[0] * vxy + t[1] * vyy
    bx, by = t[2] * vxx + t[3] * vxy, t[2] * vxy + t[3] * vyy
    return ax * t[0] + ay * t[1], ax * t[2] + ay * t[3], bx * t[2] + by * t[3]


def covariance_radius(vxx: Column, vxy: Column, vyy: Column) -> Column:
    """Square root of the larger eigenvalue."""
    return F.sqrt(0.5 * (vxx + vyy) + F.sqrt(0.25 * (vxx - vyy) * (vxx - vyy) + vxy * vxy))
