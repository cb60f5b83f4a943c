"""Coordinates on the sky and in images."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _clip(x: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))


def separation(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Great-circle distance in degrees, by the clipped arc cosine of the unit vectors' product."""
    a, b, d = F.radians(dec1), F.radians(dec2), F.radians(ra1 - ra2)
    return F.degrees(F.acos(_clip(F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(d))))


def affine_to_pixel(ra: Column, dec: Column, w: dict[str, Column]) -> tuple[Column, Column]:
    """Orthographic projection about the reference point, then the inverse of the CD matrix.

    w: crval1, crval2, crpix1, crpix2, cd11, cd12, cd21, cd22.
    """
    d, d0, da = F.radians(dec), F.radians(w["crval2"]), F.radians(ra - w["crval1"])
    u = F.degrees(F.cos(d) * F.sin(da))
    v = F.degrees(F.sin(d) * F.cos(d0) - F.cos(d) * F.sin(d0) * F.cos(da))
    det = w["cd11"] * w["cd22"] - w["cd12"] * w["cd21"]
    x = w["crpix1"] + (w["cd22"] * u - w["cd12"] * v) / det
    y = w["crpix2"] + (w["cd11"] * v - w["cd21"] * u) / det
    return x, y


def affine_to_sky(x: Column, y: Column, w: dict[str, Column], exact: bool = False) -> tuple[Column, Column]:
    """The small-angle inverse, or the exact inverse of the orthographic projection."""
    dx, dy = x - w["crpix1"], y - w["crpix2"]
    u, v = w["cd11"] * dx + w["cd12"] * dy, w["cd21"] * dx + w["cd22"] * dy
    if not exact:
        dec = w["crval2"] + v
        return w["crval1"] + u / F.cos(F.radians(dec)), dec
    a, b, d0 = F.radians(u), F.radians(v), F.radians(w["crval2"])
    c = F.sqrt(F.greatest(F.lit(0.0), 1.0 - a * a - b * b))
    dec = F.asin(_clip(b * F.cos(d0) + c * F.sin(d0)))
    ra = w["crval1"] + F.degrees(F.atan2(a, c * F.cos(d0) - b * F.sin(d0)))
    return ra, F.degrees(dec)


def pixel_scale(w: dict[str, Column]) -> Column:
    """Arc seconds a pixel."""
    return 3600.0 * F.sqrt(F.abs(w["cd11"] * w["cd22"] - w["cd12"] * w["cd21"]))


def pixel_to_position_derivatives(dx: Column, dy: Column, w: dict[str, Column]) -> tuple[Column, Column]:
    """Derivatives by sky position from those by pixel, through the inverse of the CD matrix."""
    det = w["cd11"] * w["cd22"] - w["cd12"] * w["cd21"]
    return (dx * w["cd22"] - dy * w["cd21"]) / det, (dy * w["cd11"] - dx * w["cd12"]) / det


def pixel_position_angle(pa: Column, ra: Column, dec: Column, w: dict[str, Column], kind: str = "tangent", step: float = 1.0, y_down: bool = False) -> Column:
    """A sky angle at a position, from east towards north, as the angle in the image from x towards y (or -y), both in degrees.

    The image of ``step`` arc seconds to the east and to the north is probed there.
    """
    d = step / 3600.0
    to_pixel = TRANSFORMS[kind][0]
    here, east, north = to_pixel(ra, dec, w), to_pixel(ra + d / F.cos(F.radians(dec)), dec, w), to_pixel(ra, dec + d, w)
    c, s = F.cos(F.radians(pa)), F.sin(F.radians(pa))
    x, y = ((e - h) * c + (n - h) * s for h, e, n in zip(here, east, north, strict=True))
    return F.degrees(F.atan2(-y if y_down else y, x))


def wrapped_step(a: Column, b: Column) -> Column:
    """b - a of two right ascensions, into [-180, 180)."""
    return F.pmod(b - a + 180.0, F.lit(360.0)) - 180.0


def _plane(x: Column, y: Column, w: dict[str, Column]) -> tuple[Column, Column]:
    dx, dy = x - w["crpix1"], y - w["crpix2"]
    return w["cd11"] * dx + w["cd12"] * dy, w["cd21"] * dx + w["cd22"] * dy


def tangent_to_pixel(ra: Column, dec: Column, w: dict[str, Column]) -> tuple[Column, Column]:
    """Gnomonic projection, then the inverse of the CD matrix; null for the far side of the sky."""
    d, d0, da = F.radians(dec), F.radians(w["crval2"]), F.radians(ra - w["crval1"])
    c = F.sin(d0) * F.sin(d) + F.cos(d0) * F.cos(d) * F.cos(da)
    near = c > 1e-9
    u = F.degrees(F.cos(d) * F.sin(da) / F.when(near, c))
    v = F.degrees((F.cos(d0) * F.sin(d) - F.sin(d0) * F.cos(d) * F.cos(da)) / F.when(near, c))
    det = w["cd11"] * w["cd22"] - w["cd12"] * w["cd21"]
    return w["crpix1"] + (w["cd22"] * u - w["cd12"] * v) / det, w["crpix2"] + (w["cd11"] * v - w["cd21"] * u) / det


def tangent_to_sky(x: Column, y: Column, w: dict[str, Column]) -> tuple[Column, Column]:
    u, v = (F.radians(c) for c in _plane(x, y, w))
    d0 = F.radians(w["crval2"])
    r = F.sqrt(1.0 + u * u + v * v)
    dec = F.asin(_clip((F.sin(d0) + v * F.cos(d0)) / r))
    ra = w["crval1"] + F.degrees(F.atan2(u, F.cos(d0) - v * F.sin(d0)))
    return F.pmod(ra, F.lit(360.0)), F.degrees(dec)


def distorted(x: Column, y: Column, w: dict[str, Column], a: dict[tuple[int, int], float], b: dict[tuple[int, int], float]) -> tuple[Column, Column]:
    """Pixels with polynomial distortion: powers (p, q) of the offsets from the reference pixel, with their factors."""
    u, v = x - w["crpix1"], y - w["crpix2"]

    def term(c: dict[tuple[int, int], float]) -> Column:
        out = F.lit(0.0)
        for (p, q), f in sorted(c.items()):
            t = F.lit(f)
            for part, n in ((u, p), (v, q)):
                for _ in range(n):
                    t = t * part
            out = out + t
        return out

    return x + term(a), y + term(b)


def undistorted(x: Column, y: Column, w: dict[str, Column], a: dict[tuple[int, int], float], b: dict[tuple[int, int], float], steps: int = 3) -> tuple[Column, Column]:
    """The inverse, by fixed-point steps; distortions are far below a pixel a pixel, so few suffice."""
    px, py = x, y
    for _ in range(steps):
        dx, dy = distorted(px, py, w, a, b)
        px, py = x - (dx - px), y - (dy - py)
    return px, py


#: Kinds of coordinate transforms, each sky to pixel and pixel to sky; further kinds may be added.
TRANSFORMS = {
    "null": (lambda ra, dec, w: (ra - w["crval1"], dec - w["crval2"]), lambda x, y, w: (x + w["crval1"], y + w["crval2"])),
    "affine": (affine_to_pixel, affine_to_sky),
    "tangent": (tangent_to_pixel, tangent_to_sky),
}


def shifted(w: dict[str, Column], dx: float, dy: float) -> dict[str, Column]:
    """The transform of an image whose first pixel is (dx, dy) of this one."""
    return w | {"crpix1": w["crpix1"] - dx, "crpix2": w["crpix2"] - dy}


def rescaled(w: dict[str, Column], factor: float) -> dict[str, Column]:
    """The transform of an image with pixels larger by a factor."""
    return {k: (v - 0.5) / factor + 0.5 if k.startswith("crpix") else v * factor if k.startswith("cd") else v for k, v in w.items()}


def counted_from_one(w: dict[str, Column]) -> dict[str, Column]:
    return w | {k: w[k] + 1.0 for k in ("crpix1", "crpix2")}


def wrapped(ra: Column) -> Column:
    """Degrees in [0, 360)."""
    return ra - 360.0 * F.floor(ra / 360.0)
