"""Magnitudes, fluxes and counts."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The zeropoint of a nanomaggy, millijansky in a nanomaggy, and the magnitude above which a source counts as absent.
NANOMAGGY_ZEROPOINT = 22.5
MILLIJANSKY = 3.631e-3
FAINTEST_MAG = 50.0


def _positive(x: Column, then: Column) -> Column:
    """then, or null where x is not above 0."""
    return F.when(x > 0, then)


def mag_to_nanomaggies(mag: Column) -> Column:
    return F.pow(F.lit(10.0), (mag - NANOMAGGY_ZEROPOINT) / -2.5)


def nanomaggies_to_mag(flux: Column) -> Column:
    return _positive(flux, -2.5 * (F.log10(flux) - 9.0))


def zeropoint_to_scale(zp: Column) -> Column:
    return F.pow(F.lit(10.0), (zp - NANOMAGGY_ZEROPOINT) / 2.5)


def scale_to_zeropoint(scale: Column) -> Column:
    return _positive(scale, NANOMAGGY_ZEROPOINT + 2.5 * F.log10(scale))


def mag_error(flux: Column, invvar: Column) -> Column:
    return F.when((flux > 0) & (invvar > 0), 2.5 / math.log(10.0) / F.sqrt(invvar) / flux)


def add_mags(*mags: Column) -> Column:
    """The magnitude of the summed fluxes."""
    total = F.pow(F.lit(10.0), mags[0] / -2.5)
    for m in mags[1:]:
        total = total + F.pow(F.lit(10.0), m / -2.5)
    return -2.5 * F.log10(total)


def scale_mag(mag: Column, factor: Column) -> Column:
    return F.when(factor != 0, mag - 2.5 * F.log10(F.abs(factor)))


def counts(kind: Column, value: Column, scale: Column, zp: Column) -> Column:
    """Brightness to image counts under each kind of calibration: a magnitude under a zeropoint (0 unless finite and bright enough), linear by a scale; a band's flux and null as they are."""
    finite = ~F.isnan(value) & (F.abs(value) != float("inf")) & (value <= FAINTEST_MAG)
    by_mag = F.when(finite, F.pow(F.lit(10.0), (zp - value) / 2.5)).otherwise(0.0)
    return F.when(kind == "mag", by_mag).when(kind == "linear", value * scale).otherwise(value)


def to_millijansky(flux: Column) -> Column:
    return flux * MILLIJANSKY


def sigma(invvar: Column) -> Column:
    return _positive(invvar, 1.0 / F.sqrt(invvar))
