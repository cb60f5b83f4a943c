"""Queries work on all rows of their tables, whatever the identifiers."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from skyframe.functions import ellipses
from skyframe.operators.kernels import sersic_mixture
from skyframe.plans.domain import Domain
from skyframe.plans.kernels import _shapes
from skyframe.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.01"


def brute(psf: np.ndarray, s, mixture: list, size: int = 32) -> np.ndarray:
    """Sum over all frequencies one by one: of the stamp about its centre, the shape and the shift."""
    v, w = np.arange(size // 2 + 1) / size, np.fft.fftfreq(size)
    j, i = np.mgrid[-3:4, -3:4]
    out = np.zeros((16, 16))
    y, x = np.mgrid[:16, :16]
    for a in v:
        for b in w:
            shape = sum(m * np.exp(-2 * np.pi**2 * var * (s.vxx * a * a + 2 * s.vxy * a * b + s.vyy * b * b)) for m, var in mixture)
            term = (psf * np.exp(-2j * np.pi * (a * i + b * j))).sum() * shape * np.exp(2j * np.pi * (a * (x - s.x0) + b * (y - s.y0)))
            out += (1 if a in (0, 0.5) else 2) * term.real
    return s.flux * out / size**2


@pytest.mark.parametrize("name", ["r10_fourier_points", "r11_fourier_galaxies"])
def test_all_sources_are_rendered_with_all_stamps(spark, name):
    d = Domain(spark, DATA)
    v = ellipses.transformed(tuple(F.col(n) for n in ("t11", "t12", "t21", "t22")), F.lit(1.0), F.lit(0.0), F.lit(1.0))
    sources = _shapes(d).where("re > 0" if name[:3] == "r11" else "true").select("src_id", "x0", "y0", "flux", "sersic", *(x.alias(n) for x, n in zip(v, ("vxx", "vxy", "vyy"), strict=True))).toPandas()
    stamps = d.stamps.toPandas()
    ids = np.sort(stamps.psf_id.unique())
    assert ids.tolist() == list(range(len(ids))) and sources.src_id.max() > 400 and len(ids) > 50
    got = QUERIES[name](spark, DATA).toPandas()
    assert len(got) == 256 * len(sources) and set(got.src_id) == set(sources.src_id)
    images = {k: g.sort_values(["y", "x"]).value.to_numpy().reshape(16, 16) for k, g in got.groupby("src_id")}
    psfs = {k: g.sort_values(["y", "x"]).value.to_numpy().reshape(7, 7) for k, g in stamps.groupby("psf_id")}
    for s in sources.sort_values("src_id").iloc[::97].itertuples():
        mixture = [(1.0, 0.0)] if name[:3] == "r10" else sersic_mixture(round(s.sersic, 3))
        assert np.allclose(images[s.src_id], brute(psfs[s.src_id % len(ids)], s, mixture), atol=2e-6, rtol=1e-7), s.src_id


def same_as_twin_over_all(spark, name: str, limit: str, keys: list[str], least: int) -> None:
    """Rows of the query at sf0.1 and of its twin without the limit, which the registered one has."""
    big = "/root/testdata/sf0.1"
    con = duckdb.connect()
    for table in ("embeddings", "orders", "customer"):
        con.sql(f"create view {table} as select * from '{big}/{table}.parquet'")
    ours = QUERIES[name](spark, big).toPandas().sort_values(keys, ignore_index=True)
    twin = con.sql(ORACLE[name].replace(limit, "")).df().sort_values(keys, ignore_index=True)
    assert len(ours) == len(twin) and ours[keys[0]].max() >= least
    assert (ours[keys].to_numpy() == twin[keys].to_numpy()).all()
    (value,) = set(twin.columns) - set(keys)
    if twin[value].dtype == float:
        assert np.allclose(ours[value], twin[value], rtol=0, atol=2e-6, equal_nan=True)
    else:
        assert ours[value].tolist() == twin[value].tolist()


@pytest.mark.parametrize("name", ["r13_lanczos_shift", "r16_lanczos_resample"])
def test_all_stamps_are_resampled(spark, name):
    same_as_twin_over_all(spark, name, " where psf_id < 200", ["psf_id", "y", "x"], 200)


def test_bands_of_all_targets(spark):
    same_as_twin_over_all(spark, "t3_sorted_bands", " where target < 200", ["target"], 200)


def test_running_flux_of_all_stamps(spark):
    same_as_twin_over_all(spark, "w1_cumulative_flux", " where psf_id < 100", ["psf_id", "y", "x"], 100)
