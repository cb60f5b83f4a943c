"""Properties that hold for any input."""

from __future__ import annotations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from skyframe.operators import kernels, photometry
from skyframe.sources import fits

SHAPES = st.tuples(st.integers(1, 9), st.integers(1, 9))


@settings(max_examples=60, deadline=None)
@given(SHAPES, st.sampled_from([np.uint8, np.int16, np.int32, np.int64, np.float32, np.float64]), st.integers(0, 2**32 - 1), st.text(alphabet="ab 'xyz", max_size=20))
def test_fits_keeps_arrays_and_strings(shape, kind, seed, name):
    data = np.random.default_rng(seed).integers(0, 100, shape).astype(kind)
    back = fits.decode(fits.encode([fits.Hdu("PRIMARY", {"OBSID": name, "N": 3, "T": True}), fits.Hdu("IMAGE", {}, data)]))
    assert np.array_equal(back[1].data, data) and back[1].name == "IMAGE"
    assert back[0].header["OBSID"] == name.rstrip() and back[0].header["N"] == 3 and back[0].header["T"] is True


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 8), st.integers(0, 2**32 - 1))
def test_conjugate_gradients_agree_with_the_solve(n, seed):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(3 * n, n))
    f, r = a.T @ a + 0.1 * np.eye(n), rng.normal(size=n)
    flux, var = photometry.linear_solution(f, r)
    assert np.allclose(photometry.conjugate_gradients(f, r, tol=1e-12), flux, rtol=1e-6, atol=1e-8)
    assert (var > 0).all()


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(1, 20), st.integers(0, 2**32 - 1))
def test_embedding_keeps_the_centre(size, grid, seed):
    stamp = np.random.default_rng(seed).random((size, size))
    out = kernels.embedded(stamp, grid)
    assert out.shape == (grid, grid) and out[grid // 2, grid // 2] == stamp[size // 2, size // 2]
    if grid >= size + 1:
        assert abs(out.sum() - stamp.sum()) < 1e-9


@settings(max_examples=40, deadline=None)
@given(st.floats(0.2, 7.0))
def test_profiles_sum_to_one(n):
    m = np.array(kernels.sersic_mixture(round(n, 2)))
    assert abs(m[:, 0].sum() - 1) < 1e-9 and (m[:, 1] >= 0).all()


@settings(max_examples=30, deadline=None)
@given(st.floats(4.0, 11.0), st.floats(4.0, 11.0), st.integers(0, 2**32 - 1))
def test_rendering_keeps_flux_and_is_linear(x, y, seed):
    rng = np.random.default_rng(seed)
    yy, xx = np.mgrid[:9, :9]
    psf = np.exp(-0.5 * ((xx - 4) ** 2 + (yy - 4) ** 2) / rng.uniform(0.8, 1.2) ** 2)
    psf /= psf.sum()
    one = kernels.point_source(psf, x, y, 16, 16)
    assert abs(one.sum() - 1) < 5e-3
    assert np.allclose(kernels.point_source(psf, x, y, 16, 16, 7.5), 7.5 * one)
