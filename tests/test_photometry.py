"""Numpy goldens and inject-and-recover for fits and rendering."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from skyframe.operators import background, grids, kernels, photometry, spatial, stamps


def gaussian(size: int, x: float, y: float, sigma: float) -> np.ndarray:
    yy, xx = np.mgrid[:size, :size]
    return np.exp(-0.5 * ((xx - x) ** 2 + (yy - y) ** 2) / sigma**2) / (2 * np.pi * sigma**2)


def image(spark, data: np.ndarray, iv: float = 1.0, image_id: int = 1):
    y, x = (v.ravel() for v in np.mgrid[: data.shape[0], : data.shape[1]])
    return spark.createDataFrame(pd.DataFrame({"image_id": image_id, "x": x.astype("int32"), "y": y.astype("int32"), "data": data.ravel(), "iv": iv}))


def sources(spark, rows):
    return spark.createDataFrame(rows, "src_id long, image_id long, x0 double, y0 double, sigma double, flux double")


def test_two_fluxes_are_recovered(spark):
    data = 1000 * gaussian(20, 4.85, 5.32, 1.0) + 500 * gaussian(20, 14.97, 15.14, 1.0)
    src = sources(spark, [(1, 1, 4.85, 5.32, 1.0, 1.0), (2, 1, 14.97, 15.14, 1.0, 1.0)])
    t = photometry.templates(src, image(spark, data, 100.0), 30.0)
    for solver in ("linear", "cg"):
        got = photometry.solve(photometry.equations(t), solver=solver).orderBy("src_id").toPandas()
        assert np.allclose(got.flux, [1000, 500], atol=1e-4)
        assert (got.npix == 400).all()


def test_overlapping_sources_match_dense_algebra(spark):
    rng = np.random.default_rng(1)
    data = 800 * gaussian(12, 5.2, 5.1, 1.5) + 300 * gaussian(12, 6.9, 6.0, 1.5) + rng.normal(0, 0.1, (12, 12))
    src = sources(spark, [(1, 1, 5.2, 5.1, 1.5, 1.0), (2, 1, 6.9, 6.0, 1.5, 1.0)])
    t = photometry.templates(src, image(spark, data, 4.0), 30.0)
    got = photometry.solve(photometry.equations(t)).orderBy("src_id").toPandas()
    a = np.column_stack([gaussian(12, 5.2, 5.1, 1.5).ravel(), gaussian(12, 6.9, 6.0, 1.5).ravel()])
    f = 4 * a.T @ a
    assert np.allclose(got.flux, np.linalg.solve(f, 4 * a.T @ data.ravel()), rtol=1e-9)
    assert np.allclose(got.var_marginal, np.diag(np.linalg.inv(f)), rtol=1e-9)
    assert np.allclose(got.var_conditional, 1 / np.diag(f), rtol=1e-9)


def test_a_source_without_weight_has_no_flux(spark):
    src = sources(spark, [(1, 1, 4.0, 4.0, 1.0, 1.0), (2, 1, 6.0, 6.0, 1.0, 1.0)])
    t = photometry.templates(src, image(spark, np.ones((9, 9)), 0.0), 30.0)
    assert photometry.solve(photometry.equations(t)).where("flux is not null and not isnan(flux)").count() == 0


def test_noisy_flux(spark):
    rng = np.random.default_rng(5)
    frames = [image(spark, 1000 * gaussian(20, 10, 10, 2.0) + rng.normal(0, 1, (20, 20)), 1.0, k) for k in range(4)]
    pixels = frames[0].unionByName(frames[1]).unionByName(frames[2]).unionByName(frames[3])
    src = sources(spark, [(1, k, 10.0, 10.0, 2.0, 1.0) for k in range(4)])
    got = photometry.fit_with_background(photometry.templates(src, pixels, 20.0), ["image_id", "src_id"]).toPandas()
    assert len(got) == 4 and (abs(got.flux - 1000) < 50).all()


@pytest.mark.parametrize("shift", [0.0, 0.25, 0.5, 0.75])
def test_rendered_centroid_and_flux(shift):
    psf = gaussian(21, 10, 10, 2.0)
    out = kernels.point_source(psf / psf.sum(), 16 + shift, 15, 33, 33, 100.0)
    yy, xx = np.mgrid[:33, :33]
    assert abs((xx * out).sum() / out.sum() - 16 - shift) < 0.01
    assert abs((yy * out).sum() / out.sum() - 15) < 0.01
    assert abs(out.sum() - 100) < 0.1


def test_nothing_wraps_around():
    psf = gaussian(21, 10, 10, 2.0)
    out = kernels.point_source(psf / psf.sum(), 1.0, 15.0, 30, 30, 1000.0)
    assert abs(out[:, -5:]).max() < 1e-3


def test_galaxy_flux_and_peak():
    psf = gaussian(21, 10, 10, 1.5)
    m = np.array(kernels.sersic_mixture(1.0))
    out = kernels.galaxy(psf / psf.sum(), m[:, 0], m[:, 1:] * np.array([[4.0, 0.5, 3.0]]), 20.0, 20.0, 41, 41, 1000.0)
    assert abs(out.sum() - 1000) < 10
    assert np.unravel_index(out.argmax(), out.shape) == (20, 20)


@pytest.mark.parametrize("n", [0.1, 0.5, 1.0, 2.5, 4.0, 9.0])
def test_sersic_mixtures(n):
    m = np.array(kernels.sersic_mixture(n))
    assert abs(m[:, 0].sum() - 1) < 1e-9 and (m >= 0).all()
    half = (m[m[:, 1] > 0, 0] * (1 - np.exp(-1 / (2 * m[m[:, 1] > 0, 1])))).sum() + m[m[:, 1] == 0, 0].sum()
    assert 0.42 < half < 0.58  # the effective radius holds half the flux
    assert abs(sum(a for a, _ in kernels.sersic_mixture(n, beyond=0.02)) - 0.98) < 1e-9


def test_em_recovers_a_gaussian():
    fit = kernels.fit_mixture(5 * gaussian(25, 12, 12, 2.0), 1)
    assert np.allclose(fit[0], [5, 0, 0, 4, 0, 4], atol=0.02)


def test_plane_is_exact(spark):
    yy, xx = np.mgrid[:8, :8]
    got = photometry.plane(image(spark, 2.0 + 0.5 * xx - 0.25 * yy, 3.0), "image_id").collect()[0]
    assert np.allclose([got.a, got.b, got.c], [2, 0.5, -0.25])
    assert photometry.plane(image(spark, np.ones((1, 4)), 1.0), "image_id").count() == 0  # no unique plane


def test_rebin_and_halve_keep_flux(spark):
    rng = np.random.default_rng(2)
    v = rng.random((7, 7))
    y, x = (k.ravel() for k in np.mgrid[:7, :7])
    s = spark.createDataFrame(pd.DataFrame({"psf_id": 1, "y": y.astype("int32"), "x": x.astype("int32"), "value": v.ravel()}))
    b = stamps.block_sum(s, 2, 2, "psf_id", height=7, width=7).toPandas()
    assert len(b) == 9 and abs(b.flux.sum() - v[:6, :6].sum()) < 1e-9
    assert abs(stamps.halve(s, "psf_id", 7).toPandas().value.sum() - v.sum()) < 1e-9


def test_shift_by_nothing_is_identity_and_resample_keeps_a_constant(spark):
    y, x = (k.ravel() for k in np.mgrid[:7, :7])
    from pyspark.sql import functions as F

    s = spark.createDataFrame(pd.DataFrame({"psf_id": 1, "y": y.astype("int32"), "x": x.astype("int32"), "value": np.arange(49.0)}))
    same = stamps.shift(s, "psf_id", F.lit(0.0), F.lit(0.0), 7, 7).orderBy("y", "x").toPandas()
    assert np.allclose(same.value, np.arange(49.0))
    flat = stamps.downsampled(s.withColumn("value", F.lit(3.0)), "psf_id", (7, 7), (4, 4)).toPandas()
    assert len(flat) == 16 and np.allclose(flat.value, 3.0 * 49 / 16)


def test_tiles_cover_each_core_pixel_once(spark):
    p = image(spark, np.ones((13, 11)))
    t = grids.tiled(p, 4, 2, 13, 11)
    assert t.where("core").count() == 143
    assert t.where("core").select("x", "y").distinct().count() == 143
    in_tile = t.where("ty = 1 and tx = 1").toPandas()
    assert sorted(set(in_tile.x)) == list(range(2, 10)) and sorted(set(in_tile.y)) == list(range(2, 10))


def test_tile_assignment_is_half_open(spark):
    src = sources(spark, [(1, 1, 4.0, 4.0, 1.0, 1.0), (2, 1, 5.0, 0.0, 1.0, 1.0), (3, 1, 3.0, 0.5, 1.0, 1.0)])
    got = {(r.src_id, r.tx, r.ty, r.core) for r in spatial.assign_tiles(src, 4, 1.0, 2, 2).collect()}
    assert {g for g in got if g[0] == 1} == {(1, 0, 0, False), (1, 0, 1, False), (1, 1, 0, False), (1, 1, 1, True)}
    assert {g for g in got if g[0] == 2} == {(2, 1, 0, True)}
    assert {g for g in got if g[0] == 3} == {(3, 0, 0, True), (3, 1, 0, False)}


def test_buckets(spark):
    shapes = spark.createDataFrame([(1, 64, 64), (2, 100, 100), (3, 32, 128)], "image_id long, h int, w int")
    got = {r.image_id: (r.bh, r.bw) for r in grids.assigned(shapes, "image_id", grids.buckets(shapes, "image_id")).collect()}
    assert got == {1: (64, 64), 2: (128, 128), 3: (128, 128)}
    got = {r.image_id: (r.bh, r.bw) for r in grids.assigned(shapes, "image_id", grids.buckets(shapes, "image_id", square=False)).collect()}
    assert got == {1: (64, 64), 2: (128, 128), 3: (32, 128)}
    fixed = spark.createDataFrame([(64, 64)], "bh int, bw int")
    assert {r.image_id: r.bh for r in grids.assigned(shapes, "image_id", fixed).collect()} == {1: 64, 2: 128, 3: 32}


def test_background_of_a_constant_ignores_masked_pixels(spark):
    from pyspark.sql import functions as F

    p = image(spark, np.full((15, 15), 7.0)).withColumn("bad", F.expr("x = 3")).withColumn("data", F.when(F.col("bad"), 1e6).otherwise(F.col("data")))
    got = background.interpolated(p, background.mesh(p, "image_id", 5), "image_id", 5).toPandas()
    assert len(got) == 225 and np.allclose(got.background, 7.0)


def test_positions_are_refined(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(f"file://{tmp_path}")
    data = 1000 * gaussian(32, 15.5, 15.5, 1.5)
    src = sources(spark, [(1, 1, 14.5, 14.5, 1.5, 900.0)])
    got = photometry.refined(src, image(spark, data), 30.0).collect()[0]
    assert abs(got.x0 - 15.5) < 0.05 and abs(got.y0 - 15.5) < 0.05 and abs(got.flux - 1000) < 1


def test_kinds_of_background(spark):
    from pyspark.sql import functions as F

    yy, xx = np.mgrid[:10, :10]
    p = image(spark, 1.0 + xx).withColumn("bad", F.lit(False))
    plane = background.fit(p, "image_id", "plane").toPandas()
    assert np.allclose(plane.background, plane.data)
    assert background.fit(p, "image_id", "none").where("background = 0").count() == 100
    assert background.fit(p, "image_id", "mesh").where("background is null").count() == 0
    with pytest.raises(ValueError):
        background.fit(p, "image_id", "other")


def test_ellipses_by_hand(spark):
    from pyspark.sql import functions as F

    from skyframe.functions import ellipses

    rng = np.random.default_rng(3)
    rows = []
    for _ in range(40):
        a = rng.normal(size=(2, 2))
        rows.append((*(a @ a.T)[[0, 0, 1], [0, 1, 1]].tolist(), float(rng.uniform(0.05, 1)), float(rng.uniform(-200, 200)), *rng.normal(0, 3, 2).tolist()))
    rows.append((2.0, 0.0, 2.0, 1.0, 10.0, 0.0, 0.0))
    df = spark.createDataFrame(rows, "xx double, xy double, yy double, ab double, phi double, p double, q double")
    v = ellipses.covariance_components(F.col("xx"), F.col("xy"), F.col("yy"))
    c, h, s = ellipses.components(F.col("ab"), F.col("phi")), ellipses.hardened(F.col("p"), F.col("q")), ellipses.softened(F.col("p") / 20, F.col("q") / 20)
    t = ellipses.tensor(F.lit(2.0), h[0], h[1], tuple(F.lit(x) for x in (1e-3, 2e-4, -1e-4, 1.5e-3)))
    for r in df.select("*", *(x.alias(f"{n}{i}") for n, k in zip("vchst", (v, c, h, s, t)) for i, x in enumerate(k))).collect():
        u, w, _ = np.linalg.svd(np.array([[r.xx, r.xy], [r.xy, r.yy]]))
        ab = np.sqrt(w[1] / w[0])
        e, angle = (1 - ab) / (1 + ab), 2 * np.arctan2(u[0, 0], u[0, 1])
        assert np.allclose([r.v0, r.v1], [e * np.cos(angle), e * np.sin(angle)], atol=1e-7)
        e = (1 / r.ab - 1) / (1 / r.ab + 1)
        assert np.allclose([r.c0, r.c1], [e * np.cos(np.radians(-2 * r.phi)), e * np.sin(np.radians(-2 * r.phi))])
        e, theta = min(0.999999, 1 - np.exp(-np.hypot(r.p, r.q))), np.arctan2(r.q, r.p) / 2
        assert np.allclose([r.h0, r.h1], [e * np.cos(2 * theta), e * np.sin(2 * theta)])
        e = min(np.hypot(r.p, r.q) / 20, 0.999999)
        assert np.allclose([r.s0, r.s1], [0, 0] if e == 0 else [-np.log(1 - e) * r.p / 20 / e, -np.log(1 - e) * r.q / 20 / e])
        e = np.hypot(r.h0, r.h1)
        ab, ct, st = min(1000.0, (1 + e) / (1 - e)), np.cos(theta), np.sin(theta)
        g = 2 / 3600 * np.array([[ct / ab, st], [-st / ab, ct]])
        assert np.allclose([r.t0, r.t1, r.t2, r.t3], (np.linalg.inv(g) @ [[1e-3, 2e-4], [-1e-4, 1.5e-3]]).ravel(), rtol=1e-5)


def test_counts_by_hand(spark):
    from pyspark.sql import functions as F

    from skyframe.functions import photometry as p

    rows = [("mag", 20.0, 100.0), ("mag", 50.5, 0.0), ("mag", 50.0, 10 ** (0.4 * -25.0)), ("mag", float("inf"), 0.0), ("mag", float("-inf"), 0.0), ("mag", float("nan"), 0.0), ("mag", None, 0.0), ("flux", 7.0, 7.0), ("null", 3.0, 3.0), ("linear", 4.0, 10.0)]
    got = spark.createDataFrame(rows, "kind string, v double, e double").select(p.counts(F.col("kind"), F.col("v"), F.lit(2.5), F.lit(25.0)).alias("c"), "e").collect()
    assert all(abs(r.c - r.e) <= 1e-12 * max(1, r.e) for r in got)


def test_resampling_by_hand(spark):
    rng = np.random.default_rng(5)
    v = rng.random((9, 8))
    y, x = (k.ravel() for k in np.mgrid[:9, :8])
    s = spark.createDataFrame(pd.DataFrame({"psf_id": 1, "y": y.astype("int32"), "x": x.astype("int32"), "value": v.ravel()}))

    def weights(grid, n):
        start, step, size = grid
        wide = max(1.0, step)
        t = (start + step * np.arange(size)[:, None] - np.arange(n)) / wide
        return np.where(np.abs(t) < 3, np.sinc(t) * np.sinc(t / 3), 0) / wide

    for across, along in (((0.25, 1.75, 4), (-0.5, 0.5, 9)), ((2.0, 1.0, 3), (1.0, 2.5, 3))):
        got = stamps.resample(s, "psf_id", across, along).orderBy("y", "x").toPandas()
        assert np.allclose(got.value.to_numpy().reshape(along[2], across[2]), weights(along, 9) @ v @ weights(across, 8).T)


def test_correlation_is_numpys_and_fourier(spark):
    rng = np.random.default_rng(7)
    v, w = rng.random((2, 6, 9)), rng.random((2, 5))
    k, y, x = (a.ravel() for a in np.mgrid[:2, :6, :9])
    s = spark.createDataFrame(pd.DataFrame({"key": k, "y": y.astype("int32"), "x": x.astype("int32"), "value": v.ravel()}))
    f = spark.createDataFrame([(i, j, float(w[i, j])) for i in range(2) for j in range(5)], "key long, k int, weight double")
    for axis, size in (("x", 9), ("y", 6)):
        for full in (False, True):
            got = stamps.correlated(s, f, "key", axis, size, 5, full).orderBy("key", "y", "x").toPandas().value.to_numpy()
            along = 2 if axis == "x" else 1
            expected = np.stack([np.apply_along_axis(lambda a, i=i: np.correlate(a, w[i], "full" if full else "same"), along - 1, v[i]) for i in range(2)])
            assert np.allclose(got, expected.ravel())
            if full:  # the same by the transform
                n = size + 4
                spectrum = np.fft.rfft(v, n, axis=along) * np.moveaxis(np.fft.rfft(w[:, None, ::-1], n, axis=2), 2, along)
                assert np.allclose(np.fft.irfft(spectrum, n, axis=along).ravel(), got)


def test_padding(spark):
    s = spark.createDataFrame([(1, 0, 0, 5.0), (1, 2, 1, 3.0), (1, 9, 9, 1.0)], "k long, y int, x int, value double")
    got = stamps.padded(s, spark.createDataFrame([(1,), (2,)], "k long"), "k", 3, 2).toPandas()
    assert len(got) == 12 and got.value.sum() == 8.0 and got[got.k == 2].value.sum() == 0


def test_log_posterior_is_that_of_the_pixels(spark):
    rng = np.random.default_rng(8)
    templates, data, iv = rng.random((3, 20)), rng.random(20), rng.random(20) + 0.5
    templates[2, :10] = templates[0, 10:] = 0
    rows = [(1, s, p % 5, p // 5, float(templates[s, p]), float(data[p]), float(iv[p])) for s in range(3) for p in range(20) if templates[s, p]]
    df = spark.createDataFrame(rows, "image_id long, src_id long, x int, y int, a double, data double, iv double")
    both = photometry.equations(df)
    value = photometry.log_posterior(both, float((data * data * iv).sum()), {1: 2.0}, {1: 0.5})
    for x in rng.normal(0, 2, (5, 3)):
        expected = -0.5 * ((data - x @ templates) ** 2 * iv).sum() - 0.5 * ((x[1] - 2) / 0.5) ** 2
        assert abs(value(dict(enumerate(x.tolist()))) - expected) < 1e-9
    assert value({0: float("nan")}) == -np.inf
    got = photometry.solve(both).orderBy("src_id").toPandas()
    best = np.linalg.solve((templates * iv) @ templates.T, (templates * iv) @ data)
    assert np.allclose(got.flux, best) and np.allclose(got.var_marginal, np.diag(np.linalg.inv((templates * iv) @ templates.T)))
    cg = photometry.solve(both, solver="cg", tol=1e-12).orderBy("src_id").toPandas()
    assert np.allclose(cg.flux, best) and cg.var_marginal.isna().all()


def test_sparse_parts():
    rng = np.random.default_rng(2)
    a, b = np.sort(rng.integers(0, 60, (2, 40)), 0)
    keep = np.unique(np.stack([a, b]), axis=1)
    a, b = np.concatenate([keep[0], np.arange(60)]), np.concatenate([keep[1], np.arange(60)])
    a, b = np.unique(np.stack([a, b]), axis=1)
    v = np.where(a == b, 5.0, rng.random(len(a)))
    f = photometry.Sparse(a, b, v, 60)
    dense = np.zeros((60, 60))
    dense[a, b] = dense[b, a] = v
    x = rng.random(60)
    assert np.allclose(f @ x, dense @ x)
    parts = f.parts()
    assert sorted(np.concatenate(parts).tolist()) == list(range(60))
    for p in parts:
        assert np.allclose(f.dense(p), dense[np.ix_(p, p)])
        assert not dense[np.ix_(p, np.setdiff1d(np.arange(60), p))].any()


def test_profile_statistics_by_hand(spark):
    rng = np.random.default_rng(6)
    rows, expected = [], {}
    for s in range(3):
        total = dict.fromkeys(("prochi2", "pronpix", "promasked", "proflux", "npix", "num", "den", "inside", "images", "extra"), 0.0)
        for i in range(3):
            a, data, model = rng.random(12) / 12, rng.random(12) * 9, rng.random(12) * 8
            iv, extra = np.where(rng.random(12) < 0.3, 0.0, rng.random(12)), rng.random(12)
            a[rng.random(12) < 0.2] = 0
            c = 0.0 if (s, i) == (1, 1) else float(rng.uniform(0.05, 3))
            iv = iv * 0 if (s, i) == (2, 0) else iv
            rows += [(s, i, float(a[p]), c, float(model[p]), float(data[p]), float(iv[p]), float(extra[p])) for p in range(12)]
            nz = (a != 0) & (iv > 0)
            if c == 0 or not nz.any():
                continue
            chi2 = (data - model) ** 2 * iv
            total["prochi2"] += (a * chi2)[nz].sum()
            total["pronpix"] += a[nz].sum()
            total["promasked"] += a[iv == 0].sum()
            total["num"] += (np.abs(model / c - a) * a)[nz].sum() / (a**2)[nz].sum()
            total["den"] += (a / c)[nz].sum()
            total["proflux"] += (np.abs(model - a * c) * a)[nz].sum()
            total["npix"] += nz.sum()
            total["inside"] += a.sum()
            total["images"] += 1
            total["extra"] += (a * extra)[nz].sum()
        expected[s] = total
    df = spark.createDataFrame(rows, "src_id long, image_id long, a double, flux double, model double, data double, iv double, extra double")
    for r in photometry.profile_statistics(df, "src_id", extras=("extra",)).collect():
        e = expected[r.src_id]
        want = [e["prochi2"], e["pronpix"], e["promasked"], e["num"] / max(1, e["den"]), e["inside"] / max(1, e["images"]), e["proflux"], e["npix"], e["extra"]]
        assert np.allclose([r.prochi2, r.pronpix, r.promasked, r.profracflux, r.fracin, r.proflux, r.npix, r.extra], want)


def test_position_angles_follow_the_image(spark):
    from pyspark.sql import functions as F

    from skyframe.functions import sky

    w = {k: F.lit(v) for k, v in dict(crpix1=5.0, crpix2=6.0, crval1=40.0, crval2=30.0, cd11=-1e-3, cd12=0.0, cd21=0.0, cd22=1e-3).items()}
    df = spark.createDataFrame([(0.0,), (90.0,), (30.0,)], "pa double")
    for kind in ("tangent", "affine"):
        # east is to the left and north up
        got = [r.a for r in df.select(sky.pixel_position_angle(F.col("pa"), F.lit(40.0), F.lit(30.0), w, kind).alias("a")).collect()]
        assert np.allclose(np.cos(np.radians(got)), np.cos(np.radians([180, 90, 150])), atol=1e-5) and got[1] > 89 and got[2] > 149
        down = [r.a for r in df.select(sky.pixel_position_angle(F.col("pa"), F.lit(40.0), F.lit(30.0), w, kind, y_down=True).alias("a")).collect()]
        assert np.allclose(down[1:], [-90, -150], atol=1e-3)


def test_quality_by_hand(spark):
    rng = np.random.default_rng(9)
    data, bkg, iv, bad = rng.normal(5, 9, 60), rng.random(60), rng.random(60), rng.random(60) < 0.2
    data[3], bkg[5], iv[7], data[9] = np.nan, np.nan, 0.0, np.inf
    rows = [(1, float(a), float(b), float(c), bool(d)) for a, b, c, d in zip(data, bkg, iv, bad)] + [(2, 1.0, 2.0, 0.0, True)]
    one, two = photometry.quality(spark.createDataFrame(rows, "image_id long, data double, bkg double, iv double, bad boolean"), "image_id").orderBy("image_id").collect()
    ok = ~bad & np.isfinite(data) & np.isfinite(bkg) & (iv > 0)
    clean, snr = (data - bkg)[ok], (np.abs(data - bkg) * np.sqrt(iv))[ok]
    want = [60, bad.mean(), ok.mean(), np.nanmedian(bkg), np.nanmean(bkg), np.nanstd(bkg), np.median(clean), clean.std(), np.median(snr), snr.mean()]
    assert np.allclose(list(one)[1:], want)
    assert two.valid_fraction == 0 and two.data_median is None and two.snr_mean is None


def test_empty_stamps_have_no_centre(spark):
    s = spark.createDataFrame([(1, y, x, 0.0) for y in range(3) for x in range(3)] + [(2, 0, 1, 2.0), (2, 2, 1, 2.0)], "psf_id long, y int, x int, value double")
    one, two = stamps.centroid(s, "psf_id").orderBy("psf_id").collect()
    assert (one.total, one.cy, one.cx) == (0.0, None, None) and (two.total, two.cy, two.cx, two.py, two.px) == (4.0, 1.0, 1.0, 0, 1)
    assert {r.value for r in stamps.normalise(s, "psf_id").collect()} == {None, 0.5}
    assert stamps.halve(s, "psf_id", 3).where("psf_id = 1 and value is not null").count() == 0
